"""Registered queries of the market operators, each with SQL that another engine can run on the same tables.

All read bars built from ``events`` (or ``orders``). Results have symbol, ts_s (the
bar's begin in seconds since 1970) and values rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline.functions import price, rolling
from barline.functions.windows import BARS
from barline.operators import frame, momentum, programs, rolling as rolled, transforms, trend, volatility, volume
from barline.sources.bars import event_bars, order_bars

Query = Callable[[SparkSession, str], DataFrame]

_BARS = """WITH bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER o AS rn, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl,
 (high + low + close) / 3 AS tp FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""
_KEY = "symbol, CAST(epoch(ts) AS BIGINT) AS ts_s"
_O = "PARTITION BY symbol ORDER BY ts"


def _r(n: int) -> str:
    return f"({_O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def seconds(ts: str = "ts") -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp")).alias("ts_s")


def plain(name: str, places: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(name, places) + F.lit(0.0)


def shown(df: DataFrame, *names: str, finer: str = "") -> DataFrame:
    """The columns to six places, ``finer`` to nine (where values may lie halfway between two roundings)."""
    kinds = dict(df.dtypes)
    return df.select("symbol", seconds(), *[plain(n, 9 if n == finer else 6).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


def _indicator(add: Callable[[DataFrame], DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: shown(add(event_bars(spark, sf_dir)), *names)


def _expressions(**made: Callable[[], Column]) -> Query:
    return lambda spark, sf_dir: shown(event_bars(spark, sf_dir).withColumns({k: f() for k, f in made.items()}), *made)


def _sql(ctes: str = "", source: str = "b", **made: str) -> str:
    values = ", ".join(f"{v} AS {k}" for k, v in made.items())
    return f"{_BARS}{', ' + ctes if ctes else ''} SELECT {_KEY}, {values} FROM {source}"


def _round(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _full(n: int, x: str) -> str:
    return f"CASE WHEN rn >= {n} THEN round({x}, 6) + 0.0 END"


def _lists(**columns: str) -> str:
    """A table l: the bars with running lists of expressions."""
    return "l AS (SELECT *, " + ", ".join(f"list({v}) OVER ({_O}) AS {k}" for k, v in columns.items()) + " FROM {})"


def _ema(values: str, n: int) -> str:
    return f"list_reduce(list_concat([list_sum({values}[1:{n}]) / {n}], {values}[{n + 1}:]), lambda a, x: {2 / (n + 1)!r} * x + {1 - 2 / (n + 1)!r} * a)"


def _wilder(values: str, n: int) -> str:
    return f"list_reduce(list_concat([list_sum({values}[1:{n}]) / {n}], {values}[{n + 1}:]), lambda a, x: (a * {n - 1} + x) / {n})"


_TR = "tr AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS t FROM b)"
_CLOSES = _lists(xs="close").format("b")


def _frame_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame.add_column(event_bars(spark, sf_dir), "span", price.bar_range())
    df = frame.rename_column(frame.drop_column(df, "volume"), "span", "reach")
    return shown(frame.set_column(frame.select(df, "symbol", "ts", "close", "reach"), "twice", 2 * F.col("reach")), "close", "reach", "twice")


def _concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    left = bars.select("symbol", "ts", "close")
    return shown(frame.concat(left, bars.select("symbol", "ts", "volume")), "close", "volume")


def _series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame.series_stats(event_bars(spark, sf_dir), "close")
    names = ("total", "mean", "least", "most", "first", "last")
    return found.select("symbol", "n", "n_missing", "has_missing", *[plain(n).alias(n) for n in names])


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame.quantiles(event_bars(spark, sf_dir), "close", (0.1, 0.25, 0.5, 0.75))
    return found.select("symbol", *[plain(f"q{i}").alias(f"q{i}") for i in range(4)])


def _scaled(make: Callable[[], transforms.Transform], back: bool = False) -> Query:
    names = ("open", "high", "low", "close", "volume")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = event_bars(spark, sf_dir)
        step = make()
        step.fit(bars)
        made = step.transform(bars)
        return shown(step.inverse(made) if back else made, *names)

    return query


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    steps = transforms.Pipeline(transforms.LogReturn(["close", "volume"], fill=0.0), transforms.RobustNormalization(["close", "volume"]))
    return shown(steps.fit_transform(bars), "close", "volume")


def _head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir)
    return shown(frame.append(frame.head(bars, 3), frame.tail(bars, 2)), "close")


def _gaps(pieces: str | None) -> Query:
    """Averages of closes that are missing in rows 1 to 3 and in row 300."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = event_bars(spark, sf_dir)
        rn = F.row_number().over(BARS.ordered())
        bars = bars.withColumn("close", F.when((rn > 3) & (rn != 300), F.col("close")))
        return shown(trend.macd(trend.wilder(trend.ema(bars, pieces=pieces), pieces=pieces), pieces=pieces), "ema_14", "wilder_14", "macd", "macd_signal")

    return query


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by user with many indicators in one plan."""
    df = event_bars(spark, sf_dir, "user_id", "day")
    for add in (trend.sma, volatility.bollinger, volatility.donchian, momentum.williams_r, momentum.stochastic, volume.cmf, volume.mfi, volume.obv):
        df = add(df)
    return shown(df, "sma_14", "bb_upper", "dc_width", "williams_r_14", "stoch_d", "cmf_20", "mfi_14", "obv")


def _by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrences over series that are cut by month."""
    df = volatility.keltner(volatility.atr(trend.adx(event_bars(spark, sf_dir), pieces="month"), pieces="month"), pieces="month")
    return shown(df, "adx", "atr_14", "kc_upper")


#: Rows of each series in which a column is missing, as NaN or infinite.
_GONE = {"close": {20: "NaN", 41: "Infinity"}, "high": {50: "Infinity"}, "low": {60: "NaN"}, "volume": {70: "NaN", 71: "-Infinity"}}
_NAN_NAMES = ("sma_20", "wma_14", "bb_upper", "bb_pct_b", "dc_upper", "dc_lower", "dc_width", "aroon_up", "aroon_down", "williams_r_14", "stoch_d", "rsi_14", "roc_12", "obv", "vwap", "mfi_14", "cmf_20", "tr", "valid")


def _nan_bars(pieces: str | None) -> Query:
    """Indicators of bars some of whose values are NaN or infinite, as tables that others have written may be."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rn = F.row_number().over(BARS.ordered())
        df = event_bars(spark, sf_dir).withColumn("rn", rn)
        for name, gone in _GONE.items():
            for row, missing in gone.items():
                df = df.withColumn(name, F.when(F.col("rn") == row, F.lit(float(missing))).otherwise(F.col(name)))
        df = df.drop("rn").withColumns({"tr": price.true_range(), "valid": price.is_valid()})
        if pieces:
            own = [programs.rolling("mean", 20, out="sma_20"), programs.rolling("wma", 14), programs.bollinger(), programs.donchian(), programs.aroon(), programs.williams_r(), programs.stochastic(), programs.rsi(), programs.roc(), programs.obv(), programs.vwap(), programs.vwap("rolling", 10, "vwap_10"), programs.mfi(), programs.cmf()]
            return shown(programs.study(df, own, pieces=pieces), *_NAN_NAMES, finer="vwap")
        df = volume.vwap(trend.sma(df, 20), "rolling", 10, out="vwap_10")
        for add in (trend.wma, volatility.bollinger, volatility.donchian, trend.aroon, momentum.williams_r, momentum.stochastic, momentum.rsi, momentum.roc, volume.obv, volume.vwap, volume.mfi, volume.cmf):
            df = add(df)
        return shown(df, *_NAN_NAMES, finer="vwap")

    return query


def _windows_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over series that are cut by month, in one study."""
    own = [programs.rolling("mean", 14, out="sma_14"), programs.rolling("wma", 14), programs.bollinger(), programs.donchian(), programs.aroon(), programs.stochastic(), programs.williams_r(), programs.cmf(), programs.mfi(), programs.roc(), programs.rolling("sum", 10, "volume", "total")]
    return shown(programs.study(event_bars(spark, sf_dir), own, pieces="month"), "sma_14", "wma_14", "bb_upper", "bb_pct_b", "dc_width", "aroon_up", "aroon_down", "stoch_d", "williams_r_14", "cmf_20", "mfi_14", "roc_12", "total")


def _running_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running functions carried over series that are cut by month."""
    df = event_bars(spark, sf_dir).withColumn("seldom", F.when(F.col("volume") > 3, F.col("close")))
    df = volume.vwap(volume.vwap(volume.obv(df, pieces="month"), pieces="month"), "session", out="vwap_day", pieces="month")
    df = rolled.running_sum(rolled.ffill(df, "seldom", "carried", pieces="month"), "seldom", "total", pieces="month")
    df = rolled.pct_change(rolled.diff(df, 3, pieces="month"), 2, pieces="month")
    return shown(df, "obv", "vwap", "vwap_day", "carried", "total", "diff_3", "pct_change_2")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 rows, in kernels whose work does not grow with the width."""
    df = volatility.donchian(volatility.bollinger(trend.wma(trend.sma(event_bars(spark, sf_dir), 200), 200), 200), 200)
    df = volume.cmf(momentum.williams_r(trend.aroon(df, 200), 200), 200)
    return shown(df, "sma_200", "wma_200", "bb_upper", "dc_width", "aroon_up", "aroon_down", "williams_r_200", "cmf_200")


_PRICES = ("open", "high", "low", "close", "volume")


def _order_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(trend.sma(order_bars(spark, sf_dir), 5), "open", "close", "volume", "sma_5")


def _events(name: str) -> str:
    return f"CASE WHEN {name} > 0 AND lag({name}) OVER w > 0 THEN ln({name} / lag({name}) OVER w) END"


def _zscores(robust: bool, back: bool = False) -> str:
    center = "median({0})" if robust else "avg({0})"
    scale = "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)" if robust else "stddev_samp({0})"
    stats = "s AS (SELECT " + ", ".join(f"{center.format(c)} AS c_{c}, CASE WHEN ({scale.format(c)}) > 0 THEN {scale.format(c)} ELSE 1 END AS s_{c}" for c in _PRICES) + " FROM b)"
    return _sql(stats, "b, s", **{c: _round(c if back else f"({c} - c_{c}) / s_{c}") for c in _PRICES})


def _zscores_by_symbol(robust: bool) -> str:
    center = "median({0})" if robust else "avg({0})"
    scale = "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)" if robust else "stddev_samp({0})"
    stats = "s AS (SELECT symbol AS of, " + ", ".join(f"{center.format(c)} AS c_{c}, CASE WHEN ({scale.format(c)}) > 0 THEN {scale.format(c)} ELSE 1 END AS s_{c}" for c in _PRICES) + " FROM b GROUP BY symbol)"
    return _sql(stats, "b JOIN s ON b.symbol = s.of", **{c: _round(f"({c} - c_{c}) / s_{c}") for c in _PRICES})


_LOGV = "CASE WHEN rn > 1 THEN (CASE WHEN volume > 0 THEN ln(1 + volume) ELSE 0 END) - (CASE WHEN pv > 0 THEN ln(1 + pv) ELSE 0 END) END"
_RSI_LISTS = "g AS (SELECT *, CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss FROM b), " + _lists(gs="gain", ls="loss").format("g")


def _first_ema(values: str, n: int) -> str:
    return f"list_reduce({values}, lambda a, x: x / {n} + (1 - 1.0 / {n}) * a)"


_RSI = f"r AS (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN ag < 1e-10 AND al < 1e-10 THEN 50 WHEN al < 1e-10 THEN 100 WHEN ag < 1e-10 THEN 0 ELSE 100 - 100 / (1 + ag / al) END END AS rsi FROM (SELECT *, {_first_ema('gs', 14)} AS ag, {_first_ema('ls', 14)} AS al FROM l))"


def _skip(values: str, n: int) -> str:
    return f"list_reduce(list_concat([list_sum({values}[1:{n}])], {values}[{n + 2}:]), lambda a, x: a - a / {n} + x)"


_ADX = (
    _TR
    + """, d AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS p, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS m FROM tr), """
    + _lists(ts_="t", ps="p", ms="m").format("d")
    + f""", s AS (SELECT *, CASE WHEN rn > 14 THEN {_skip('ts_', 14)} END AS st, CASE WHEN rn > 14 THEN {_skip('ps', 14)} END AS sp, CASE WHEN rn > 14 THEN {_skip('ms', 14)} END AS sm FROM l),
 di AS (SELECT *, CASE WHEN st IS NOT NULL THEN CASE WHEN abs(st) < 1e-10 THEN 0 ELSE 100 * sp / st END END AS plus_di, CASE WHEN st IS NOT NULL THEN CASE WHEN abs(st) < 1e-10 THEN 0 ELSE 100 * sm / st END END AS minus_di FROM s),
 dx AS (SELECT *, CASE WHEN plus_di IS NOT NULL THEN CASE WHEN plus_di + minus_di > 1e-10 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) ELSE 0 END END AS dx FROM di),
 f AS (SELECT *, list(dx) FILTER (dx IS NOT NULL) OVER ({_O}) AS ds FROM dx)"""
)
_MACD = f"{_CLOSES}, m AS (SELECT symbol, ts, rn, CASE WHEN rn >= 26 THEN {_ema('xs', 12)} - {_ema('xs', 26)} END AS macd FROM l), n AS (SELECT *, list(macd) FILTER (macd IS NOT NULL) OVER ({_O}) AS ms FROM m), q AS (SELECT *, CASE WHEN rn >= 34 THEN {_ema('ms', 9)} END AS sig FROM n)"
_STOCH = f"k0 AS (SELECT *, min(low) OVER {_r(14)} AS ll, max(high) OVER {_r(14)} AS hh FROM b), k1 AS (SELECT *, CASE WHEN rn >= 14 THEN CASE WHEN abs(hh - ll) < 1e-10 THEN 50 ELSE 100 * (close - ll) / (hh - ll) END END AS raw FROM k0), k2 AS (SELECT *, CASE WHEN rn >= 16 THEN avg(raw) OVER {_r(3)} END AS k FROM k1), k3 AS (SELECT *, CASE WHEN rn >= 18 THEN avg(k) OVER {_r(3)} END AS d FROM k2)"
_SRSI = f"{_RSI_LISTS}, {_RSI}, t0 AS (SELECT *, min(rsi) OVER {_r(14)} AS lo, max(rsi) OVER {_r(14)} AS hi FROM r), t1 AS (SELECT *, CASE WHEN rn >= 27 THEN CASE WHEN hi - lo < 1e-10 THEN 0.5 ELSE (rsi - lo) / (hi - lo) END END AS s FROM t0), t2 AS (SELECT *, CASE WHEN rn >= 29 THEN avg(s) OVER {_r(3)} END AS k FROM t1), t3 AS (SELECT *, CASE WHEN rn >= 31 THEN avg(k) OVER {_r(3)} END AS d FROM t2)"
_MFI = f"u AS (SELECT *, lag(tp) OVER ({_O}) AS ptp FROM b), v AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS down FROM u), w AS (SELECT *, sum(up) OVER {_r(14)} AS pos, sum(down) OVER {_r(14)} AS neg FROM v)"
_BB = f"e AS (SELECT *, avg(close) OVER {_r(20)} AS mid, 2 * coalesce(stddev_samp(close) OVER {_r(20)}, 0) AS sp FROM b)"

_MFI_VALUE = "CASE WHEN pos < 1e-10 AND neg < 1e-10 THEN 50 WHEN neg < 1e-10 THEN 100 WHEN pos < 1e-10 THEN 0 ELSE 100 - 100 / (1 + pos / neg) END"
_OBV = f"sum(CASE WHEN close - pc > 1e-10 THEN volume WHEN close - pc < -1e-10 THEN -volume ELSE 0 END) OVER ({_O})"
# Missing closes: the averages begin at row 4 and end before row 300.
_GAPS = (
    _lists(xs="CASE WHEN rn > 3 THEN close END").format("b").replace("list(CASE WHEN rn > 3 THEN close END)", "list(close) FILTER (rn > 3)")
    + f", m AS (SELECT *, CASE WHEN rn BETWEEN 29 AND 299 THEN {_ema('xs', 12)} - {_ema('xs', 26)} END AS macd FROM l), n AS (SELECT *, list(macd) FILTER (macd IS NOT NULL) OVER ({_O}) AS ms FROM m), q AS (SELECT * FROM n)"
)
_GAP_VALUES = {
    "ema_14": f"CASE WHEN rn BETWEEN 17 AND 299 THEN round({_ema('xs', 14)}, 6) + 0.0 END",
    "wilder_14": f"CASE WHEN rn BETWEEN 17 AND 299 THEN round({_wilder('xs', 14)}, 6) + 0.0 END",
    "macd": _round("macd"),
    "macd_signal": f"CASE WHEN rn BETWEEN 37 AND 299 THEN round({_ema('ms', 9)}, 6) + 0.0 END",
}
_BY_MONTH = f"{_ADX.replace(_lists(ts_='t', ps='p', ms='m').format('d'), _lists(ts_='t', ps='p', ms='m', xs='close').format('d'))}, z AS (SELECT *, {_ema('xs', 20)} AS mid, 2 * {_wilder('ts_', 10)} AS band FROM f)"
_BY_MONTH_VALUES = {"adx": f"CASE WHEN rn >= 28 THEN round({_wilder('ds', 14)}, 6) END", "atr_14": _full(14, _wilder("ts_", 14)), "kc_upper": _full(20, "mid + band")}



def _where_all(n: int, count: str, x: str) -> str:
    return f"CASE WHEN count({count}) OVER {_r(n)} = {n} THEN round({x}, 6) + 0.0 END"


def _gone(name: str) -> str:
    return f"CASE WHEN r NOT IN ({', '.join(map(str, _GONE[name]))}) THEN {name} END AS {name}"


_AROON = "a0 AS (SELECT *, max(struct_pack(v := high, r := rn)) OVER {f} AS hi, min(struct_pack(v := low, r := -rn)) OVER {f} AS lo FROM {{}}), a1 AS (SELECT *, 100.0 * ({n} - (rn - hi.r)) / {n} AS a_up, 100.0 * ({n} - (rn + lo.r)) / {n} AS a_down FROM a0)"
_NAN_BARS = _BARS.replace(
    "b AS (SELECT *, row_number()", f"gaps AS (SELECT symbol, ts, open, {', '.join(map(_gone, ('high', 'low', 'close', 'volume')))} FROM (SELECT *, row_number() OVER ({_O}) AS r FROM bars)),\n b AS (SELECT *, row_number()"
).replace("FROM bars WINDOW o", "FROM gaps WINDOW o")
_EXTREMES = f"min(low) OVER {_r(14)} AS ll, max(high) OVER {_r(14)} AS hh, count(low) OVER {_r(14)} AS nl, count(high) OVER {_r(14)} AS nh"
_NAN_SQL = (
    f"{_NAN_BARS}, {_RSI_LISTS}, {_RSI}, u AS (SELECT *, lag(tp) OVER ({_O}) AS ptp, lag(close, 12) OVER ({_O}) AS c12, list(close) OVER {_r(14)} AS last14, {_EXTREMES} FROM r), "
    f"w AS (SELECT *, coalesce(sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER {_r(14)}, 0) AS pos, coalesce(sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER {_r(14)}, 0) AS neg, CASE WHEN nl = 14 AND nh = 14 THEN CASE WHEN abs(hh - ll) < 1e-10 THEN 0.5 ELSE (close - ll) / (hh - ll) END END AS raw FROM u), "
    f"k AS (SELECT *, CASE WHEN count(raw) OVER {_r(3)} = 3 THEN avg(raw) OVER {_r(3)} END AS k FROM w), "
    + _AROON.format(f=_r(26), n=25).format("k")
    + f", y AS (SELECT *, CASE WHEN count(close) OVER {_r(20)} = 20 THEN avg(close) OVER {_r(20)} END AS mid, 2 * stddev_samp(close) OVER {_r(20)} AS sp, CASE WHEN abs(high - low) < 1e-10 THEN 0 ELSE (2 * close - high - low) / (high - low) END AS clv, sum(tp * volume) OVER ({_O}) / sum(volume) OVER ({_O}) AS va, "
    f"CASE WHEN rn >= 10 THEN sum(tp * volume) OVER {_r(10)} / sum(volume) OVER {_r(10)} END AS vr FROM a1) SELECT {_KEY}, "
    + ", ".join(
        f"{v} AS {k}"
        for k, v in {
            "sma_20": _round("mid"),
            "wma_14": "CASE WHEN rn >= 14 AND len(list_filter(last14, lambda x: x IS NOT NULL)) = 14 THEN round(list_sum(list_transform(last14, lambda x, i: x * i)) / 105, 6) + 0.0 END",
            "bb_upper": _round("mid + sp"),
            "bb_pct_b": _round("CASE WHEN sp > 5e-11 THEN (close - (mid - sp)) / (2 * sp) WHEN mid IS NOT NULL THEN 0.5 END"),
            "dc_upper": _where_all(20, "high", f"max(high) OVER {_r(20)}"),
            "dc_lower": _where_all(20, "low", f"min(low) OVER {_r(20)}"),
            "dc_width": f"CASE WHEN count(high) OVER {_r(20)} = 20 AND count(low) OVER {_r(20)} = 20 THEN round(max(high) OVER {_r(20)} - min(low) OVER {_r(20)}, 6) + 0.0 END",
            "aroon_up": f"CASE WHEN count(high) OVER {_r(26)} = 26 AND count(low) OVER {_r(26)} = 26 THEN round(a_up, 6) + 0.0 END",
            "aroon_down": f"CASE WHEN count(high) OVER {_r(26)} = 26 AND count(low) OVER {_r(26)} = 26 THEN round(a_down, 6) + 0.0 END",
            "williams_r_14": "CASE WHEN nl = 14 AND nh = 14 THEN round(CASE WHEN abs(hh - ll) < 1e-10 THEN -50 ELSE -100 * (hh - close) / (hh - ll) END, 6) + 0.0 END",
            "stoch_d": f"CASE WHEN count(k) OVER {_r(3)} = 3 THEN round(100 * avg(k) OVER {_r(3)}, 6) + 0.0 END",
            "rsi_14": _round("rsi"),
            "roc_12": _round("CASE WHEN abs(c12) >= 1e-10 THEN 100 * (close - c12) / c12 END"),
            "obv": _round(_OBV),
            "vwap": f"round(last_value(va IGNORE NULLS) OVER ({_O}), 9) + 0.0",
            "mfi_14": _full(15, _MFI_VALUE),
            "cmf_20": _full(20, f"sum(clv * volume) OVER {_r(20)} / sum(volume) OVER {_r(20)}"),
            "tr": _round("greatest(high - low, abs(high - pc), abs(low - pc))"),
            "valid": "coalesce(low <= open AND open <= high AND low <= close AND close <= high AND volume >= 0, false)",
        }.items()
    )
    + " FROM y"
)
_WINDOWS_SQL = _sql(
    f"{_STOCH}, {_MFI.replace('FROM b)', 'FROM k3)')}, {_BB.replace('FROM b)', 'FROM w)')}, y AS (SELECT *, list(close) OVER {_r(14)} AS last14, lag(close, 12) OVER ({_O}) AS c12, CASE WHEN abs(high - low) < 1e-10 THEN 0 ELSE (2 * close - high - low) / (high - low) END AS clv FROM e), "
    + _AROON.format(f=_r(26), n=25).format("y"),
    "a1",
    sma_14=_full(14, f"avg(close) OVER {_r(14)}"),
    wma_14=_full(14, "list_sum(list_transform(last14, lambda x, i: x * i)) / 105"),
    bb_upper=_full(20, "mid + sp"),
    bb_pct_b=_full(20, "CASE WHEN mid + sp - (mid - sp) > 1e-10 THEN (close - (mid - sp)) / (mid + sp - (mid - sp)) ELSE 0.5 END"),
    dc_width=_full(20, f"max(high) OVER {_r(20)} - min(low) OVER {_r(20)}"),
    aroon_up=_full(26, "a_up"),
    aroon_down=_full(26, "a_down"),
    stoch_d=_round("d"),
    williams_r_14=_full(14, "CASE WHEN abs(hh - ll) < 1e-10 THEN -50 ELSE -100 * (hh - close) / (hh - ll) END"),
    cmf_20=_full(20, f"sum(clv * volume) OVER {_r(20)} / sum(volume) OVER {_r(20)}"),
    mfi_14=_full(15, _MFI_VALUE),
    roc_12=_round("CASE WHEN abs(c12) >= 1e-10 THEN 100 * (close - c12) / c12 END"),
    total=_full(10, f"sum(volume) OVER {_r(10)}"),
)
_DAY = "PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts"
_RUNNING_SQL = _sql(
    f"e AS (SELECT *, CASE WHEN volume > 3 THEN close END AS x, lag(close, 3) OVER ({_O}) AS c3, lag(close, 2) OVER ({_O}) AS c2 FROM b)",
    "e",
    obv=_round(_OBV),
    vwap=_round(f"sum(tp * volume) OVER ({_O}) / sum(volume) OVER ({_O})"),
    vwap_day=_round(f"sum(tp * volume) OVER ({_DAY}) / sum(volume) OVER ({_DAY})"),
    carried=_round(f"last_value(x IGNORE NULLS) OVER ({_O})"),
    total=_round(f"sum(x) OVER ({_O})"),
    diff_3=_round("close - c3"),
    pct_change_2=_round("CASE WHEN c2 <> 0 THEN (close - c2) / c2 END"),
)
_WIDE_SQL = _sql(
    f"y AS (SELECT *, list(close) OVER {_r(200)} AS last, avg(close) OVER {_r(200)} AS mid, 2 * stddev_samp(close) OVER {_r(200)} AS sp, min(low) OVER {_r(200)} AS ll, max(high) OVER {_r(200)} AS hh, CASE WHEN abs(high - low) < 1e-10 THEN 0 ELSE (2 * close - high - low) / (high - low) END AS clv FROM b), " + _AROON.format(f=_r(201), n=200).format("y"),
    "a1",
    sma_200=_full(200, "mid"),
    wma_200=_full(200, "list_sum(list_transform(last, lambda x, i: x * i)) / 20100"),
    bb_upper=_full(200, "mid + sp"),
    dc_width=_full(200, "hh - ll"),
    aroon_up=_full(201, "a_up"),
    aroon_down=_full(201, "a_down"),
    williams_r_200=_full(200, "CASE WHEN abs(hh - ll) < 1e-10 THEN -50 ELSE -100 * (hh - close) / (hh - ll) END"),
    cmf_200=_full(200, f"sum(clv * volume) OVER {_r(200)} / sum(volume) OVER {_r(200)}"),
)

#: name -> (query, SQL)
REGISTRY: dict[str, tuple[Query, str]] = {
    "bars_1h": (lambda s, d: shown(event_bars(s, d), *_PRICES), _sql(**{c: _round(c) for c in _PRICES})),
    "prices": (
        _expressions(typical=price.typical_price, median=price.median_price, weighted=price.weighted_close),
        _sql(typical=_round("tp"), median=_round("(high + low) / 2"), weighted=_round("(high + low + 2 * close) / 4")),
    ),
    "candle_shape": (
        _expressions(reach=price.bar_range, body=price.body, upper=price.upper_shadow, lower=price.lower_shadow, bullish=price.is_bullish, bearish=price.is_bearish, valid=price.is_valid),
        _sql(reach=_round("high - low"), body=_round("abs(close - open)"), upper=_round("high - greatest(open, close)"), lower=_round("least(open, close) - low"), bullish="close > open", bearish="close < open", valid="low <= open AND open <= high AND low <= close AND close <= high AND volume >= 0"),
    ),
    "clamp": (_expressions(clamped=lambda: price.clamp(F.col("close"), 20.0, 80.0), apart=lambda: price.abs_diff(F.col("close"), F.col("open"))), _sql(clamped=_round("least(greatest(close, 20.0), 80.0)"), apart=_round("abs(close - open)"))),
    "crossover": (
        lambda s, d: shown(trend.sma(trend.sma(event_bars(s, d), 5), 20).withColumns({"over": price.crossover(F.col("sma_5"), F.col("sma_20")), "under": price.crossunder(F.col("sma_5"), F.col("sma_20"))}), "over", "under"),
        _sql(f"e AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER {_r(5)} END AS f, CASE WHEN rn >= 20 THEN avg(close) OVER {_r(20)} END AS s FROM b), p AS (SELECT *, lag(f) OVER ({_O}) AS pf, lag(s) OVER ({_O}) AS ps FROM e)", "p", over="coalesce(pf <= ps AND f > s, false)", under="coalesce(pf >= ps AND f < s, false)"),
    ),
    "sma": (_indicator(lambda x: trend.sma(x, 20), "sma_20"), _sql(sma_20=_full(20, f"avg(close) OVER {_r(20)}"))),
    "sma_fillna": (_indicator(lambda x: trend.sma(x, 20, fillna=True), "sma_20"), _sql(sma_20=f"coalesce({_full(20, f'avg(close) OVER {_r(20)}')}, 0.0)")),
    "rolling_sum": (_expressions(total=lambda: rolling.rolling_sum(F.col("volume"), 10)), _sql(total=_full(10, f"sum(volume) OVER {_r(10)}"))),
    "rolling_variance": (
        _expressions(sample=lambda: rolling.rolling_variance(F.col("close"), 10), population=lambda: rolling.rolling_variance(F.col("close"), 10, 0), deviation=lambda: rolling.rolling_std(F.col("close"), 10)),
        _sql(sample=_full(10, f"var_samp(close) OVER {_r(10)}"), population=_full(10, f"var_pop(close) OVER {_r(10)}"), deviation=_full(10, f"stddev_samp(close) OVER {_r(10)}")),
    ),
    "rolling_extremes": (_expressions(most=lambda: rolling.rolling_max(F.col("high"), 10), least=lambda: rolling.rolling_min(F.col("low"), 10)), _sql(most=_full(10, f"max(high) OVER {_r(10)}"), least=_full(10, f"min(low) OVER {_r(10)}"))),
    "diff": (_expressions(d1=lambda: rolling.diff(F.col("close")), d3=lambda: rolling.diff(F.col("close"), 3)), _sql(d1=_round("close - pc"), d3=_round(f"close - lag(close, 3) OVER ({_O})"))),
    "shift": (_expressions(back=lambda: rolling.shift(F.col("close"), 2, -1.0), ahead=lambda: rolling.shift(F.col("close"), -2)), _sql(back=_round(f"lag(close, 2, -1.0) OVER ({_O})"), ahead=_round(f"lead(close, 2) OVER ({_O})"))),
    "pct_change": (_expressions(change=lambda: rolling.pct_change(F.col("close"), 2)), _sql(f"e AS (SELECT *, lag(close, 2) OVER ({_O}) AS x FROM b)", "e", change=_round("CASE WHEN x <> 0 THEN (close - x) / x END"))),
    "ffill": (
        _expressions(carried=lambda: rolling.ffill(F.when(F.col("volume") > 3, F.col("close"))), filled=lambda: rolling.fillna(F.when(F.col("volume") > 3, F.col("close")), -1.0)),
        _sql("e AS (SELECT *, CASE WHEN volume > 3 THEN close END AS x FROM b)", "e", carried=_round(f"last_value(x IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), filled=_round("coalesce(x, -1.0)")),
    ),
    "true_range": (_expressions(tr=price.true_range), _sql(_TR, "tr", tr=_round("t"))),
    "ema": (_indicator(trend.ema, "ema_14"), _sql(_CLOSES, "l", ema_14=_full(14, _ema("xs", 14)))),
    "wilder": (_indicator(trend.wilder, "wilder_14"), _sql(_CLOSES, "l", wilder_14=_full(14, _wilder("xs", 14)))),
    "ema_gaps": (_gaps(None), _sql(_GAPS, "q", **_GAP_VALUES)),
    "ema_gaps_by_month": (_gaps("month"), _sql(_GAPS, "q", **_GAP_VALUES)),
    "nan_bars": (_nan_bars(None), _NAN_SQL),
    "nan_bars_by_month": (_nan_bars("month"), _NAN_SQL),
    "windows_by_month": (_windows_by_month, _WINDOWS_SQL),
    "running_by_month": (_running_by_month, _RUNNING_SQL),
    "wide_windows": (_wide, _WIDE_SQL),
    "indicators_by_month": (_by_month, _sql(_BY_MONTH, "z", **_BY_MONTH_VALUES)),
    "wma": (_indicator(trend.wma, "wma_14"), _sql(f"e AS (SELECT *, {' + '.join(f'{14 - k} * lag(close, {k}) OVER ({_O})' for k in range(14))} AS x FROM b)", "e", wma_14=_round("x / 105"))),
    "macd": (_indicator(trend.macd, "macd", "macd_signal", "macd_histogram"), _sql(_MACD, "q", macd=_round("macd"), macd_signal=_round("sig"), macd_histogram=_round("macd - sig"))),
    "adx": (_indicator(trend.adx, "adx", "plus_di", "minus_di"), _sql(_ADX, "f", adx=f"CASE WHEN rn >= 28 THEN round({_wilder('ds', 14)}, 6) END", plus_di=_round("plus_di"), minus_di=_round("minus_di"))),
    "aroon": (
        _indicator(trend.aroon, "aroon_up", "aroon_down", "aroon_oscillator"),
        _sql(f"e AS (SELECT *, max(struct_pack(v := high, r := rn)) OVER {_r(26)} AS hi, min(struct_pack(v := low, r := -rn)) OVER {_r(26)} AS lo FROM b), a AS (SELECT *, 100.0 * (25 - (rn - hi.r)) / 25 AS up, 100.0 * (25 - (rn + lo.r)) / 25 AS down FROM e)", "a", aroon_up=_full(26, "up"), aroon_down=_full(26, "down"), aroon_oscillator=_full(26, "up - down")),
    ),
    "rsi": (_indicator(momentum.rsi, "rsi_14"), _sql(f"{_RSI_LISTS}, {_RSI}", "r", rsi_14=_round("rsi"))),
    "stoch_rsi": (_indicator(momentum.stoch_rsi, "stoch_rsi", "stoch_rsi_k", "stoch_rsi_d"), _sql(_SRSI, "t3", stoch_rsi=_round("s"), stoch_rsi_k=_round("k"), stoch_rsi_d=_round("d"))),
    "stochastic": (_indicator(momentum.stochastic, "stoch_k", "stoch_d"), _sql(_STOCH, "k3", stoch_k=_round("k"), stoch_d=_round("d"))),
    "williams_r": (_indicator(momentum.williams_r, "williams_r_14"), _sql(f"e AS (SELECT *, min(low) OVER {_r(14)} AS ll, max(high) OVER {_r(14)} AS hh FROM b)", "e", williams_r_14=_full(14, "CASE WHEN abs(hh - ll) < 1e-10 THEN -50 ELSE -100 * (hh - close) / (hh - ll) END"))),
    "roc": (_indicator(momentum.roc, "roc_12"), _sql(f"e AS (SELECT *, lag(close, 12) OVER ({_O}) AS x FROM b)", "e", roc_12=_round("CASE WHEN abs(x) >= 1e-10 THEN 100 * (close - x) / x END"))),
    "atr": (_indicator(volatility.atr, "atr_14"), _sql(f"{_TR}, {_lists(xs='t').format('tr')}", "l", atr_14=_full(14, _wilder("xs", 14)))),
    "bollinger": (
        _indicator(volatility.bollinger, "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_pct_b"),
        _sql(_BB, "e", bb_upper=_full(20, "mid + sp"), bb_middle=_full(20, "mid"), bb_lower=_full(20, "mid - sp"), bb_width=_full(20, "CASE WHEN abs(mid) >= 1e-10 THEN (mid + sp - (mid - sp)) / mid END"), bb_pct_b=_full(20, "CASE WHEN mid + sp - (mid - sp) > 1e-10 THEN (close - (mid - sp)) / (mid + sp - (mid - sp)) ELSE 0.5 END")),
    ),
    "keltner": (
        _indicator(volatility.keltner, "kc_upper", "kc_middle", "kc_lower"),
        _sql(f"{_TR}, {_lists(xs='close', ts_='t').format('tr')}, e AS (SELECT *, {_ema('xs', 20)} AS mid, 2 * {_wilder('ts_', 10)} AS band FROM l)", "e", kc_upper=_full(20, "mid + band"), kc_middle=_full(20, "mid"), kc_lower=_full(20, "mid - band")),
    ),
    "donchian": (_indicator(volatility.donchian, "dc_upper", "dc_middle", "dc_lower", "dc_width"), _sql(f"e AS (SELECT *, max(high) OVER {_r(20)} AS u, min(low) OVER {_r(20)} AS d FROM b)", "e", dc_upper=_full(20, "u"), dc_middle=_full(20, "(u + d) / 2"), dc_lower=_full(20, "d"), dc_width=_full(20, "u - d"))),
    "obv": (_indicator(volume.obv, "obv"), _sql(obv=_round(_OBV))),
    "vwap_cumulative": (_indicator(volume.vwap, "vwap"), _sql(vwap=_round(f"sum(tp * volume) OVER ({_O}) / sum(volume) OVER ({_O})"))),
    # Two-decimal prices over counts up to 128 end within nine places, so no value lies halfway between two roundings.
    "vwap_rolling": (
        lambda s, d: volume.vwap(event_bars(s, d), "rolling", 10).select("symbol", seconds(), plain("vwap", 9).alias("vwap")),
        _sql(vwap=f"CASE WHEN rn >= 10 THEN round(sum(tp * volume) OVER {_r(10)} / sum(volume) OVER {_r(10)}, 9) + 0.0 END"),
    ),
    "vwap_session": (_indicator(lambda x: volume.vwap(x, "session"), "vwap"), _sql(vwap=_round("sum(tp * volume) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) / sum(volume) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)"))),
    "mfi": (_indicator(volume.mfi, "mfi_14"), _sql(_MFI, "w", mfi_14=_full(15, _MFI_VALUE))),
    "cmf": (_indicator(volume.cmf, "cmf_20"), _sql("e AS (SELECT *, CASE WHEN abs(high - low) < 1e-10 THEN 0 ELSE (2 * close - high - low) / (high - low) END AS clv FROM b)", "e", cmf_20=_full(20, f"sum(clv * volume) OVER {_r(20)} / sum(volume) OVER {_r(20)}"))),
    "log_return": (
        _scaled(lambda: transforms.LogReturn()),
        _sql(f"e AS (SELECT *, lag(volume) OVER ({_O}) AS pv FROM b)", "e WINDOW w AS (PARTITION BY symbol ORDER BY ts)", **{c: _round(_events(c)) for c in _PRICES[:4]}, volume=_round(_LOGV)),
    ),
    "zscore": (_scaled(transforms.Normalization), _zscores(False)),
    "zscore_by_symbol": (_scaled(lambda: transforms.Normalization(per_series=True)), _zscores_by_symbol(False)),
    "robust_by_symbol": (_scaled(lambda: transforms.RobustNormalization(per_series=True)), _zscores_by_symbol(True)),
    "scale_by_symbol_inverse": (_scaled(lambda: transforms.Normalization(per_series=True), True), _zscores(False, True)),
    "zscore_inverse": (_scaled(transforms.Normalization, True), _zscores(False, True)),
    "robust_scale": (_scaled(transforms.RobustNormalization), _zscores(True)),
    "robust_inverse": (_scaled(transforms.RobustNormalization, True), _zscores(True, True)),
    "pipeline_log_robust": (
        _pipeline,
        _sql(
            f"e AS (SELECT *, lag(volume) OVER ({_O}) AS pv FROM b), g AS (SELECT symbol, ts, coalesce(CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END, 0) AS c, coalesce({_LOGV}, 0) AS v FROM e), s AS (SELECT median(c) AS mc, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS sc, median(v) AS mv, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS sv FROM g)",
            "g, s",
            close=_round("(c - mc) / CASE WHEN sc > 0 THEN sc ELSE 1 END"),
            volume=_round("(v - mv) / CASE WHEN sv > 0 THEN sv ELSE 1 END"),
        ),
    ),
    "series_stats": (_series_stats, f"{_BARS} SELECT symbol, count(*) AS n, CAST(0 AS BIGINT) AS n_missing, false AS has_missing, round(sum(close), 6) AS total, round(avg(close), 6) AS mean, round(min(close), 6) AS least, round(max(close), 6) AS most, round(arg_min(close, ts), 6) AS first, round(arg_max(close, ts), 6) AS last FROM b GROUP BY symbol"),
    "quantiles": (_quantiles, f"{_BARS} SELECT symbol, " + ", ".join(f"round(quantile_cont(close, {q}), 6) AS q{i}" for i, q in enumerate((0.1, 0.25, 0.5, 0.75))) + " FROM b GROUP BY symbol"),
    "frame_ops": (_frame_ops, _sql(close=_round("close"), reach=_round("high - low"), twice=_round("2 * (high - low)"))),
    "concat_join": (_concat, _sql(close=_round("close"), volume=_round("volume"))),
    "head_tail": (_head_tail, f"{_BARS}, e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM b) SELECT {_KEY}, round(close, 6) AS close FROM e WHERE rn <= 3 UNION ALL SELECT {_KEY}, round(close, 6) AS close FROM e WHERE back <= 2"),
    "many_indicators_by_user": (
        _many,
        _sql(
            f"{_STOCH}, {_MFI.replace('FROM b)', 'FROM k3)')}, {_BB.replace('FROM b)', 'FROM w)')}, y AS (SELECT *, CASE WHEN abs(high - low) < 1e-10 THEN 0 ELSE (2 * close - high - low) / (high - low) END AS clv FROM e)",
            "y",
            sma_14=_full(14, f"avg(close) OVER {_r(14)}"),
            bb_upper=_full(20, "mid + sp"),
            dc_width=_full(20, f"max(high) OVER {_r(20)} - min(low) OVER {_r(20)}"),
            williams_r_14=_full(14, "CASE WHEN abs(hh - ll) < 1e-10 THEN -50 ELSE -100 * (hh - close) / (hh - ll) END"),
            stoch_d=_round("d"),
            cmf_20=_full(20, f"sum(clv * volume) OVER {_r(20)} / sum(volume) OVER {_r(20)}"),
            mfi_14=_full(15, _MFI_VALUE),
            obv=_round(_OBV),
        ).replace("event_type AS symbol, date_trunc('hour', ts)", "CAST(user_id AS VARCHAR) AS symbol, date_trunc('day', ts)"),
    ),
    "order_bars_sma": (
        _order_sma,
        f"WITH bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2), b AS (SELECT *, row_number() OVER ({_O}) AS rn FROM bars) SELECT {_KEY}, round(open, 6) AS open, round(close, 6) AS close, volume, CASE WHEN rn >= 5 THEN round(avg(close) OVER {_r(5)}, 6) END AS sma_5 FROM b",
    ),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items()}
