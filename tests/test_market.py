"""Hand-computed vectors, edge cases and invariants of the market operators."""

import math

import pytest
from pyspark.sql import functions as F

from barline.errors import DuplicateColumn, InvalidParameter, InvalidWindow, InverseNotSupported, MissingColumn, NotFitted, StateVersionError
from barline.functions import price, rolling
from barline.operators import frame, momentum, transforms, trend, volatility, volume

SCHEMA = "symbol string, ts long, open double, high double, low double, close double, volume double"


def bars(spark, close, high=None, low=None, vol=None, symbol="s"):
    high, low, vol = high or close, low or close, vol or [1.0] * len(close)
    return spark.createDataFrame([(symbol, i, float(c), float(h), float(l), float(c), float(v)) for i, (c, h, l, v) in enumerate(zip(close, high, low, vol))], SCHEMA)


def values(df, name):
    return [r[name] for r in df.orderBy("ts").select(name).collect()]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or g == pytest.approx(w, abs=1e-9), (got, want)


def test_averages(spark):
    df = bars(spark, [1, 2, 3, 4, 5])
    same(values(trend.sma(df, 3), "sma_3"), [None, None, 2, 3, 4])
    same(values(trend.sma(df, 3, fillna=True), "sma_3"), [0, 0, 2, 3, 4])
    same(values(trend.ema(df, 3), "ema_3"), [None, None, 2, 3, 4])
    same(values(trend.wma(df, 3), "wma_3"), [None, None, 14 / 6, 20 / 6, 26 / 6])
    same(values(trend.wilder(df, 3), "wilder_3"), [None, None, 2, 8 / 3, 31 / 9])


def test_long_recurrence_matches_loop(spark):
    close = [math.sin(i / 7) * 5 + 100 for i in range(1000)]
    want, y = [None] * 13, sum(close[:14]) / 14
    want.append(y)
    for x in close[14:]:
        y += (x - y) * 2 / 15
        want.append(y)
    same(values(trend.ema(bars(spark, close), 14), "ema_14"), want)


def test_ranges(spark):
    df = bars(spark, [9, 11, 8], [10, 12, 11], [8, 9, 7])
    same(values(df.withColumn("tr", price.true_range()), "tr"), [2, 3, 4])
    df = bars(spark, [103, 106, 108, 110, 113], [105, 108, 110, 112, 115], [98, 101, 104, 106, 109])
    same(values(volatility.atr(df, 3), "atr_3")[:3], [None, None, 20 / 3])


def test_momentum(spark):
    same(values(momentum.roc(bars(spark, [100, 102, 104, 106, 108]), 3), "roc_3"), [None, None, None, 6, 600 / 102])
    got = values(momentum.rsi(bars(spark, [44, 44.25, 44.5, 43.75, 44.5, 44.25, 44, 43.5, 43.75, 44]), 5), "rsi_5")
    assert got[:4] == [None] * 4 and 0 < got[4] < 100
    assert values(momentum.rsi(bars(spark, range(1, 21)), 5), "rsi_5")[-1] == 100
    assert values(momentum.rsi(bars(spark, range(20, 0, -1)), 5), "rsi_5")[-1] == 0


def test_volume(spark):
    same(values(volume.obv(bars(spark, [100, 101, 102, 100, 100, 101], vol=[1000, 1500, 2000, 1000, 500, 2500])), "obv"), [0, 1500, 3500, 2500, 2500, 5000])
    df = bars(spark, [100, 105, 102], [105, 110, 108], [95, 95, 100], [1000, 2000, 1500])
    same(values(volume.vwap(df), "vwap")[:2], [100, (100 * 1000 + 310 / 3 * 2000) / 3000])
    df = bars(spark, [100, 105], [105, 110], [95, 95], [1000, 0])
    same(values(volume.vwap(df, "rolling", 1), "vwap"), [100, 100])
    with pytest.raises(Exception, match="overflow"):
        volume.obv(bars(spark, [1, 2], vol=[1, 2e15])).collect()


def test_constant_prices(spark):
    df = bars(spark, [5.0] * 40)
    assert values(momentum.rsi(df), "rsi_14")[-1] == 50
    made = volatility.bollinger(df)
    assert values(made, "bb_width")[-1] == 0 and values(made, "bb_pct_b")[-1] == 0.5
    assert values(volatility.atr(df), "atr_14")[-1] == 0
    assert values(momentum.roc(df), "roc_12")[-1] == 0
    assert values(momentum.williams_r(df), "williams_r_14")[-1] == -50
    assert values(momentum.stochastic(df), "stoch_k")[-1] == 50
    assert values(momentum.stoch_rsi(df), "stoch_rsi")[-1] == 0.5
    assert values(volume.mfi(df), "mfi_14")[-1] == 50
    assert values(volume.cmf(df), "cmf_20")[-1] == 0
    assert values(trend.adx(df), "adx")[-1] == 0


def test_ties_take_the_latest(spark):
    made = trend.aroon(bars(spark, [1, 3, 2, 3, 1]), 3)
    same(values(made, "aroon_up"), [None, None, None, 100, 100 * 2 / 3])
    same(values(made, "aroon_down"), [None, None, None, 0, 100])


def test_short_missing_and_empty(spark):
    df = bars(spark, [1.0, 2.0])
    for add, name in ((trend.sma, "sma_14"), (trend.ema, "ema_14"), (momentum.rsi, "rsi_14"), (trend.adx, "adx"), (trend.macd, "macd")):
        assert values(add(df), name) == [None, None]
        assert values(add(df.limit(0)), name) == []
    gap = spark.createDataFrame([("s", i, c) for i, c in enumerate([1.0, None, 3.0, 4.0, 5.0])], "symbol string, ts long, close double")
    same(values(gap.withColumn("x", rolling.sma(F.col("close"), 2)), "x"), [None, None, None, 3.5, 4.5])
    same(values(gap.withColumn("x", rolling.ffill(F.col("close"))), "x"), [1, 1, 3, 4, 5])


def test_errors(spark):
    df = bars(spark, [1.0, 2.0])
    for add in (trend.sma, trend.ema, trend.wma, trend.aroon, momentum.rsi, momentum.williams_r, volatility.atr, volatility.donchian, volume.mfi, volume.cmf):
        with pytest.raises(InvalidWindow):
            add(df, 0)
    with pytest.raises(InvalidParameter):
        trend.macd(df, 26, 12)
    with pytest.raises(InvalidParameter):
        volatility.bollinger(df, num_std=0)
    with pytest.raises(MissingColumn):
        trend.sma(df.drop("close"))
    with pytest.raises(DuplicateColumn):
        frame.add_column(df, "close", F.lit(1))
    with pytest.raises(DuplicateColumn):
        frame.concat(df, df)


def test_transforms(spark):
    df = bars(spark, [100, 110, 99, 115])
    made = transforms.LogReturn(["close"]).fit(df).transform(df)
    same(values(made, "close"), [None, math.log(1.1), math.log(0.9), math.log(115 / 99)])
    with pytest.raises(InverseNotSupported):
        transforms.LogReturn().inverse(df)
    with pytest.raises(NotFitted):
        transforms.Normalization().transform(df)
    step = transforms.RobustNormalization(["close"]).fit(bars(spark, range(1, 10)))
    assert step.center("close") == 5 and step.scale("close") == 4
    both = transforms.Pipeline(transforms.Normalization(["close"]), transforms.RobustNormalization(["close"]))
    same(values(both.inverse(both.fit_transform(df)), "close"), [100, 110, 99, 115])
    again = transforms.RobustNormalization().restore(step.state())
    assert again.center("close") == 5
    with pytest.raises(StateVersionError):
        again.restore(step.state().replace('"version": 1', '"version": 0'))


def test_many_series_stay_apart(spark):
    df = bars(spark, [1, 2, 3], symbol="a").union(bars(spark, [10, 20, 30], symbol="b"))
    got = {(r.symbol, r.ts): r.ema_2 for r in trend.ema(df, 2).collect()}
    assert got["a", 1] == 1.5 and got["b", 1] == 15 and got["b", 0] is None


def test_one_exchange_for_many_indicators(spark):
    df = bars(spark, range(50))
    for add in (trend.sma, volatility.bollinger, volatility.donchian, momentum.williams_r, volume.obv, volume.cmf):
        df = add(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pieces_equal_the_whole(spark):
    from barline.plans.scan import Scan, linear_scans
    from barline.sources.bars import synthetic_bars

    scans = [Scan("close", "e", 30, "ema"), Scan("close", "w", 14, "wilder"), Scan("close", "f", 14, "first"), Scan("close", "s", 20, "sum_skip")]
    df = synthetic_bars(spark, 300, 3)
    whole = {(r.symbol, r.ts): (r.e, r.w, r.f, r.s) for r in linear_scans(df, scans).collect()}
    cut = {(r.symbol, r.ts): (r.e, r.w, r.f, r.s) for r in linear_scans(df, scans, pieces="day").collect()}
    assert set(whole) == set(cut)
    for key, want in whole.items():
        same(cut[key], want)


def loop(x, n, kind):
    """A recurrence as a plain loop: leading missing values are passed over, a later one ends it."""
    a, b = {"ema": (1 - 2 / (n + 1), 2 / (n + 1)), "wilder": (1 - 1 / n, 1 / n), "first": (1 - 1 / n, 1 / n), "sum_skip": (1 - 1 / n, 1.0)}[kind]
    first_at = {"ema": n, "wilder": n, "first": 1, "sum_skip": n + 1}[kind]
    out, head, y, ended = [], [], None, False
    for v in x:
        missing = v is None or not math.isfinite(v)
        ended = ended or (missing and bool(head))
        if missing or ended:
            out.append(None)
            continue
        head.append(v)
        if len(head) == first_at:
            y = sum(head[:n]) if kind == "sum_skip" else sum(head) / len(head)
        elif len(head) > first_at:
            y = a * y + b * v
        out.append(y)
    return out


GAPS = {
    "none": [],
    "first row": [0],
    "leading": [0, 1, 2, 3],
    "middle": [200],
    "at a piece's start": [100],
    "at a piece's end": [99],
    "a whole piece": list(range(50, 100)),
    "leading pieces": list(range(0, 120)),
    "before the seed": [3],
    "all": list(range(260)),
}


@pytest.mark.parametrize("kind", ["ema", "wilder", "first", "sum_skip"])
def test_recurrences_with_missing_values(spark, kind):
    from barline.plans.scan import Scan, linear_scans

    rows, want = [], {}
    for name, gone in GAPS.items():
        x = [100 + 5 * math.sin(i / 7) + i % 3 for i in range(260)]
        for k, i in enumerate(gone):
            x[i] = (None, float("nan"), float("inf"))[k % 3]
        want[name] = loop(x, 14, kind)
        rows += [(name, i, v, 9007199254740993 if i % 2 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double, tag long")
    for pieces in (None, 50):
        made = linear_scans(df, [Scan("close", "y", 14, kind)], pieces=pieces).orderBy("symbol", "ts").collect()
        assert len(made) == len(rows)
        assert {r.tag for r in made} == {None, 9007199254740993}
        for name in GAPS:
            got = [r.y for r in made if r.symbol == name]
            assert [v is None for v in got] == [v is None for v in want[name]], (name, pieces)
            same(got, want[name])


def test_pieces_give_the_same_indicators(spark):
    from barline.sources.bars import synthetic_bars

    df = synthetic_bars(spark, 3000, 2)  # four months of hours
    df = df.withColumn("close", F.when((F.col("symbol") == "s0") | (F.col("ts") < "1970-03-10") | (F.col("ts") > "1970-03-11"), F.col("close")))
    for add, names in (
        (trend.ema, ["ema_14"]),
        (trend.wilder, ["wilder_14"]),
        (trend.macd, ["macd", "macd_signal", "macd_histogram"]),
        (trend.adx, ["adx", "plus_di", "minus_di"]),
        (momentum.rsi, ["rsi_14"]),
        (momentum.stoch_rsi, ["stoch_rsi", "stoch_rsi_d"]),
        (volatility.atr, ["atr_14"]),
        (volatility.keltner, ["kc_upper", "kc_lower"]),
    ):
        whole = {(r.symbol, r.ts): r for r in add(df).select("symbol", "ts", *names).collect()}
        cut = {(r.symbol, r.ts): r for r in add(df, pieces="month").select("symbol", "ts", *names).collect()}
        assert len(whole) == len(cut) == 6000
        for k, r in whole.items():
            same([cut[k][n] for n in names], [r[n] for n in names])


def test_null_series_and_order(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(5)] + [("a", None, 9.0), ("a", 0, 1.0), ("a", 1, 3.0)], "symbol string, ts long, close double")
    for pieces in (None, 2):
        made = {(r.symbol, r.ts): r.ema_2 for r in trend.ema(df, 2, pieces=pieces).collect()}
        assert len(made) == 8
        assert made[(None, 1)] == 0.5 and made[("a", None)] is None and made[("a", 0)] == 5.0


def test_exact_quantiles(spark):
    from barline.operators import quantiles

    rows = [("big", float(i % 1000)) for i in range(90_000)] + [("hot", 7.0)] * 90_000 + [("hot", 8.0)] * 10 + [("small", v) for v in (1.0, 2.0, None, float("nan"), 4.0)] + [("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, x double")
    levels = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {r.symbol: [r[f"q{i}"] for i in range(6)] for r in quantiles.exact_quantiles(df, ["symbol"], "x", levels).collect()}
    want = {r.symbol: [r[f"q{i}"] for i in range(6)] for r in df.where("not isnan(x)").groupBy("symbol").agg(*[F.percentile("x", p).alias(f"q{i}") for i, p in enumerate(levels)]).collect()}
    assert got.pop("none") == [None] * 6
    want.pop("none", None)
    assert set(got) == set(want)
    for k in want:
        same(got[k], want[k])
    assert quantiles.exact_quantiles(df.limit(0), ["symbol"], "x", levels).count() == 0


def test_states(spark):
    df = bars(spark, [1, 2, 4, 8, 16], vol=[1, 2, 3, 4, 5])
    steps = transforms.Pipeline(transforms.LogReturn(["close"], fill=0.0), transforms.Normalization(["close"]))
    want = values(steps.fit_transform(df), "close")
    other = transforms.Pipeline(transforms.LogReturn(), transforms.Normalization()).restore(steps.state())
    same(values(other.transform(df), "close"), want)
    assert steps.output_columns(df.columns) == df.columns
    steps.reset()
    with pytest.raises(NotFitted):
        steps.state()
    with pytest.raises(NotFitted):
        steps.steps[0][1].transform(df)
    with pytest.raises(InvalidParameter):
        transforms.Pipeline(transforms.LogReturn()).restore(other.state())
    with pytest.raises(StateVersionError):
        transforms.LogReturn().restore(transforms.Normalization(["close"]).fit(df).state())


def test_saved_regression_cases(spark):
    # 30 equal bars without volume, window 8; 20 bars whose first three volumes are 0, window 5.
    df = bars(spark, [0.01] * 30, vol=[0.0] * 30)
    assert set(values(volume.cmf(df, 8), "cmf_8")) == {None, 0.0}
    assert set(values(volume.mfi(df, 8), "mfi_8")) == {None, 50.0}
    assert set(values(volume.vwap(df, "rolling", 8), "vwap")) == {None}
    close = [100 + 7 * math.sin(i * 1.7) for i in range(20)]
    df = bars(spark, close, [c * 1.05 for c in close], [c * 0.95 for c in close], [0.0] * 3 + [1000.0 + i for i in range(17)])
    assert all(x is None or -1 <= x <= 1 for x in values(volume.cmf(df, 5), "cmf_5"))
    assert all(x is None or 0 <= x <= 100 for x in values(volume.mfi(df, 5), "mfi_5"))


def test_min_periods(spark):
    from barline.functions.periods import min_periods
    from barline.sources.bars import synthetic_bars

    df = synthetic_bars(spark, 80)
    for name, add, columns, parameters in (
        ("sma", trend.sma, ["sma_14"], {}),
        ("ema", lambda x: trend.ema(x, 9), ["ema_9"], {"n": 9}),
        ("macd", trend.macd, ["macd", "macd_signal", "macd_histogram"], {}),
        ("adx", trend.adx, ["adx", "plus_di", "minus_di"], {}),
        ("aroon", trend.aroon, ["aroon_up", "aroon_down"], {}),
        ("rsi", momentum.rsi, ["rsi_14"], {}),
        ("stoch_rsi", momentum.stoch_rsi, ["stoch_rsi", "stoch_rsi_k", "stoch_rsi_d"], {}),
        ("stochastic", momentum.stochastic, ["stoch_k", "stoch_d"], {}),
        ("roc", momentum.roc, ["roc_12"], {}),
        ("keltner", volatility.keltner, ["kc_upper", "kc_lower"], {}),
        ("mfi", volume.mfi, ["mfi_14"], {}),
        ("obv", volume.obv, ["obv"], {}),
    ):
        missing = values(add(df).withColumn("missing", price.any_missing(*columns)), "missing")
        assert missing.index(False) + 1 == min_periods(name, **parameters), name
    with pytest.raises(InvalidParameter):
        min_periods("nothing")


def test_positions(spark):
    df = bars(spark, [5, 6, 7])
    same(values(frame.map_indexed(df, "close", lambda i, x: 10 * i + x), "close"), [5, 16, 27])
    same(values(frame.map_column(df, "close", lambda x: x * 2), "close"), [10, 12, 14])
    assert values(frame.at(df, 0), "close") == [5] and values(frame.at(df, -1), "close") == [7] and values(frame.at(df, 3), "close") == []
    same(values(df.withColumn("x", rolling.oldest(F.col("close"), 2)), "x"), [None, 5, 6])


def test_fits_by_series(spark):
    import json

    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, float("nan")), ("b", 1, 10.0), ("b", 2, 10.0), (None, 1, 5.0), (None, 2, 9.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double")
    root = math.sqrt(2)
    for step, want in ((transforms.Normalization(["close"], per_series=True), {("a", 1): -1 / root, ("a", 2): 1 / root, ("b", 1): 0, (None, 2): 1 / root}), (transforms.RobustNormalization(["close"], per_series=True), {("a", 1): -1, ("a", 2): 1, ("b", 2): 0, (None, 1): -1})):
        made = {(r.symbol, r.ts): r.close for r in step.fit(df).transform(df).collect()}
        assert len(made) == 8 and made["c", 1] is None
        assert all(made[k] == pytest.approx(v) for k, v in want.items())
        again = type(step)(["close"], per_series=True).restore(step.state())
        assert {(r.symbol, r.ts): r.close for r in again.transform(df).collect() if r.ts != 3} == {k: v for k, v in made.items() if k[1] != 3}
        back = {(r.symbol, r.ts): r.close for r in step.inverse(step.transform(df)).collect()}
        assert back["a", 2] == pytest.approx(3) and back[None, 1] == pytest.approx(5)
        new = spark.createDataFrame([("new", 1, 4.0)], df.schema)
        assert step.transform(new).first().close is None
        with pytest.raises(InvalidParameter):
            type(step)(["close"]).restore(step.state())
        assert json.loads(step.state())["names"] == ["close"]
    both = transforms.Pipeline(transforms.Normalization(["close"], per_series=True), transforms.RobustNormalization(["close"], per_series=True))
    got = {(r.symbol, r.ts): r.close for r in both.inverse(both.fit_transform(df)).collect()}
    assert got["a", 1] == pytest.approx(1) and got["b", 2] == pytest.approx(10)
    step.reset()
    with pytest.raises(NotFitted):
        step.transform(df)
