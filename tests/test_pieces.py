"""Kernels against plain windows; every indicator in pieces, in kernels and in Spark's windows gives the same."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import rolling as columns_of
from barline.operators import momentum, programs, rolling, trend, volatility, volume
from barline.plans import rolls
from barline.plans.scan import levels


def plain(kind, w, n):
    if kind == "sum_there":
        return np.nansum(w) if not np.isnan(w).all() else math.nan
    if kind == "first":
        return w[0]
    if kind == "rows":
        return n
    if np.isnan(w).any():
        return math.nan
    return {
        "sum": lambda: math.fsum(w), "mean": lambda: math.fsum(w) / n, "variance": lambda: w.var(ddof=1), "population_variance": lambda: w.var(), "std": lambda: w.std(ddof=1), "max": lambda: w.max(), "min": lambda: w.min(),
        "wma": lambda: (w * np.arange(1, n + 1)).sum() / (n * (n + 1) / 2), "since_max": lambda: n - 1 - np.flatnonzero(w == w.max())[-1], "since_min": lambda: n - 1 - np.flatnonzero(w == w.min())[-1],
    }[kind]()


@pytest.mark.parametrize("kind", sorted(rolls.KERNELS))
def test_kernels(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 50):
        if n == 1 and kind in ("variance", "std"):
            continue
        for size in (0, 1, 2, 5, 49, 50, 51, 157):
            x = np.round(rng.normal(100, 5, size))
            x[rng.random(size) < 0.03] = math.nan
            want = [plain(kind, x[i - n + 1 : i + 1], n) if i >= n - 1 else math.nan for i in range(size)]
            assert np.allclose(rolls.KERNELS[kind](x, n), want, rtol=1e-11, atol=1e-9, equal_nan=True)


def test_kernels_lose_nothing_on_large_prices():
    x = 1e6 + np.cumsum(np.random.default_rng(4).normal(0, 1, 200_000))
    for n in (20, 2000):
        for i in (n - 1, 99_999, 199_999):
            w = x[i - n + 1 : i + 1]
            mean = math.fsum(w) / n
            assert abs(rolls.rolling_mean(x, n)[i] - mean) < 1e-9
            assert abs(rolls.rolling_variance(x, n)[i] - math.fsum((v - mean) ** 2 for v in w) / (n - 1)) < 1e-8
            assert abs(rolls.rolling_wma(x, n)[i] - math.fsum(v * (k + 1) for k, v in enumerate(w)) / (n * (n + 1) / 2)) < 1e-8


def test_steps_in_levels():
    steps = list(programs.atr(5).steps) + list(programs.cmf(4).steps)
    assert [[s.out for s in level] for level in levels(steps)] == [["__lag1_close", "__tr"], ["atr_5", "__located", "__located4", "__volume4", "cmf_4"]]


EVERY = [
    (lambda x, **k: trend.sma(x, 5, **k), ["sma_5"]), (lambda x, **k: trend.ema(x, 5, **k), ["ema_5"]), (lambda x, **k: trend.wilder(x, 5, **k), ["wilder_5"]), (lambda x, **k: trend.wma(x, 5, **k), ["wma_5"]),
    (lambda x, **k: trend.macd(x, 3, 6, 4, **k), ["macd", "macd_signal", "macd_histogram"]), (lambda x, **k: trend.adx(x, 5, **k), ["adx", "plus_di", "minus_di"]), (lambda x, **k: trend.aroon(x, 6, **k), ["aroon_up", "aroon_down", "aroon_oscillator"]),
    (lambda x, **k: momentum.rsi(x, 5, **k), ["rsi_5"]), (lambda x, **k: momentum.stoch_rsi(x, 5, 3, 2, **k), ["stoch_rsi", "stoch_rsi_k", "stoch_rsi_d"]), (lambda x, **k: momentum.stochastic(x, 5, 3, 2, **k), ["stoch_k", "stoch_d"]),
    (lambda x, **k: momentum.williams_r(x, 5, **k), ["williams_r_5"]), (lambda x, **k: momentum.roc(x, 4, **k), ["roc_4"]), (lambda x, **k: volatility.atr(x, 5, **k), ["atr_5"]),
    (lambda x, **k: volatility.bollinger(x, 5, **k), ["bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_pct_b"]), (lambda x, **k: volatility.keltner(x, 5, 4, **k), ["kc_upper", "kc_middle", "kc_lower"]),
    (lambda x, **k: volatility.donchian(x, 5, **k), ["dc_upper", "dc_middle", "dc_lower", "dc_width"]), (volume.obv, ["obv"]), (volume.vwap, ["vwap"]), (lambda x, **k: volume.vwap(x, "session", out="day", **k), ["day"]),
    (lambda x, **k: volume.vwap(x, "rolling", 5, out="roll", **k), ["roll"]), (lambda x, **k: volume.mfi(x, 5, **k), ["mfi_5"]), (lambda x, **k: volume.cmf(x, 5, **k), ["cmf_5"]),
]
STUDY = [
    programs.rolling("mean", 5, out="sma_5"), programs.average("ema", 5), programs.average("wilder", 5), programs.rolling("wma", 5), programs.macd(3, 6, 4), programs.adx(5), programs.aroon(6), programs.rsi(5), programs.stoch_rsi(5, 3, 2), programs.stochastic(5, 3, 2),
    programs.williams_r(5), programs.roc(4), programs.atr(5), programs.bollinger(5), programs.keltner(5, 4), programs.donchian(5), programs.obv(), programs.vwap(), programs.vwap("session", out="day"), programs.vwap("rolling", 5, "roll"), programs.mfi(5), programs.cmf(5),
]


@pytest.fixture(scope="module")
def gappy(spark):
    """Bars with quiet hours and values that are null, NaN or infinite, of two symbols and of none."""
    rng = random.Random(6)
    rows = []
    for symbol in ("a", "b", None):
        price = 100.0
        for i in range(90):
            price *= math.exp(rng.gauss(0, 0.02)) if i not in range(30, 44) else 1.0
            spread = rng.random() if i not in range(30, 44) else 0.0
            bar = [price, price + spread, price - spread, price + spread * (rng.random() - 0.5), 0.0 if i in range(33, 42) else 1000 + 1000 * rng.random()]
            for k in range(5):
                if i in (0, 1) or (i > 45 and rng.random() < 0.01):
                    bar[k] = rng.choice([None, math.nan, math.inf])
            rows.append((symbol, i * 3600, *bar))
    df = spark.createDataFrame(rows, "symbol string, s long, open double, high double, low double, close double, volume double")
    return df.select("symbol", F.timestamp_seconds("s").alias("ts"), "open", "high", "low", "close", "volume").cache()


def by_row(df, names):
    return {(r.symbol, r.ts): tuple(r[n] for n in names) for r in df.collect()}


def alike(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        for a, b in zip(got[key], row):
            assert (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-7)), (key, got[key], row)


def test_pieces_kernels_and_windows_agree(spark, gappy, monkeypatch):
    names = [n for _, own in EVERY for n in own]
    each = gappy
    for add, _ in EVERY:
        each = add(each)
    want = by_row(each, names)
    alike(by_row(programs.study(gappy, STUDY), names), want)
    for unit in ("day", "hour"):
        alike(by_row(programs.study(gappy, STUDY, pieces=unit), names), want)
    monkeypatch.setattr(programs, "WIDE", 0)
    kernels = gappy
    for add, _ in EVERY:
        kernels = add(kernels)
    alike(by_row(kernels, names), want)
    # With nulls in place of NaN and infinite values, nothing changes.
    nulls = gappy.select("symbol", "ts", *[F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    alike(by_row(programs.study(nulls, STUDY), names), want)


def test_each_indicator_alone_in_pieces(spark, gappy):
    for add, names in EVERY[:4] + EVERY[13:14] + EVERY[18:20]:
        alike(by_row(add(gappy, pieces="day"), names), by_row(add(gappy), names))


def test_running_values_in_pieces(spark, gappy):
    x = F.when(F.abs("close") < float("inf"), F.col("close"))
    made = gappy.withColumns({"filled": columns_of.ffill(F.col("close")), "d": columns_of.diff(F.col("close"), 7), "p": columns_of.pct_change(F.col("close"), 2), "s": columns_of.shift(F.col("close"), 30)})
    made = made.withColumn("total", F.sum(x).over(columns_of.BARS.so_far()))
    want = by_row(made, ["filled", "total", "d", "p", "s"])
    for unit in (None, "day", "hour"):
        got = rolling.running_sum(rolling.ffill(gappy, pieces=unit), pieces=unit)
        got = rolling.shift(rolling.pct_change(rolling.diff(got, 7, pieces=unit), 2, pieces=unit), 30, pieces=unit)
        alike(by_row(got, ["ffill", "running_sum", "diff_7", "pct_change_2", "shift_30"]), want)


def test_wide_windows(spark):
    from barline.sources.bars import synthetic_bars

    df = synthetic_bars(spark, 1300, 1)
    closes = [r.close for r in df.orderBy("ts").collect()]
    got = {r.ts: r for r in volatility.bollinger(trend.wma(trend.sma(df, 1000), 1000), 1000).collect()}
    last = got[max(got)]
    w = closes[-1000:]
    assert last.sma_1000 == pytest.approx(sum(w) / 1000) and last.wma_1000 == pytest.approx(sum(v * (i + 1) for i, v in enumerate(w)) / 500500)
    deviation = math.sqrt(sum((v - sum(w) / 1000) ** 2 for v in w) / 999)
    assert last.bb_upper == pytest.approx(sum(w) / 1000 + 2 * deviation)
    column = {r.ts: r.x for r in df.withColumn("x", columns_of.wma(F.col("close"), 300)).collect()}
    table = {r.ts: r.wma_300 for r in trend.wma(df, 300).collect()}
    assert all((a is None and table[k] is None) or a == pytest.approx(table[k]) for k, a in column.items()) and column[max(column)] is not None


def test_studies_share_steps_and_check_columns(spark, gappy):
    from barline.errors import MissingColumn

    plan = programs.study(gappy, STUDY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    with pytest.raises(MissingColumn):
        programs.study(gappy.drop("volume"), [programs.obv()])
    assert programs.study(gappy.limit(0), STUDY).count() == 0 and programs.study(gappy.limit(0), STUDY[:3], pieces="day").count() == 0
    assert programs.study(gappy, [programs.rolling("mean", 200)], fillna=True).agg(F.max("mean_200")).first()[0] == 0
