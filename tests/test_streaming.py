"""Indicators on a stream give what they give on a table."""

import pytest
from pyspark.sql import functions as F

from barline.operators import momentum, trend, volatility, volume
from barline.streaming import live
from barline.sources.bars import synthetic_bars


def test_stream_equals_batch(spark, tmp_path):
    bars = synthetic_bars(spark, 60, 2).cache()
    for i in range(3):
        part = bars.where((F.unix_timestamp("ts") / 3600 >= 20 * i) & (F.unix_timestamp("ts") / 3600 < 20 * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = live.live_indicators(source, {"ema": live.Average(5), "wilder": live.Average(5, "wilder"), "rsi": live.Rsi(5), "atr": live.Atr(5), "obv": live.Obv(), "vwap": live.Vwap()})
    query = made.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = volume.vwap(volume.obv(volatility.atr(momentum.rsi(trend.wilder(trend.ema(bars, 5), 5), 5), 5)))
    want = {(r.symbol, r.ts): (r.ema_5, r.wilder_5, r.rsi_5, r.atr_5, r.obv, r.vwap) for r in want.collect()}
    got = {(r.symbol, r.ts): (r.ema, r.wilder, r.rsi, r.atr, r.obv, r.vwap) for r in spark.sql("select * from live").collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("gaps", [False, True])
def test_every_indicator_on_a_stream(spark, tmp_path, gaps):
    from barline.operators.transforms import LogReturn

    bars = synthetic_bars(spark, 60, 2)
    # Some bars without range, change or volume.
    hour = (F.unix_timestamp("ts") / 3600).cast("long")
    still = hour.between(22, 38)
    bars = bars.withColumns({c: F.when(still, 100.0).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).withColumn("volume", F.when(hour.between(26, 36), 0.0).otherwise(F.col("volume")))
    if gaps:  # missing values at the start, later, in one column and in all, on the edge of a batch
        gone = {"open": [0, 1, 44], "high": [0, 1, 44, 47], "low": [0, 1, 44, 49], "close": [0, 1, 20, 44], "volume": [0, 12, 44]}
        bars = bars.withColumns({c: F.when(~hour.isin(v), F.col(c)) for c, v in gone.items()})
    bars = bars.cache()
    for i in range(3):
        bars.where((hour >= 20 * i) & (hour < 20 * (i + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_ones = {
        "sma_5": live.Sma(5), "wma_5": live.Wma(5), "roc_4": live.Roc(4), "macd": live.Macd(3, 6, 4), "adx": live.Adx(5), "aroon": live.Aroon(6), "stoch_rsi": live.StochRsi(5, 3, 2),
        "stoch": live.Stochastic(5, 3, 2), "williams_r_5": live.WilliamsR(5), "dc": live.Donchian(5), "bb": live.Bollinger(5), "kc": live.Keltner(5, 4), "mfi_5": live.Mfi(5), "cmf_5": live.Cmf(5),
        "vwap": live.RollingVwap(5), "vwap_all": live.Vwap(), "vwap_day": live.Vwap(True), "obv": live.Obv(), "ema_5": live.Average(5), "wilder_5": live.Average(5, "wilder"), "atr_5": live.Atr(5), "rsi_5": live.Rsi(5), "log_close": live.LogReturn(), "log_volume": live.LogReturn("volume", True),
    }
    query = live.live_indicators(source, live_ones).writeStream.format("memory").queryName(f"every_{gaps}").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = trend.adx(trend.macd(trend.aroon(trend.wma(trend.sma(bars, 5), 5), 6), 3, 6, 4), 5).withColumnsRenamed({"plus_di": "adx_plus_di", "minus_di": "adx_minus_di"})
    want = momentum.williams_r(momentum.stochastic(momentum.stoch_rsi(momentum.roc(want, 4), 5, 3, 2), 5, 3, 2), 5)
    want = volatility.keltner(volatility.bollinger(volatility.donchian(want, 5), 5), 5, 4)
    want = volume.vwap(volume.cmf(volume.mfi(want, 5), 5), "rolling", 5)
    want = volume.obv(volume.vwap(volume.vwap(want, out="vwap_all"), "session", out="vwap_day"))
    want = momentum.rsi(volatility.atr(trend.wilder(trend.ema(want, 5), 5), 5), 5)
    logs = LogReturn(["close", "volume"]).fit(bars).transform(bars).select("symbol", "ts", F.col("close").alias("log_close"), F.col("volume").alias("log_volume"))
    want = {(r.symbol, r.ts): r.asDict() for r in want.join(logs, ["symbol", "ts"]).collect()}
    got = {(r.symbol, r.ts): r.asDict() for r in spark.sql(f"select * from every_{gaps}").collect()}
    assert set(got) == set(want) and len(got) == 120
    for key, row in want.items():
        assert set(row) == set(got[key])
        for name, a in row.items():
            b = got[key][name]
            assert (a is None and b is None) or a == b or (a is not None and b is not None and b == pytest.approx(a, rel=1e-9, abs=1e-6)), (name, key, a, b)


def test_bars_from_ticks(spark, tmp_path):
    ticks = spark.sql("select 's' as symbol, timestamp_seconds(id * 600) as ts, cast(id as double) as price from range(30)")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = live.live_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "1 hour", "1 minute")
    query = made.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = sorted(spark.sql("select * from bars").collect(), key=lambda r: r.ts)
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in rows][:2] == [(0, 5, 0, 5, 6), (6, 11, 6, 11, 6)]
