"""Table functions in SQL, functions of arrays, and bars of a stream with volumes and ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import frame, momentum, trend, volatility, volume
from barline.plans import table_functions
from barline.sources.bars import bars, synthetic_bars


def by_row(df, *names):
    return {(r.symbol, r.ts): tuple(r[n] for n in names) for r in df.collect()}


def alike(got, want):
    assert set(got) == set(want) and got
    for k, row in want.items():
        for a, b in zip(got[k], row):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-7), (k, got[k], row)


def test_table_functions(spark):
    df = synthetic_bars(spark, 60, 2)
    df = df.withColumn("close", F.when(F.unix_timestamp("ts") == 36000, F.lit(math.nan)).otherwise(F.col("close")))
    df.createOrReplaceTempView("sql_bars")
    table_functions.register(spark)

    def call(text):
        return spark.sql(f"SELECT * FROM {text.replace('()', 'TABLE(sql_bars) PARTITION BY symbol ORDER BY (ts)')}")

    made = call("ema((), 14)")
    assert made.columns == [*df.columns, "ema"]
    alike(by_row(made, "ema"), by_row(trend.ema(df, 14), "ema_14"))
    alike(by_row(call("macd((), 3, 6, 4)"), "macd", "macd_signal", "macd_histogram"), by_row(trend.macd(df, 3, 6, 4), "macd", "macd_signal", "macd_histogram"))
    alike(by_row(call("rsi((), 5)"), "rsi"), by_row(momentum.rsi(df, 5), "rsi_5"))
    alike(by_row(call("bollinger((), 5)"), "bollinger_upper"), by_row(volatility.bollinger(df, 5), "bb_upper"))
    alike(by_row(call("obv(())"), "obv"), by_row(volume.obv(df), "obv"))
    assert call("atr((), 3)").where("atr IS NOT NULL").count() > 0
    for bad in ("ema((), 0)", "ema(TABLE(SELECT symbol, ts FROM sql_bars) PARTITION BY symbol ORDER BY (ts), 3)"):
        with pytest.raises(Exception, match="window|close"):
            call(bad)


def test_functions_of_arrays(spark):
    rows = [("s", 1, 1.0), ("s", 2, None), ("s", 3, math.inf), ("s", 4, -4.0), ("t", 1, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, ts long, close double")
    assert by_row(frame.map_values(df, "close", np.sqrt), "close") == {("s", 1): (1.0,), ("s", 2): (None,), ("s", 3): (None,), ("s", 4): (None,), ("t", 1): (3.0,)}
    made = frame.map_values_indexed(df, "close", lambda i, x: np.nan_to_num(x, nan=0.0) + 100 * i)
    assert by_row(made, "close") == {("s", 1): (1.0,), ("s", 2): (100.0,), ("s", 3): (200.0,), ("s", 4): (296.0,), ("t", 1): (9.0,)}
    assert made.columns == df.columns and frame.map_values(df.limit(0), "close", np.sqrt).count() == 0


def test_live_bars_equal_bars(spark, tmp_path):
    from barline.streaming import live

    text = "select 's' as symbol, timestamp_seconds(cast(floor(id / 3) as bigint) * 1200) as ts, id as n, case when id % 7 = 3 then double('NaN') else double(id % 11) end as price, cast(id as double) as amount from range(60)"
    ticks = spark.sql(text)
    ticks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    made = live.live_bars(stream, "1 hour", "1 minute", volume="amount", tie="n")
    query = made.writeStream.format("memory").queryName("tied_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = by_row(spark.sql("select * from tied_bars"), "open", "high", "low", "close", "volume")
    want = by_row(bars(ticks, "hour", volume="amount", tie="n"), "open", "high", "low", "close", "volume")
    assert len(got) >= 5 and all(want[k] == v for k, v in got.items())
