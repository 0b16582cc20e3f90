"""Typed states: restarts, hand-over from a table, and the state reader."""

import pytest
from pyspark.sql import functions as F

from barline.errors import InvalidParameter
from barline.sources.bars import synthetic_bars
from barline.streaming import live, stateful

ALL = {
    "sma": live.Sma(5), "wma": live.Wma(5), "roc": live.Roc(4), "macd": live.Macd(3, 6, 4), "adx": live.Adx(5), "aroon": live.Aroon(6), "stoch_rsi": live.StochRsi(5, 3, 2), "stoch": live.Stochastic(5, 3, 2),
    "williams_r": live.WilliamsR(5), "dc": live.Donchian(5), "bb": live.Bollinger(5), "kc": live.Keltner(5, 4), "mfi": live.Mfi(5), "cmf": live.Cmf(5), "vwap_5": live.RollingVwap(5), "vwap": live.Vwap(), "day": live.Vwap(True),
    "obv": live.Obv(), "ema": live.Average(5), "wilder": live.Average(5, "wilder"), "atr": live.Atr(5), "rsi": live.Rsi(5), "log": live.LogReturn(),
}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(made, check, name):
    query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(check)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def collected(spark, out):
    return {(r.symbol, r.ts): tuple(r)[2:] for r in spark.read.parquet(out).collect()}


def to_files(made, check, out):
    query = made.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_history_then_stream_and_restart(rocks, tmp_path):
    bars = synthetic_bars(rocks, 48, 2)
    hour = (F.unix_timestamp("ts") / 3600).cast("long")
    bars = bars.withColumn("close", F.when(hour != 30, F.col("close"))).cache()
    source = str(tmp_path / "in")

    def add(low, high):
        bars.where((hour >= low) & (hour < high)).coalesce(1).write.mode("append").parquet(source)

    add(20, 34)
    stream = rocks.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(source)
    history = stateful.states(bars.where(hour < 20), ALL)
    assert {(r.symbol, r.bars, r.dropped) for r in history.collect()} == {("s0", 20, 0), ("s1", 20, 0)}
    check, out = str(tmp_path / "check"), str(tmp_path / "out")
    to_files(stateful.stateful_indicators(stream, ALL, initial=history), check, out)
    add(34, 48)
    add(40, 42)  # bars that were there before
    to_files(stateful.stateful_indicators(stream, ALL, initial=history), check, out)
    got = collected(rocks, out)
    whole = str(tmp_path / "whole")
    bars.coalesce(1).write.parquet(whole)
    run(live.live_indicators(rocks.readStream.schema(bars.schema).parquet(whole), ALL), tmp_path / "check2", "unbroken")
    want = {(r.symbol, r.ts): tuple(r)[2:] for r in rocks.sql("select * from unbroken").where(hour >= 20).collect()}
    assert set(got) == set(want) and len(got) == 56
    for key, row in want.items():
        for a, b in zip(got[key], row):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-9), (key, got[key], row)

    def state(name):
        return rocks.read.format("statestore").option("path", check).option("stateVarName", name).load()

    current = {(r.key.symbol, r.user_map_key.name): r.user_map_value for r in state("current").collect()}
    last = max(t for s, t in got if s == "s0")
    names = [f.name for f in rocks.read.parquet(out).schema.fields][2:]
    row = dict(zip(names, got["s0", last]))
    assert current["s0", "sma"].value == pytest.approx(row["sma"]) and current["s0", "sma"].ready
    assert not current["s1", "ema"].ready and row["ema"] is None  # the missing close ended it
    progress = {r.key.symbol: r.value for r in state("progress").collect()}
    assert progress["s0"].bars == 48 and progress["s0"].dropped == 2


def test_store_is_asked_for(spark):
    with pytest.raises(InvalidParameter):
        stateful.stateful_indicators(synthetic_bars(spark, 3, 1), {"sma": live.Sma(2)})
    assert stateful.states(synthetic_bars(spark, 3, 1).limit(0), {"sma": live.Sma(2)}).count() == 0
