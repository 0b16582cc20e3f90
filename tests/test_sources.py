"""Sources and sinks: round trips, checks and orders."""

import pytest
from pyspark.sql import functions as F

from barline.errors import DuplicateColumn, InvalidParameter, MissingColumn
from barline.operators import trend
from barline.sources import bars as sources


def test_json_round_trip(spark, tmp_path):
    made = trend.sma(sources.synthetic_bars(spark, 20, 2), 5)
    sources.write_json_bars(made, str(tmp_path / "golden"), ["sma_5"])
    back = sources.read_json_bars(spark, str(tmp_path / "golden"))
    want = {(r.symbol, i): r for s in ("s0", "s1") for i, r in enumerate(made.where(F.col("symbol") == s).orderBy("ts").collect())}
    got = {(r.symbol, r.ts): r for r in back.collect()}
    assert set(got) == set(want) and len(got) == 40
    for k, r in got.items():
        assert all(r[c] == want[k][c] for c in ("open", "high", "low", "close", "volume"))
    expected = {(r.symbol, r.position): r.value for r in sources.read_expected(spark, str(tmp_path / "golden")).where("name = 'sma_5'").collect()}
    assert expected == {k: r.sma_5 for k, r in want.items()}


def test_golden_file(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"description": "x", "ohlcv": {"open": [1, 2], "high": [2, 3], "low": [0.5, 1], "close": [1.5, null], "volume": [10, 20]}, "expected": {"obv": [0, null], "sma": [null, 2.5]}}')
    rows = sources.read_json_bars(spark, str(tmp_path / "one.json"), "x").orderBy("ts").collect()
    assert [tuple(r) for r in rows] == [("x", 0, 1.0, 2.0, 0.5, 1.5, 10.0), ("x", 1, 2.0, 3.0, 1.0, None, 20.0)]
    found = {(r.name, r.position): r.value for r in sources.read_expected(spark, str(tmp_path / "one.json")).collect()}
    assert found == {("obv", 0): 0.0, ("obv", 1): None, ("sma", 0): None, ("sma", 1): 2.5}


def test_columns(spark):
    made = sources.from_columns(spark, {"close": [1.0, float("nan"), None], "volume": [1, 2, 3]})
    assert [tuple(r) for r in made.orderBy("ts").collect()] == [("s", 0, 1.0, 1.0), ("s", 1, None, 2.0), ("s", 2, None, 3.0)]
    assert sources.from_columns(spark, {"close": []}).count() == 0
    with pytest.raises(InvalidParameter):
        sources.from_columns(spark, {"close": [1.0], "volume": []})
    with pytest.raises(DuplicateColumn):
        sources.from_columns(spark, {"close": [1.0], "Close": [1.0]})


def test_time_column(spark):
    df = spark.sql("select timestamp'2024-01-01' as Timestamp, 1.0 as close")
    assert sources.time_column(df) == "Timestamp"
    assert sources.time_column(spark.sql("select timestamp'2024-01-01' as begun, 1.0 as close")) == "begun"
    with pytest.raises(InvalidParameter):
        sources.time_column(spark.sql("select 1 as a"))
    with pytest.raises(MissingColumn):
        sources.time_column(df, "when")


def test_missing_prices_make_no_bar_values(spark):
    ticks = spark.sql("select * from values ('a', timestamp'2024-01-01 10:00:00', double('nan')), ('a', timestamp'2024-01-01 10:10:00', 2d), ('a', timestamp'2024-01-01 10:20:00', 1d) as t(symbol, ts, price)")
    row = sources.bars(ticks).first()
    assert (row.high, row.low, row.close, row.volume) == (2.0, 1.0, 1.0, 3.0)


def test_database_rows_come_in_rising_time(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    made = spark.sql("select if(id % 2 = 0, 'a', 'b') as symbol, timestamp_seconds(id * 3600) as open_time, cast(id as double) as close from range(20)")
    try:
        made.write.format("jdbc").options(url=url, dbtable="ohlcv", createTableColumnTypes="symbol VARCHAR(10)", **options).save()
    except Exception as e:  # this Spark comes without that database
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no database")
        raise
    rows = sources.read_jdbc_bars(spark, url, "ohlcv", "a", 3, **options).collect()
    assert [r.close for r in rows] == [14.0, 16.0, 18.0] and [r.ts for r in rows] == sorted(r.ts for r in rows)
