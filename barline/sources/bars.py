"""Bars from ticks, and reading and writing bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barline.errors import DuplicateColumn, InvalidParameter, columns
from barline.functions.windows import BARS, Series, without_nan

BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume"))])
_FIELDS = ("open", "high", "low", "close", "volume")


def bars(ticks: DataFrame, unit: str = "hour", symbol: str = "symbol", ts: str = "ts", price: str = "price", volume: str | None = None, tie: str | None = None) -> DataFrame:
    """One bar per symbol and unit of time. Without a volume column, ticks are counted.

    A single aggregation with map-side partial results; ``tie`` orders ticks of one time.
    NaN prices and volumes count as missing.
    """
    columns(ticks, symbol, ts, price, *([volume] if volume else []), *([tie] if tie else []))
    ticks = without_nan(ticks, *[c for c in (price, volume) if c and dict(ticks.dtypes)[c] in ("double", "float")])
    order = F.struct(ts, tie) if tie else F.col(ts)
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, ts).alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        (F.sum(volume) if volume else F.count(F.lit(1))).cast("double").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str, symbol: str = "event_type", unit: str = "hour") -> DataFrame:
    """Hourly bars of the event values of each event type (or user)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return bars(events.withColumn(symbol, F.col(symbol).cast("string")), unit, symbol, "ts", "value", tie="event_id")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices for each priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return bars(orders, "day", "o_orderpriority", "ts", "o_totalprice", tie="o_orderkey")


def from_columns(spark: SparkSession, columns_: dict[str, list], symbol: str = "s") -> DataFrame:
    """Bars from lists of equal length; ``ts`` is the position unless it is among them. Names are checked, NaN counts as missing.

    For hand-made series of a size that a driver holds; large ones are read by Spark's readers.
    """
    lower = [c.lower() for c in columns_]
    if len(set(lower)) < len(lower):
        raise DuplicateColumn(", ".join(sorted(columns_)))
    sizes = {len(v) for v in columns_.values()}
    if len(sizes) > 1:
        raise InvalidParameter(f"columns of different lengths: {sorted(sizes)}")
    n = sizes.pop() if sizes else 0
    names = [c for c in columns_ if c != "ts"]
    ts = columns_.get("ts", range(n))
    kind = "timestamp" if n and not isinstance(next(iter(ts)), int) else "bigint"
    rows = [(symbol, t, *(None if columns_[c][i] is None else float(columns_[c][i]) for c in names)) for i, t in enumerate(ts)]
    made = spark.createDataFrame(rows, ", ".join(["symbol string", f"ts {kind}", *(f"`{c}` double" for c in names)]))
    return without_nan(made, *names)


def read_json_bars(spark: SparkSession, path: str, symbol: str = "series") -> DataFrame:
    """Bars from files of one object ``{"ohlcv": {"open": [..], ..}}`` each; the position is the order key ``ts``.

    Folders ``symbol=..`` name the series; else all are ``symbol``.
    """
    arrays = T.StructType([T.StructField("ohlcv", T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in _FIELDS]))])
    read = spark.read.schema(arrays).json(path, multiLine=True)
    name = F.col("symbol").cast("string") if "symbol" in read.columns else F.lit(symbol)
    placed = read.select(name.alias("symbol"), F.posexplode(F.arrays_zip(*[F.col(f"ohlcv.{n}").alias(n) for n in _FIELDS])).alias("ts", "bar"))
    return placed.select("symbol", "ts", *[F.col(f"bar.{n}").alias(n) for n in _FIELDS])


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """(name, position, value) of the ``expected`` lists of such files, after the symbol if folders name it."""
    schema = T.StructType([T.StructField("expected", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])
    read = spark.read.schema(schema).json(path, multiLine=True)
    own = ["symbol"] if "symbol" in read.columns else []
    return read.select(*own, F.explode("expected").alias("name", "list")).select(*own, "name", F.posexplode("list").alias("position", "value"))


def read_jdbc_bars(spark: SparkSession, url: str, table: str, symbol: str, limit: int, ts: str | None = None, **options: str) -> DataFrame:
    """The latest ``limit`` bars of a symbol from a database table, in rising time as ``ts``; filter, order and limit go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    found = reader.load().where(F.col("symbol") == symbol)
    time = time_column(found, ts)
    latest = found.orderBy(F.col(time).desc()).limit(limit)
    return latest.withColumnRenamed(time, "ts").orderBy("ts")


#: Names that a time column may have, in this order, if none is given.
TIME_NAMES = ("ts", "timestamp", "time", "datetime", "date", "open_time")


def time_column(df: DataFrame, name: str | None = None) -> str:
    """``name``, or the first column with one of TIME_NAMES in any case, or the only column of a time type."""
    if name:
        columns(df, name)
        return name
    lower = {c.lower(): c for c in df.columns}
    for c in TIME_NAMES:
        if c in lower:
            return lower[c]
    timed = [c for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]
    if len(timed) != 1:
        raise InvalidParameter(f"no time column among {', '.join(df.columns)}")
    return timed[0]


def write_json_bars(df: DataFrame, path: str, expected: list[str] | None = None, series: Series = BARS) -> None:
    """One JSON object and file a series, in folders ``symbol=..``, with ``ohlcv`` (lists in order) and the ``expected`` columns as lists with nulls: the shape that ``read_json_bars`` and ``read_expected`` read.

    A series is one object, so this is for series that an executor holds as lists;
    longer ones are written by Spark's own writers.
    """
    columns(df, *_FIELDS, *(expected or []))
    names = [*_FIELDS, *(expected or [])]
    row = F.sort_array(F.collect_list(F.struct(*series.order, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])))
    lists = df.groupBy(*series.by).agg(row.alias("rows"), F.count(F.lit(1)).alias("num_candles"))

    def part(which: list[str]) -> Column:
        return F.struct(*[F.col(f"rows.v{names.index(c)}").alias(c) for c in which])

    made = lists.select(*series.by, F.col("num_candles"), part(list(_FIELDS)).alias("ohlcv"), *([part(expected).alias("expected")] if expected else []))
    made.write.mode("overwrite").partitionBy(*series.by).json(path)


def synthetic_bars(spark: SparkSession, n: int, symbols: int = 1, seed: int = 42) -> DataFrame:
    """Random-walk bars with low <= open, close <= high, for tests and demonstrations."""
    rows = spark.range(n * symbols).select(
        F.concat(F.lit("s"), (F.col("id") % symbols).cast("string")).alias("symbol"),
        F.timestamp_seconds(F.floor(F.col("id") / symbols) * 3600).alias("ts"),
        F.randn(seed).alias("step"),
        F.rand(seed + 1).alias("spread"),
        (1000 + 5000 * F.rand(seed + 2)).alias("volume"),
    )
    close = rows.withColumn("close", 100 * F.exp(0.02 * F.sum("step").over(BARS.so_far())))
    opened = close.withColumn("open", F.coalesce(BARS.lag(F.col("close")), F.col("close")))
    return opened.select("symbol", "ts", "open", (F.greatest("open", "close") * (1 + 0.01 * F.col("spread"))).alias("high"), (F.least("open", "close") * (1 - 0.01 * F.col("spread"))).alias("low"), "close", "volume")
