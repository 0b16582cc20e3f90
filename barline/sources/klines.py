"""Candles from an exchange's HTTP interface as a Spark data source.

::

    spark.dataSource.register(KlineSource)
    spark.read.format("klines").options(url="https://…/klines", symbols="A,B", interval="1h", start=0, end=1_700_000_000_000, step=86_400_000).load()

The interface answers ``?symbol=&interval=&startTime=&endTime=&limit=`` (times in milliseconds, both ends
included) with a JSON list of ``[open time, open, high, low, close, volume, ..]``, numbers as strings or
not, the latest ``limit`` candles of the range. A partition is one symbol and ``step`` milliseconds; it is read
backward page by page, each page ending before the first candle of the one before.

Defined cases: pages may be short, and only an empty one or the start of the range ends a
partition; candles that come again, or lie outside the range, are passed over; a page that goes no
further back is an error; server errors are tried again, other ones are raised; rows are ``symbol, ts,
open, high, low, close, volume``; a candle on the edge of two partitions belongs to the later one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from barline.errors import InvalidParameter

TRIES = 4
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@dataclass
class Range(InputPartition):
    """Candles of a symbol that open from ``start`` on and before ``end``."""

    symbol: str
    start: int
    end: int


def pages(ask, start: int, end: int) -> Iterator[list[list]]:
    """Pages of candles of a range, backward; ``ask(first, last)`` gives the latest ones between two times."""
    last = end - 1
    while last >= start:
        found = ask(start, last)
        fresh = [row for row in found if start <= int(row[0]) <= last]
        if not found:
            return
        if not fresh:
            raise ValueError(f"a page that goes no further back than {last}")
        yield fresh
        last = min(int(row[0]) for row in fresh) - 1


class KlineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        missing = [k for k in ("url", "symbols", "interval", "start", "end") if k not in options]
        if missing:
            raise InvalidParameter(f"options {', '.join(missing)} are missing")
        self.url, self.interval = options["url"], options["interval"]
        self.symbols = [s.strip() for s in options["symbols"].split(",") if s.strip()]
        self.start, self.end = int(options["start"]), int(options["end"])
        self.step, self.limit, self.wait = int(options.get("step", 0)) or max(self.end - self.start, 1), int(options.get("limit", 1000)), float(options.get("wait", 0.5))
        if self.step <= 0 or self.limit <= 0:
            raise InvalidParameter("step and limit must be positive")

    def partitions(self) -> list[InputPartition]:
        return [Range(s, a, min(a + self.step, self.end)) for s in self.symbols for a in range(self.start, self.end, self.step)]

    def ask(self, symbol: str, first: int, last: int) -> list[list]:
        address = f"{self.url}?{urlencode({'symbol': symbol, 'interval': self.interval, 'startTime': first, 'endTime': last, 'limit': self.limit})}"
        for k in range(TRIES):
            try:
                with urlopen(address, timeout=30) as answer:
                    return json.load(answer)
            except (HTTPError, URLError) as e:
                final = isinstance(e, HTTPError) and e.code < 500 and e.code != 429
                if final or k == TRIES - 1:
                    raise
                time.sleep(self.wait * 2**k)
        return []

    def read(self, partition: Range) -> Iterator[tuple]:
        for page in pages(lambda first, last: self.ask(partition.symbol, first, last), partition.start, partition.end):
            for at, row in {int(row[0]): row for row in page}.items():  # pages never overlap; a candle may come twice in one
                yield (partition.symbol, datetime.fromtimestamp(at / 1000, timezone.utc), *(None if v is None else float(v) for v in row[1:6]))


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> KlineReader:
        return KlineReader(dict(self.options))
