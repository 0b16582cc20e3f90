"""Candles from a local server with full, short, repeated and failing pages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from barline.errors import InvalidParameter
from barline.sources.klines import KlineReader, KlineSource, pages

HOUR = 3_600_000
CANDLES = {"A": [h * HOUR for h in range(50) if h not in (20, 21, 22, 23)], "B": [h * HOUR for h in range(10, 30)], "C": []}


@pytest.fixture
def server():
    state = {"asked": [], "fail": 2}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            state["asked"].append(q)
            if q["symbol"] == "none":
                self.send_error(404)
                return
            if state["fail"]:
                state["fail"] -= 1
                self.send_error(503)
                return
            first, last, limit = int(q["startTime"]), int(q["endTime"]), int(q["limit"])
            found = [t for t in CANDLES[q["symbol"]] if first <= t <= last][-limit:]
            if len(state["asked"]) % 3 == 0:  # a short page now and then, and a candle twice
                found = found[-2:] + found[-1:]
            body = json.dumps([[t, str(t / HOUR), str(t / HOUR + 1), t / HOUR - 1, str(t / HOUR), "7.5", t + HOUR - 1] for t in found]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/klines", state
    own.shutdown()


def read(spark, url, **options):
    spark.dataSource.register(KlineSource)
    return spark.read.format("klines").options(url=url, interval="1h", wait="0.01", **options).load()


@pytest.mark.parametrize("step", (0, 7 * HOUR))
def test_all_candles_once(spark, server, step):
    url, state = server
    df = read(spark, url, symbols="A,B,C", start=2 * HOUR, end=45 * HOUR, limit=5, step=step)
    rows = df.collect()
    got = sorted((r.symbol, int(r.ts.timestamp() * 1000)) for r in rows)
    assert got == sorted((s, t) for s, own in CANDLES.items() for t in own if 2 * HOUR <= t < 45 * HOUR)
    assert all(r.open == r.close == r.high - 1 == r.low + 1 == int(r.ts.timestamp()) / 3600 and r.volume == 7.5 for r in rows)
    assert df.rdd.getNumPartitions() == (3 if not step else 3 * 7)


def test_errors(spark, server):
    url, _ = server
    with pytest.raises(Exception, match="404"):
        read(spark, url, symbols="none", start=0, end=HOUR).collect()
    with pytest.raises(InvalidParameter):
        KlineReader({"url": url})
    with pytest.raises(ValueError, match="further"):
        list(pages(lambda first, last: [[10**15]], 0, 10))
    assert list(pages(lambda first, last: [], 0, 10)) == []
