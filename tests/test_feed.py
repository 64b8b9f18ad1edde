"""The stream of a service's pages against a server of our own, which fails and asks to wait now and then."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from scholium.sources.feed import FeedReader, feed


class _Server:
    """Items of each task with a day; pages of two. Every seventh request fails, every eleventh is told to wait."""

    def __init__(self):
        self.items = {t: [(f"{t}{i}", i) for i in range(n)] for t, n in (("a", 11), ("b", 4), ("none", 0))}
        self.today, self.n, self.asked, self.times, self.lock = 20, 0, Counter(), [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                request = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.n += 1
                    n = outer.n
                    outer.times.append(time.monotonic())
                if n % 7 == 0 or n % 11 == 0:
                    self.send_response(503 if n % 7 == 0 else 429)
                    self.send_header("Retry-After", "0")
                    self.end_headers()
                    return
                body = json.dumps(outer.answer(request)).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.address = f"http://127.0.0.1:{self.server.server_port}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, r):
        if "cursor" not in r:
            return {"as_of": f"d{self.today:03d}"}
        own = [x for x in self.items[r["task"]] if r["from_date"] <= f"d{x[1]:03d}" < r["to_date"]]
        at = int(r["cursor"] or 0)
        out = {"next_cursor": str(at + 2) if at + 2 < len(own) else None}
        if not r.get("envelope"):
            with self.lock:
                self.asked[r["task"], r["from_date"], at] += 1
            out["items"] = [{"eid": e, "day": d} for e, d in own[at : at + 2]] + [{"eid": " "}, None]
        return out


@pytest.fixture
def server():
    s = _Server()
    yield s
    s.server.shutdown()


def test_stop_and_restart_lose_and_repeat_nothing(spark, tmp_path, server):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    tasks = [("a", "d000"), ("b", "d002"), ("none", "d000")]

    def begin():
        rows = feed(spark, server.address, tasks, pages=2, persecond=500, pause=0.01, slice=1)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()

    def rows():
        return sorted((r.task, r.record) for r in spark.read.parquet(out).collect())

    query = begin()
    while not query.lastProgress or not query.lastProgress["numInputRows"]:
        time.sleep(0.05)
    query.stop()  # in the middle: pages are still open
    for _ in range(2):  # stopped and started again, with new items in between
        query = begin()
        query.processAllAvailable()
        query.stop()
        assert rows() == sorted((t, e) for t, own in server.items.items() for e, d in own if d >= (2 if t == "b" else 0))
        server.items["b"] += [(f"b{i}", i) for i in range(20, 25)]
        server.items["none"] += [("n1", 21)]
        server.today = 30
    assert {(r.task, r.record): r.page for r in spark.read.parquet(out).collect()}["a", "a10"] == 5
    assert len(rows()) == 11 + 2 + 5 + 1


def test_requests_keep_to_the_rate_and_give_up_on_errors_that_stay(server):
    reader = FeedReader({"path": server.address, "tasks": '[["a", "d000"]]', "persecond": "40", "pause": "0"})
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert [r[2] for r in rows] == [f"a{i}" for i in range(11)]
    gaps = [b - a for a, b in zip(server.times, server.times[1:], strict=False)]
    assert sorted(gaps)[len(gaps) // 2] >= 0.02
    assert reader.latestOffset() == end  # nothing new
    bad = FeedReader({"path": server.address.replace("http://127.0.0.1", "http://127.0.0.1") + "x", "tasks": '[["missing", "d000"]]', "pause": "0", "attempts": "2"})
    at = bad.initialOffset()
    assert bad.latestOffset() == at  # a task that fails waits, and nothing is passed over
