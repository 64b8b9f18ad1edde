"""A service's pages as a stream: each task's cursor is its offset.

The driver asks for envelopes only (the next cursor, without items) and so knows where a batch ends; executors fetch
the pages between two cursors, so a batch that runs again fetches the same ones, and a query that was
stopped goes on after the last page that it wrote. A task's window of dates is fixed by the service's ``as_of``
when it begins; with its last page, the next one begins there.
"""

from __future__ import annotations

import email.utils
import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "task string, page int, record string, payload string"


class Service:
    """Requests to an address: so many a second at most, tried again after a failure, as late as the service asks."""

    def __init__(self, address: str, per_second: float, attempts: int, pause: float, timeout: float):
        self.address, self.every, self.attempts, self.pause, self.timeout = address, 1 / per_second, attempts, pause, timeout
        self.free_at = 0.0

    def _once(self, request: dict) -> dict:
        time.sleep(max(0.0, self.free_at - time.monotonic()))
        self.free_at = time.monotonic() + self.every
        body = json.dumps(request).encode()
        with urllib.request.urlopen(urllib.request.Request(self.address, body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            answer = json.load(r)
        if not isinstance(answer, dict):
            raise ValueError("the answer is no object")
        return answer

    def ask(self, request: dict) -> dict:
        """The answer; 4xx but for 408 and 429 is not tried again."""
        for attempt in range(self.attempts):
            wait = self.pause * 2**attempt
            try:
                return self._once(request)
            except urllib.error.HTTPError as e:
                if attempt + 1 == self.attempts or 400 <= e.code < 500 and e.code not in (408, 429):
                    raise
                wait = max(wait, _seconds(e.headers.get("Retry-After")))
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
            time.sleep(wait)
        raise ValueError("attempts is below 1")


def _seconds(retry_after: str | None) -> float:
    """A Retry-After header, seconds or a date."""
    if not retry_after:
        return 0.0
    if retry_after.strip().isdigit():
        return float(retry_after)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(retry_after).timestamp() - time.time())
    except (TypeError, ValueError):
        return 0.0


class _Pages(InputPartition):
    """The pages of some tasks: (task, window, cursor of the first page, number of the first page, how many)."""

    def __init__(self, ranges: list[tuple], share: int):
        self.ranges, self.share = ranges, share


def _request(task: str, at: dict, cursor: str | None) -> dict:
    return {"task": task, "from_date": at["since"], "to_date": at["until"], "cursor": cursor}


class FeedReader(DataSourceStreamReader):
    """Offsets: for each task its window (since, until), the cursor of its next page, how many pages of the
    window and of all were passed, and whether the window is done."""

    def __init__(self, options: dict):
        self.address, self.tasks = options["path"], json.loads(options["tasks"])
        self.pages, self.size = int(options.get("pages", "10")), int(options.get("slice", "50"))
        self.per_second = float(options.get("persecond", "10"))
        self.limits = int(options.get("attempts", "4")), float(options.get("pause", "1")), float(options.get("timeout", "30"))
        self.current: dict | None = None
        self.service = Service(self.address, self.per_second, *self.limits)

    def initialOffset(self) -> dict:
        return {t: {"since": since, "until": None, "cursor": None, "page": 0, "passed": 0, "open": False} for t, since in self.tasks}

    def _onward(self, task: str, at: dict) -> dict:
        """The offset after up to ``pages`` more pages of a task."""
        at, first = dict(at), True
        for _ in range(self.pages):
            if not at["open"]:
                if not first:
                    break  # a batch holds pages of one window
                now = self.service.ask({"task": task, "from_date": at["since"], "envelope": True}).get("as_of")
                if at["passed"] and (now is None or now == at["since"]):
                    break  # nothing new
                at |= {"until": now, "open": True, "cursor": None, "page": 0}
            first = False
            cursor = self.service.ask(_request(task, at, at["cursor"]) | {"envelope": True}).get("next_cursor")
            at |= {"page": at["page"] + 1, "passed": at["passed"] + 1, "cursor": cursor}
            if not cursor:
                at |= {"open": False}
        return at

    def latestOffset(self) -> dict:
        held = self.current if self.current is not None else self.initialOffset()
        out = {}
        for task, at in held.items():
            if at.get("closing"):  # its window ended with the last batch: the next begins where that ended
                at = {"since": at["until"] or at["since"], "until": None, "cursor": None, "page": 0, "passed": at["passed"], "open": False}
            try:
                new = self._onward(task, at)
            except (OSError, ValueError):
                new = at  # the next batch tries again
            out[task] = new | ({"closing": True} if new["passed"] > at["passed"] and not new["open"] else {})
        changed = any(out[t]["passed"] != held[t]["passed"] for t in held)
        self.current = out if changed else held
        return self.current

    def partitions(self, start: dict, end: dict) -> Sequence[_Pages]:
        if self.current is None:  # the query was started anew: its last batch is planned first
            self.current = end
        ranges = []
        for task, at in end.items():
            n = at["passed"] - start.get(task, {"passed": 0})["passed"]
            if n:
                old = start[task]
                cursor = old["cursor"] if old["open"] else None
                ranges.append((task, {"since": at["since"], "until": at["until"]}, cursor, at["page"] - n, n))
        slices = [ranges[i : i + self.size] for i in range(0, len(ranges), self.size)]
        return [_Pages(s, len(slices)) for s in slices] or [_Pages([], 1)]

    def read(self, part: _Pages) -> Iterator[tuple]:
        service = Service(self.address, self.per_second / part.share, *self.limits)  # all tasks together keep to the rate
        for task, window, cursor, number, n in part.ranges:
            for page in range(number, number + n):
                answer = service.ask(_request(task, window, cursor))
                for item in answer.get("items") or []:
                    record = str((item or {}).get("eid") or "").strip()
                    if record:
                        yield task, page, record, json.dumps(item, ensure_ascii=False, sort_keys=True)
                cursor = answer.get("next_cursor")

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Format `feed`: path (an address), tasks (JSON list of [task, from_date])."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options)


def feed(spark: SparkSession, address: str, tasks: list[tuple[str, str | None]], **options) -> DataFrame:
    """A stream of (task, page, record, payload): all pages of each task since its date, and what comes later.

    A page counts up to ``pages`` a task and batch, persecond requests a second over all tasks; a request that fails is tried ``attempts`` times, and a task whose
    envelopes fail waits for the next batch. A page that can't be fetched fails the batch, which runs again: no page is left
    out. Items without a record go."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feed").options(tasks=json.dumps([list(t) for t in tasks]), **{k: str(v) for k, v in options.items()}).load(address)
