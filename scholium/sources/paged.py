"""Paged answers of a service as a data source: works of authors, and citations since a date."""

from __future__ import annotations

import json
import os
import re
import sys
import time
import urllib.request
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "task string, page int, record string, payload string, error string"


def _answer(endpoint: str, request: dict, timeout: float) -> dict:
    """What the service answers. A folder in place of an address holds answers as files,
    <task>.json and <task>@<cursor>.json."""
    if re.match(r"https?://", endpoint):
        body = json.dumps(request).encode()
        with urllib.request.urlopen(urllib.request.Request(endpoint, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)
    cursor = request.get("cursor")
    with open(os.path.join(endpoint, f"{request['task']}@{cursor}.json" if cursor else f"{request['task']}.json"), encoding="utf-8") as f:
        return json.load(f)


class _Slice(InputPartition):
    def __init__(self, tasks: list[tuple[str, str | None]]):
        self.tasks = tasks


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoint, self.tasks = options["path"], json.loads(options["tasks"])
        self.size, self.attempts = int(options.get("slice", "50")), int(options.get("attempts", "3"))
        self.pause, self.timeout = float(options.get("pause", "1")), float(options.get("timeout", "30"))

    def partitions(self) -> list[_Slice]:
        return [_Slice(self.tasks[i : i + self.size]) for i in range(0, len(self.tasks), self.size)] or [_Slice([])]

    def _page(self, request: dict) -> dict:
        for attempt in range(self.attempts):
            try:
                return _answer(self.endpoint, request, self.timeout)
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise ValueError("attempts is below 1")

    def read(self, part: _Slice) -> Iterator[tuple]:
        for task, since in part.tasks:
            cursor, seen, number = None, set(), 0
            while True:
                try:
                    page = self._page({"task": task, "from_date": since, "cursor": cursor})
                    items = [i for i in page.get("items") or [] if str(i.get("eid") or "").strip()]
                    cursor = page.get("next_cursor")
                except (OSError, ValueError, AttributeError) as e:
                    yield task, number, None, None, f"{type(e).__name__}: {e}"
                    break
                for item in items:
                    yield task, number, str(item["eid"]).strip(), json.dumps(item, ensure_ascii=False, sort_keys=True), None
                if not cursor or cursor in seen:
                    break
                seen.add(cursor)
                number += 1


class PagedSource(DataSource):
    """Format `paged`: path (address or folder of answers), tasks (JSON list of [task, from_date])."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def paged(spark: SparkSession, endpoint: str, tasks: list[tuple[str, str | None]], **options) -> DataFrame:
    """All pages of each task, cursor after cursor, as (task, page, record, payload, error).
    Items without a record go. Tasks are read in slices (50 each), one Spark task a slice; a task that fails
    after its attempts gives one row with its error and what it had read. A list of more than 10,000 is read as paged_from reads a table."""
    if len(tasks) > 10_000:
        return paged_from(spark.createDataFrame([tuple(t) for t in tasks], "task string, from_date string"), endpoint, **options)
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(tasks=json.dumps([list(t) for t in tasks]), **{k: str(v) for k, v in options.items()}).load(endpoint)


def paged_from(tasks: DataFrame, endpoint: str, **options) -> DataFrame:
    """The same for any number of tasks, given as a table (task, from_date): spread over as many
    partitions as there are slices, and read there. A lost executor's slices are asked again."""
    reader = _Reader({"path": endpoint, "tasks": "[]", **options})
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = [(t, s) for t, s in zip(frame["task"], frame["from_date"].where(frame["from_date"].notna(), None), strict=True)]
            for rows in batched(reader.read(_Slice(asked)), 1000):
                yield pd.DataFrame(rows, columns=names)

    named = tasks.select(F.col("task").cast("string"), F.col("from_date").cast("string")).where("task is not null")
    return named.repartition(max(1, -(-named.count() // reader.size))).mapInPandas(answers, SCHEMA)


def lower_bounds(publications: DataFrame, citations: DataFrame, default: str = "1900-01-01") -> DataFrame:
    """Each cited publication's (eid) last known date of a citation (cited_eid, date), else default."""
    last = citations.groupBy(F.col("cited_eid").alias("eid")).agg(F.max("date").alias("since"))
    return publications.select("eid").where("eid is not null").distinct().join(last, "eid", "left").withColumn("since", F.coalesce("since", F.lit(default)))
