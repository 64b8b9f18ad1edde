"""Link states kept by a stream: each change is applied in its order, whenever it arrives.

A link's changes wait in a map by their order until the watermark is past them; those are settled, by a
timer, into one state. What is told of a link after each batch is the settled state and all changes that wait, in
order: so whatever the order of arrival, it ends as the batch fold has it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What the session must be set to before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def changed(held: tuple, change: tuple) -> tuple:
    """(state, target, n) after a change (target, state, replay)."""
    state, target, n = held
    new, said, replay = change[1], change[0], change[2]
    if state in ("CONFLICT", "SKIPPED") and not replay:
        return held
    if state == "LINKED" and new == "LINKED" and said != target:
        return "CONFLICT", target, n + 1
    return new, said if new == "LINKED" else None, n


class _Links(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "state string, target string, n long")
        self.waiting = handle.getMapState("waiting", "at long, place string", "target string, state string, replay boolean")

    def _held(self) -> tuple:
        return tuple(self.settled.get()) if self.settled.exists() else ("UNMATCHED", None, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.at, r.place), (r.target, r.state, r.replay))
            self.handle.registerTimer(r.at)
        held, n = self._held(), 0
        for _, change in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            held, n = changed(held, change), n + 1
        yield Row(key=key[0], state=held[0], target=held[1], n_relinks=held[2], n_waiting=n)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All changes up to the timer are past the watermark: none can come before them any more."""
        until, held = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= until)
        for place, change in due:
            held = changed(held, change)
            self.waiting.removeKey(place)
        if due:
            self.settled.update(held)
        yield from ()

    def close(self) -> None:
        pass


def follow(changes: DataFrame, *, key: str, at: str, order: str, target: str, state: str, replay: str, delay: str = "1 day") -> DataFrame:
    """A stream, in update mode, of (key, state, target, n_relinks, n_waiting) for each link that a batch of changes touches; texts but for the counts.

    Changes apply in order of the timestamp at, then of order (as text). One that comes over ``delay`` behind the latest is
    dropped; the same change that comes twice is one. Memory is that of a link's changes within the delay."""
    named = changes.withWatermark(at, delay).select(
        F.col(key).cast("string").alias("key"), F.col(at), F.unix_millis(at).alias("at"), F.col(order).cast("string").alias("place"),
        F.col(target).cast("string").alias("target"), F.col(state).alias("state"), F.coalesce(F.col(replay), F.lit(False)).alias("replay"),
    )
    return named.groupBy("key").transformWithState(statefulProcessor=_Links(), outputStructType="key string, state string, target string, n_relinks long, n_waiting long", outputMode="Update", timeMode="EventTime")


def upserted(path: str):
    """For foreachBatch: the latest row of each link in a table, a folder a batch; ``states`` reads it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def states(spark, path: str) -> DataFrame:
    """Each link as its last batch has it."""
    every = spark.read.parquet(path)
    return every.groupBy("key").agg(F.max_by(F.struct("state", "target", "n_relinks"), "batch").alias("_s")).select("key", "_s.*")
