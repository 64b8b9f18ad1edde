"""A ledger that a file stream feeds: each event counts once, replays change nothing.

Rows lie in buckets of a hash of their key. A manifest for each batch names the files of every bucket; readers and
the next batch go by the latest. A batch reads the key columns of the buckets that its own keys fall into, and no
others; a bucket of more than ``most_files`` files is merged, and one of more than ``most_rows`` rows splits in two by
the next bit of the hash (only its own files are rewritten), so what a batch reads follows the keys it brings, not the ledger's age.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..store import Folder

BITS, MOST_FILES, MOST_ROWS, KEPT = 4, 8, 10_000_000, 20


class Manifest:
    """The files and rows of each bucket as of a batch. A bucket is named by its last bits, as text."""

    def __init__(self, number: int, bits: int, buckets: dict[str, dict]):
        self.number, self.bits, self.buckets = number, bits, buckets

    def of(self, cell: str) -> str:
        """The bucket that holds the cell: the longest ending of it that is one, else the first bits' own."""
        return next((cell[i:] for i in range(len(cell) - self.bits + 1) if cell[i:] in self.buckets), cell[len(cell) - self.bits :])

    @property
    def depth(self) -> int:
        return max([self.bits, *map(len, self.buckets)])

    def files(self, buckets: set[str] | None = None) -> list[str]:
        return [f for b, x in self.buckets.items() if buckets is None or b in buckets for f in x["files"]]


def manifest(spark: SparkSession, ledger: str, before: int | None = None) -> Manifest | None:
    """The latest manifest, or the latest before a batch."""
    folder = Folder(spark, ledger)
    numbers = [int(n[:-5]) for n in folder.names("manifest") if n.endswith(".json")]
    numbers = [n for n in numbers if before is None or n < before]
    return Manifest(**json.loads(folder.text(f"manifest/{max(numbers):012d}.json"))) if numbers else None


def _cell(key: list[str], depth: int) -> Column:
    """The last bits of the key's hash, as text."""
    return F.substring(F.lpad(F.bin(F.xxhash64(*key)), 64, "0"), -depth, depth)


def _written(df: DataFrame, folder: Folder, name: str) -> dict[str, dict]:
    """df written in a folder for each bucket; its files and rows by bucket. A batch's number is in the name, so one that runs again replaces its files."""
    path = f"{folder.path}/{name}"
    df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    names = {b: [f"{name}/{b}/{f}" for f in folder.names(f"{name}/{b}") if f.endswith(".parquet")] for b in folder.names(name) if b.startswith("bucket=")}
    if not names:
        return {}
    at = folder.spark.read.schema(df.drop("bucket").schema).parquet(*(f"{folder.path}/{f}" for x in names.values() for f in x))
    rows = {r.b: r.n for r in at.groupBy(F.regexp_extract(F.input_file_name(), "/bucket=b([01]+)/", 1).alias("b")).agg(F.count("*").alias("n")).collect()}
    return {b.removeprefix("bucket=b"): {"files": x, "rows": rows.get(b.removeprefix("bucket=b"), 0)} for b, x in names.items()}


def append(ledger: str, batch: DataFrame, number: int, *, key: list[str], bits: int = BITS, most_files: int = MOST_FILES, most_rows: int = MOST_ROWS) -> tuple[DataFrame, int]:
    """Adds the rows of batch (which has payload_hash) whose (key, payload_hash) the ledger lacks, each once; returns them, and
    how many files were read to tell. A batch that runs again under its number ends the same, and so does
    one after a run that was stopped: what no manifest names is not there."""
    spark = batch.sparkSession
    folder, columns = Folder(spark, ledger), [*key, "payload_hash"]
    held = manifest(spark, ledger, before=number) or Manifest(-1, bits, {})
    fresh = batch.dropDuplicates(columns).withColumn("_cell", _cell(key, held.depth))
    cells = [r[0] for r in fresh.select("_cell").distinct().collect()]  # 2**depth at most, as many as there are buckets
    of = {c: held.of(c) for c in cells}
    known = held.files(set(of.values()))
    schema = batch.schema
    if known:
        fresh = fresh.join(spark.read.schema(schema).parquet(*(f"{folder.path}/{f}" for f in known)).select(*columns), columns, "left_anti")
    named = spark.createDataFrame([(c, f"b{b}") for c, b in of.items()], "_cell string, bucket string")
    added = _written(fresh.join(F.broadcast(named), "_cell").drop("_cell"), folder, f"data/{number:012d}")
    buckets = {b: dict(x) for b, x in held.buckets.items()}
    for b, x in added.items():
        old = buckets.get(b, {"files": [], "rows": 0})
        buckets[b] = {"files": old["files"] + x["files"], "rows": old["rows"] + x["rows"]}
    new = spark.read.schema(schema).parquet(*(f"{folder.path}/{f}" for x in added.values() for f in x["files"])) if added else batch.limit(0)
    made, split = _tidied(folder, schema, buckets, set(added), number, key, most_files, most_rows)
    buckets = {b: x for b, x in (buckets | made).items() if b not in split}
    folder.put(f"manifest/{number:012d}.json", json.dumps({"number": number, "bits": held.bits, "buckets": buckets}))
    return new, len(known)


def _tidied(folder: Folder, schema, buckets: dict, touched: set[str], number: int, key: list[str], most_files: int, most_rows: int) -> tuple[dict, set[str]]:
    """What becomes of the touched buckets that are too large, or of too many files, and which of them split."""
    split = {b for b in touched if buckets[b]["rows"] > most_rows}
    merged = {b for b in touched if len(buckets[b]["files"]) > most_files} | split
    if not merged:
        return {}, set()
    cell, target = _cell(key, max(map(len, merged)) + 1), F.lit(None).cast("string")
    for b in sorted(merged):
        name = F.substring(cell, -len(b) - 1, len(b) + 1) if b in split else F.lit(b)
        target = F.when(cell.endswith(b), F.concat(F.lit("b"), name)).otherwise(target)
    rows = folder.spark.read.schema(schema).parquet(*(f"{folder.path}/{f}" for b in merged for f in buckets[b]["files"]))
    made = _written(rows.withColumn("bucket", target), folder, f"data/{number:012d}-merged")
    # Both halves are buckets from now on, though one may be empty: names end where they end.
    return {f"{bit}{b}": {"files": [], "rows": 0} for b in split for bit in "01"} | made, split


def vacuum(spark: SparkSession, ledger: str, kept: int = KEPT) -> int:
    """Deletes the manifests but for the last ``kept``, and the files that none of those names; returns how many folders went."""
    folder = Folder(spark, ledger)
    names = [n for n in folder.names("manifest") if n.endswith(".json")]
    for n in names[:-kept]:
        folder.delete(f"manifest/{n}")
    used = {f.rsplit("/", 2)[0] for n in names[-kept:] for f in Manifest(**json.loads(folder.text(f"manifest/{n}"))).files()}
    last = names[-1].removesuffix(".json") if names else ""
    gone = [d for d in folder.names("data") if f"data/{d}" not in used and d.split("-")[0] <= last]
    for d in gone:
        folder.delete(f"data/{d}")
    return len(gone)


def follow(spark: SparkSession, source: str, schema: str, *, ledger: str, checkpoint: str, key: list[str], payload: list[str], watermark: str | None = None, files_per_batch: int = 100, touched=None, **sizes) -> StreamingQuery:
    """Reads what is new in source (Parquet files) and appends to ledger each (key, payload hash) that it
    lacks. A batch that runs again after a failure replaces itself. touched: called with the batch's
    new rows (incremental follow-up work).
    watermark: a timestamp column; state of events over a day behind it goes, otherwise the anti-join alone keeps replays out."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).withColumn("payload_hash", content_hash(*map(F.col, payload)))
    if watermark:
        events = events.withWatermark(watermark, "1 day").dropDuplicatesWithinWatermark([*key, "payload_hash"])

    def add(batch: DataFrame, number: int) -> None:
        new, _ = append(ledger, batch, number, key=key, **sizes)
        if touched:
            touched(new)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """The ledger as of its latest manifest."""
    held, full = manifest(spark, ledger), f"{schema}, payload_hash string"
    files = held.files() if held else []
    return spark.read.schema(full).parquet(*(f"{ledger}/{f}" for f in files)) if files else spark.createDataFrame([], full)


def retry_at(attempts, last, *, base: int = 60, most: int = 3600, limit: int = 3):
    """When a failed task may run again: base * 2**attempts seconds later, most at most; null after limit attempts."""
    return F.when(attempts < limit, last + F.make_dt_interval(secs=F.least(F.lit(base) * F.pow(F.lit(2), attempts), F.lit(most)).cast("decimal(18,6)")))
