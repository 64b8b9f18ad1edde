"""Facts to read views, and their checks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import fingerprint
from ..store import Folder


def scoring_view(categories: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every category fact with its journal's metric of the year."""
    return categories.join(metrics.select("journal", "year", "metric", "value"), ["journal", "year", "metric"], "left")


def ranking_view(journals: DataFrame, metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """Journals (journal, name) with the last year of each metric that has a value, and the edition
    of the latest AIS fact, else RIS, else UNKNOWN; one aggregate each. Journals without facts go (J10)."""
    last = metrics.groupBy("journal").agg(*(F.max(F.when((F.col("metric") == m) & F.col("value").isNotNull(), F.col("year"))).alias(f"latest_{m.lower()}_year") for m in ("AIS", "RIS", "IF")))
    order = F.struct("year", "version", "row")
    edition = F.coalesce(*(F.max_by(F.when(F.col("metric") == m, F.col("edition")), F.when(F.col("metric") == m, order)) for m in ("AIS", "RIS")), F.lit("UNKNOWN"))
    latest = categories.groupBy("journal").agg(edition.alias("latest_edition"), F.lit(True).alias("has_category"))
    joined = journals.join(last.withColumn("has_metric", F.lit(True)), "journal", "left").join(latest, "journal", "left")
    return joined.where("has_metric or has_category").withColumn("latest_edition", F.coalesce("latest_edition", F.lit("UNKNOWN"))).drop("has_metric", "has_category")


def publication_view(publications: DataFrame, citations: DataFrame) -> DataFrame:
    """Publications (id, cited_by_count) with the distinct ids that cite them, in order."""
    citing = citations.groupBy(F.col("cited").alias("id")).agg(F.array_sort(F.collect_set("citing")).alias("citing_ids"))
    out = publications.join(citing, "id", "left").withColumn("citing_ids", F.coalesce("citing_ids", F.array().cast("array<string>")))
    return out.withColumn("cited_by_count", F.coalesce("cited_by_count", F.size("citing_ids")))


def swap(df: DataFrame, path: str, expected: int | None = None) -> int:
    """K3, K5: writes df beside the table, checks the count, then the table's place takes it; a failed
    check or a failed move leaves the table as it is. For file systems that move folders at once; readers may
    find no table between the two moves, and a run that was stopped there is put right by the next."""
    spark = df.sparkSession
    staged, old = f"{path}__staged", f"{path}__old"
    df.write.mode("overwrite").parquet(staged)
    n = spark.read.parquet(staged).count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows staged, {expected} expected")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    held = fs.exists(at(path))
    if held:
        fs.delete(at(old), True)
        if not fs.rename(at(path), at(old)):
            raise OSError(f"can't move {path}")
    elif fs.exists(at(old)):  # left by a run that was stopped between its moves
        held = True
    if not fs.rename(at(staged), at(path)):
        if held and not fs.rename(at(old), at(path)):
            raise OSError(f"can't move {staged}; the table is at {old}")
        raise OSError(f"can't move {staged}")
    fs.delete(at(old), True)
    return n


#: Ends each version's file: one that lacks it is still being written.
_END = "\n."


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in folder.names("versions") if n.endswith(".json"))


def _named(folder: Folder, version: int) -> dict | None:
    """What a version's file says; None if it is unfinished or went meanwhile."""
    try:
        said = folder.text(f"versions/{version:012d}.json")
    except Exception as e:
        if "FileNotFound" in str(e) or "does not exist" in str(e):
            return None
        raise
    return json.loads(said.removesuffix(_END)) if said.endswith(_END) else None


def publish(df: DataFrame, path: str, *, expected: int | None = None, kept: int = 3) -> int:
    """K3, K5: df as the next version of the table at path; returns its number.

    Rows are written in a folder of their own, their count is checked, then a file of the version's number, which must be new,
    names the folder: that is the moment at which readers see it. Nothing is moved or overwritten, so it holds for object stores
    too; a failed check or run leaves the table as it is. Of two writers of one number the later gets FileExistsError. The last ``kept`` versions stay for those who read them."""
    folder, data = Folder(df.sparkSession, path), f"data/{uuid.uuid4().hex}"
    held = _versions(folder)
    number = (held[-1] if held else 0) + 1
    df.write.parquet(f"{folder.path}/{data}")
    n = df.sparkSession.read.schema(df.schema).parquet(f"{folder.path}/{data}").count()
    if expected is not None and n != expected:
        folder.delete(data)
        raise ValueError(f"{n} rows staged, {expected} expected")
    if not folder.created(f"versions/{number:012d}.json", json.dumps({"version": number, "data": data, "rows": n, "schema": df.schema.jsonValue()}) + _END):
        folder.delete(data)
        raise FileExistsError(f"version {number} was published meanwhile")
    for old in held[: max(0, len(held) + 1 - kept)]:
        gone = _named(folder, old)
        folder.delete(f"versions/{old:012d}.json")
        if gone:
            folder.delete(gone["data"])
    return number


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at path as of its latest version, or of one that is kept. Its files stay while ``kept - 1`` later versions come."""
    folder = Folder(spark, path)
    for number in [version] if version is not None else _versions(folder)[::-1]:
        if said := _named(folder, number):
            return spark.read.schema(T.StructType.fromJson(said["schema"])).parquet(f"{folder.path}/{said['data']}")
    raise FileNotFoundError(f"no version at {path}")


def changed_slices(old: DataFrame, new: DataFrame, *, key: list[str], slices: int = 1024) -> DataFrame:
    """Slices (by a hash of the key) whose rows differ, by the rows' hashes summed in each; as many rows as slices, at most."""
    def marks(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.pmod(F.xxhash64(*key), F.lit(slices)).alias("slice"), F.xxhash64(*df.columns).cast("decimal(20,0)").alias("h"), F.xxhash64(F.lit("b"), *df.columns).cast("decimal(20,0)").alias("g"))
        return each.groupBy("slice").agg(F.struct(F.count("*"), F.sum("h"), F.sum("g")).alias(name))

    both = marks(old, "a").join(marks(new, "b"), "slice", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("slice")


def refreshed(view: DataFrame, old: DataFrame, new: DataFrame, build, *, key: list[str], slices: int = 1024) -> DataFrame:
    """View, built of old by build and keyed by key, as build makes it of new: only keys in slices that
    differ are built anew. build must make each key's rows of that key's source rows alone."""
    if old.columns != new.columns:
        raise ValueError("old and new have other columns")
    touched = F.broadcast(changed_slices(old, new, key=key, slices=slices))  # slices rows at most
    at = lambda df: df.withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(slices)))
    again = build(at(new).join(touched, "slice", "left_semi").drop("slice"))
    return at(view).join(touched, "slice", "left_anti").drop("slice").unionByName(again)


def synced(spark: SparkSession, slices: dict[str, tuple], state: dict[str, str], full: bool = False) -> list[tuple[str, str]]:
    """Rebuilds each slice (source, fingerprint columns, build) whose fingerprint changed. The state
    moves on only after a slice is built; the first failure ends the run."""
    out = []
    for name, (source, columns, build) in slices.items():
        mark = fingerprint(source, *columns).first()[0]
        if not full and state.get(name) == mark:
            out.append((name, "skipped"))
            continue
        try:
            build(source)
        except Exception as e:
            out.append((name, f"failed: {e}"))
            break
        state[name] = mark
        out.append((name, "rebuilt"))
    return out


def parity(actual: DataFrame, expected: DataFrame, *, key: list[str], value: str, tolerance: float = 1e-8, allowed: DataFrame | None = None) -> DataFrame:
    """Keys whose value is missing or differs from what is expected, unless allowed."""
    both = expected.select(*key, F.col(value).alias("expected")).join(actual.select(*key, F.col(value).alias("actual")), key, "left")
    wrong = both.where(F.col("actual").isNull() | (F.abs(F.col("actual") - F.col("expected")) > tolerance))
    return wrong.join(allowed, key, "left_anti") if allowed is not None else wrong
