"""Mixing sources to target weights: a low-discrepancy schedule over equal-token blocks.

Each source's documents, shuffled by a hash of their ids, are cut into blocks of
``block_tokens`` words. Points j * golden ratio modulo 1 fall into the sources'
shares of the cumulative weights; the r-th point of a source is its slot r, which
takes block r modulo the number of its blocks. So every stretch of the mix holds
the sources in about their target shares, and no block comes more than once more
often than another of its source.

Running sums over a source go through 4,096 buckets of the hash, and ranks over
a source's slots through ranges of 4,096 points: a source with most of the rows
is spread over as many tasks as all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

SPACES = " \t\n\x0b\x0c\r"
BLOCK_TOKENS = 256
_RANGE = 4096
_GRID = 4096
#: The golden ratio's fraction of 2**31, odd: j * PHI modulo 2**31 visits every value.
_PHI, _PERIOD = 1327217885, 1 << 31


def n_words(text: str) -> Column:
    """Words between spaces and 0x09-0x0D; null has none."""
    bare = F.btrim(F.col(text), F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, "[ \\t-\\r]+"))).otherwise(0).cast("long")


def targets(sizes: DataFrame, *, source: str, weights: tuple, total: float, cap: float) -> DataFrame:
    """One row per source of sizes(source, size): its number by code point (null last), its
    size and its target. A target is level * weight, at most cap times the source's size;
    the level is such that all targets make up total times all sizes."""
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    numbered = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1).cast("double")
    numbered = numbered.withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (total * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = numbered.withColumn("level", level).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return levelled.withColumn("target", F.when(F.col("full") | common.isNull(), F.col("most")).otherwise(F.col("weight") * common)).select("source", "source_no", "source_size", "target")


class Mix:
    """The parts of a mix: ``docs`` (each document with its source's target and its place in
    the shuffled source) and ``schedule`` (the pieces of documents in the order of the mix)."""

    def __init__(self, docs: DataFrame, schedule: DataFrame):
        self.docs, self.schedule = docs, schedule

    def taken(self) -> DataFrame:
        """docs with the words that the schedule takes of each, repeats counted."""
        sums = self.schedule.groupBy("uid").agg(F.sum("words").alias("words_taken"))
        return self.docs.join(sums, "uid", "left").withColumn("taken", F.coalesce("words_taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), total: float = 1.5, cap: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """A mix of total times all words. Sources by code point, null last, have the weights in
    turn; no source gives more than cap times its words.

    A null or wordless text has size 0 and is never taken; null ids sort as the empty
    string; rows that repeat count each; an empty table gives an empty mix. Only the
    three columns are read, so others may have any name."""
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("uid")), "mix-sizes")
    sources = written(targets(sized, source="source", weights=weights, total=total, cap=cap), "mix-targets")
    goal, size, b = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size"), F.lit(block_tokens)
    passes = F.when(size > 0, F.expr("goal div source_size")).otherwise(0)
    sources = sources.withColumn("goal", goal).withColumn("passes", passes).withColumn("rest", F.col("goal") - F.col("passes") * size)
    sources = sources.withColumn("n_blocks", F.ceil(size / b).cast("long")).withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / b).cast("long"))

    facts = sources.withColumnRenamed("source", "of")
    placed = sized.join(facts, sized["source"].eqNullSafe(facts["of"])).drop("of").withColumn("bucket", F.substring("key", 1, 3))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    inner = Window.partitionBy("source_no", "bucket").orderBy("key", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(buckets, ["source_no", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = written(placed.select("uid", "doc_id", "source", "source_no", "size", "source_size", "target", "at", "passes", "rest"), "mix-places")

    filled = placed.where(F.col("size") > 0)
    pieces = filled.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
    pieces = pieces.withColumn("begin", F.greatest("at", F.col("block") * b)).withColumn("end", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b))
    parts = pieces.join(_slots(sources), ["source_no", "block"])
    end = F.when(F.col("pass") < F.col("passes"), F.col("end")).otherwise(F.least("end", "rest"))
    schedule = parts.withColumn("words", end - F.col("begin")).where(F.col("words") > 0)
    return Mix(placed, schedule.select("point", "source_no", "source", "uid", "doc_id", "pass", (F.col("begin") - F.col("at")).alias("first_word"), "words"))


def _slots(sources: DataFrame) -> DataFrame:
    """Slots (point, source_no, block, pass): each source has n_slots of them."""
    order = Window.orderBy("source_no")
    shares = sources.select("source_no", "n_slots", "n_blocks", F.sum("n_slots").over(order).alias("high"), F.sum("n_slots").over(Window.partitionBy()).alias("n"))
    n = shares.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    shares = shares.withColumn("low", (F.col("high") - F.col("n_slots")) / F.col("n")).withColumn("high", F.col("high") / F.col("n"))
    cells = shares.where(F.col("n_slots") > 0).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _GRID), F.least(F.floor(F.col("high") * _GRID), F.lit(_GRID - 1)))))
    spread = F.pmod(F.pmod(F.col("point"), F.lit(_PERIOD)) * F.lit(_PHI).cast("long"), F.lit(_PERIOD)) / F.lit(float(_PERIOD))
    points = sources.sparkSession.range(n).select(F.col("id").alias("point")).withColumn("u", spread).withColumn("cell", F.floor(F.col("u") * _GRID))
    hits = points.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("point", F.floor(F.col("point") / _RANGE).alias("range"), "source_no")
    counts = hits.groupBy("source_no", "range").agg(F.count("*").alias("k"))
    counts = counts.withColumn("base", F.coalesce(F.sum("k").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("source_no", "range").orderBy("point")
    ranked = hits.withColumn("i", F.row_number().over(inner) - 1).join(counts.drop("k"), ["source_no", "range"]).select("source_no", "point", (F.col("i") + F.col("base")).alias("slot"))
    # Points fall a few short of some sources' slots: those slots come last.
    drawn = counts.groupBy("source_no").agg(F.sum("k").alias("drawn"))
    short = sources.join(drawn, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where(F.col("drawn") < F.col("n_slots"))
    late = short.select("source_no", F.explode(F.sequence("drawn", F.col("n_slots") - 1)).alias("slot")).select("source_no", (F.col("slot") + n).alias("point"), "slot")
    slots = ranked.unionByName(late).join(sources.select("source_no", "n_slots", "n_blocks"), "source_no").where(F.col("slot") < F.col("n_slots"))
    return slots.select("point", "source_no", F.expr("slot % n_blocks").alias("block"), F.expr("slot div n_blocks").alias("pass"))


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, mixed to 150 % of their words."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digest(docs: DataFrame, *, keep_source: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; with its source if asked."""
    return mix(docs).taken().select("doc_id", *["source"] * keep_source, "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT size, md5(coalesce(doc_id::VARCHAR, '')) k FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source NULLS LAST) no FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(no - 1) % 3 + 1]::DOUBLE weight, 2.0::DOUBLE * source_size most FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lv FROM w),
t AS (SELECT *, CASE WHEN most <= weight * lv OR (SELECT count(*) FROM l WHERE most > weight * lv) = 0 THEN most ELSE weight * (SELECT max(lv) FROM l WHERE most > weight * lv) END target FROM l),
g AS (SELECT *, floor(target + 0.5)::BIGINT goal FROM t),
o AS (SELECT doc_id, size, source_size, target, goal, coalesce(sum(size) OVER (PARTITION BY no ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT p FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - p)) END::BIGINT taken
FROM o
"""
