"""Lines that many documents share, dropped from all but one of them.

Lines are exploded with their place, normalised and hashed to 128 bits; distinct documents are
counted for each hash; lines over the threshold go, but for those of the least document; and texts
are put together again from the places that are left. Until then only hashes and places are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import narrowed, written
from ._text import lowered
from .mixing import SPACES
from .quality_rules import _let

MIN_CHARS, LEAST = 10, 2
#: A hash with more than this part of all lines is heavy: fewer than so many can be, so they are broadcast.
HEAVY = 1024


def key_of(line: Column) -> Column:
    """The line without spaces and 0x09-0x0D at its ends, A-Z lower-cased."""
    return lowered(F.btrim(line, F.lit(SPACES)))


def _shared(lines: DataFrame, least: int) -> DataFrame:
    """Hashes of at least ``least`` documents: the least id (null if there is no other), and how many lines have it.

    Every document counts once, whatever it repeats; both counts are summed in tasks first."""
    each = lines.groupBy("h", "g", "id").agg(F.count("*").alias("n"))
    return each.groupBy("h", "g").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.count("*").alias("documents")).where(F.col("documents") >= least).drop("documents")


def _places(rows: DataFrame, min_chars: int, least: int) -> DataFrame:
    """(id, seen, places): of each text that loses lines, the places of those."""
    every = rows.select("id", "seen", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("place", "line"))
    keyed = every.select("id", "seen", "place", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = keyed.select("id", "seen", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"))
    shared = written(_shared(lines, least), "shared-lines")
    # At least so many lines as are shared: with them as the whole, still fewer than HEAVY hashes pass.
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = shared.where(F.col("n") * HEAVY > total).select("h", "g", F.struct("first").alias("known"))
    light = shared.where(F.col("n") * HEAVY <= total).select("h", "g", F.struct("first").alias("found"))
    # Lines of a heavy hash have their answer and are dealt by their text instead.
    told = lines.join(F.broadcast(heavy), ["h", "g"], "left")
    told = told.withColumn("h", F.when(F.col("known").isNull(), F.col("h")).otherwise(F.xxhash64("seen", "place")))
    told = told.join(light, ["h", "g"], "left").withColumn("answer", F.coalesce("known", "found"))
    gone = told.where(F.col("answer").isNotNull() & ~F.col("answer.first").eqNullSafe(F.col("id")))
    return gone.groupBy("id", "seen").agg(F.collect_set("place").alias("places"))


def _kept(held: DataFrame, min_chars: int, least: int) -> DataFrame:
    """held(id, body, others) with body as kept, n_lines and n_dropped."""
    held = held.withColumn("seen", F.xxhash64("body"))
    gone = _places(held.select("id", "seen", "body"), min_chars, least).select(F.col("id").alias("of"), F.col("seen").alias("saw"), "places")
    joined = held.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("seen") == F.col("saw")), "left")

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    n_lines = F.coalesce(F.length("body") - F.length(F.translate("body", "\n", "")), F.lit(0)) + 1
    counted = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", F.coalesce(F.size("places"), F.lit(0)).cast("long"))
    return counted.withColumn("body", F.when(F.col("places").isNull(), F.col("body")).otherwise(_let(F.split("body", "\n"), without))).drop("seen", "of", "saw", "places")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, least: int = LEAST) -> DataFrame:
    """docs, with their own columns, whose texts lack the lines that go.

    A line's key is the line stripped and lower-cased. A key of min_chars code points or more that at least ``least``
    documents hold loses all its lines but those in the document of least id. A null text is one empty line
    and stays null; an empty text stays empty. Rows that share an id are one document; those without id
    are one too, after all others; rows that repeat get the same result; an empty table gives an
    empty one. A very long text is one row of lines, in time and memory linear in its size. Other columns may have any
    name."""
    narrow, restored = narrowed(docs, doc_id, text)
    kept = _kept(narrow.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), "rest_of_row"), min_chars, least)
    return restored(kept.select(F.col("id").alias(doc_id), F.col("body").alias(text), "rest_of_row"))


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text's SHA-256 of every row of docs; nulls, ties and
    empty tables as in deduplicated."""
    kept = _kept(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")), min_chars, least)
    sha = F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", sha.alias("kept_sha256"))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents without the lines that lesser documents hold."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key FROM l),
s AS (SELECT key, min(doc_id) least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, i, line, least IS NOT NULL AND least <> k.doc_id gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM m GROUP BY doc_id
"""
