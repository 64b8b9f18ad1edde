"""How filters of documents interact: what each removes, alone, in every order and on average.

Each document gets a mask, a bit for every filter that it fails. Four filters look at its text; the
fifth marks copies, found by refining a partition: rows are split by the length of
their texts, then by the hashes of successive blocks of them, and whoever is alone in a class leaves.
The texts that are left are compared whole, and all rows of a text but those of the least id are copies. What
any order of the filters does follows from the counts of the masks, of which each part of the table
has 32 at most.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import removed, written
from .mixing import SPACES
from .quality_rules import _let

FILTERS = "ABCDE"
#: First code points of a text's blocks; the last block is what is left, of any length.
BLOCKS = (0, 64, 1024, 16384)
#: Up to so many classes of 40 bytes each are broadcast, else joined by a shuffle.
BROADCAST = 100_000
_COPY = 1 << FILTERS.index("E")
_CLASS = ["length", *(f"block_{k}" for k in range(len(BLOCKS)))]


def failing(text: str) -> Column:
    """The bits of the filters of texts: A (few words), B (few distinct ones), C (capitals), D (symbols). Null is empty."""
    x = F.coalesce(F.col(text), F.lit(""))
    # A wordless text splits into one empty word, for which A and B say the same as for none.
    few = _let(F.split(F.btrim(x, F.lit(SPACES)), "[ \\t-\\r]+"), lambda words: F.when(F.size(words) < 50, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 2).otherwise(0))
    capitals = F.length(x) - F.length(F.regexp_replace(x, "[A-Z]+", ""))
    return few + F.when(100 * capitals > 5 * F.length(x), 4).otherwise(0) + F.when(x.rlike("[#$%&*|]"), 8).otherwise(0)


def _class_of(text: str, bits: int) -> list[Column]:
    """The length of a text and the hashes of its blocks, of so many bits."""
    x = F.coalesce(F.col(text), F.lit(""))
    ends = [*BLOCKS[1:], None]
    blocks = [F.substring(x, a + 1, (b or (1 << 31) - 1) - a) for a, b in zip(BLOCKS, ends, strict=True)]
    hashes = [F.xxhash64(b) if bits == 64 else F.xxhash64(b).bitwiseAND(F.lit((1 << bits) - 1)) for b in blocks]
    return [F.length(x).alias("length"), *(h.alias(f"block_{k}") for k, h in enumerate(hashes))]


def _refined(rows: DataFrame) -> DataFrame:
    """The classes of more than one row, a column after the other; each round is a written table."""
    classes = written(rows.groupBy(*_CLASS).agg(F.count("*").alias("n")), "audit-classes")
    for k in range(1, len(_CLASS) + 1):
        split = _CLASS[:k]
        shared = classes.where(F.col("n") > 1) if k == len(_CLASS) else classes.join(classes.groupBy(*split).agg(F.sum("n").alias("of_split")).where("of_split > 1").drop("of_split"), split, "left_semi")
        before, classes = classes, written(shared, "audit-classes")
        removed(before)
    return classes


def _among(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of these classes; the classes are broadcast if they are few."""
    few = classes.limit(BROADCAST + 1).count() <= BROADCAST
    return rows.join(F.broadcast(classes) if few else classes, _CLASS, "left_semi")


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", bits: int = 64) -> DataFrame:
    """(id, part, mask) of every row of docs: the bits of the filters that it fails, A first.

    A null text is the empty text and a null source the empty one; a text of any length is hashed and compared whole;
    of rows with the same text all are copies but those of the least id, however often it repeats; a row without id is no copy
    and makes none. An empty table gives an empty one. Only the three columns are read. ``bits`` of a
    block's hash are looked at: fewer only make more texts meet before they are compared."""
    part = F.coalesce(F.col(source).cast("string"), F.lit(""))
    facts = written(docs.select(F.col(doc_id).alias("id"), part.alias("part"), failing(text).alias("mask"), *_class_of(text, bits)), "audit-facts")
    classes = _refined(facts)
    named = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"), part.alias("part"), *_class_of(text, bits))
    texts = _among(named, classes).groupBy(*_CLASS, "body").agg(F.min("id").alias("first"))
    compared = written(texts.groupBy(*_CLASS).agg(F.count("*").alias("texts"), F.min("first").alias("first")), "audit-compared")
    whole, torn = compared.where("texts = 1").select(*_CLASS, "first"), compared.where("texts > 1").select(*_CLASS)
    copies = F.when(F.col("id") > F.col("first"), _COPY).otherwise(0)
    if torn.isEmpty():
        return facts.join(whole, _CLASS, "left").select("id", "part", (F.col("mask") + F.coalesce(copies, F.lit(0))).alias("mask"))
    # Different texts of one class: their rows are told apart by the texts themselves.
    out = facts.join(torn, _CLASS, "left_anti").join(whole, _CLASS, "left").select("id", "part", (F.col("mask") + F.coalesce(copies, F.lit(0))).alias("mask"))
    rows = _among(named, torn)
    firsts = _among(named, torn).groupBy("body").agg(F.min("id").alias("first"))
    return out.unionByName(rows.join(firsts, "body").select("id", "part", (failing("body") + F.coalesce(copies, F.lit(0))).alias("mask")))


def _schedule(spark) -> DataFrame:
    """Every order of the filters, its steps, and each mask's share in them: 120 * 5 * 32 rows."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    table = spark.createDataFrame(steps, "filter_order string, step int, bit int, earlier int")
    return table.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))))


def interactions(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", bits: int = 64) -> DataFrame:
    """For each part (a source; null: the empty string), order of the filters and step: documents kept, removed,
    redundant (failing the filter, removed earlier), unique_fails (failing no other), good_lost, toxic_lost and shapley, what
    the filter removes summed over all orders.

    A document is good (toxic) if any of its labels says quality (toxic) 1; labels that repeat or name no document
    change nothing. Rows count one by one; an empty table has no parts. Nulls, ties and long texts as in masks."""
    found = masks(docs, doc_id=doc_id, text=text, source=source, bits=bits).groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("of")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    marked = found.join(known, F.col("id") == F.col("of"), "left")
    counted = written(marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")), "audit-masks")
    met = counted.join(F.broadcast(_schedule(docs.sparkSession)), "mask")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k
    total = lambda on, what: F.sum(F.when(on, what).otherwise(0)).cast("long")
    return met.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, F.col("n")).alias("kept"), total(fails & ~earlier, F.col("n")).alias("removed"), total(fails & earlier, F.col("n")).alias("redundant"), total(F.col("mask") == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(fails & ~earlier, F.col("good")).alias("good_lost"), total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"), total(fails, F.col("n") * F.expr(f"{orders} div bit_count(mask)")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Contract query: five filters over all documents, in all 120 orders, by source."""
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
g AS (SELECT doc_id, max(quality) q, max(toxic) x FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(q = 1, false)::INT good, coalesce(x = 1, false)::INT toxic,
   (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT mask FROM d LEFT JOIN g USING (doc_id)),
m AS (SELECT part, mask, count(*) n, sum(good) good, sum(toxic) toxic FROM f GROUP BY ALL),
a AS (SELECT chr(65 + i::INT) c, (1 << i)::INT b FROM range(5) r(i)),
o AS (SELECT a.c || e.c || h.c || i.c || j.c filter_order, [a.b, e.b, h.b, i.b, j.b] bs FROM a, a e, a h, a i, a j WHERE len(list_distinct([a.b, e.b, h.b, i.b, j.b])) = 5),
s AS (SELECT filter_order, (k + 1)::INT step, bs[k + 1] bit, coalesce(list_sum(bs[1:k]), 0)::INT earlier FROM o, range(5) r(k))
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT kept, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT removed,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT good_lost, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT toxic_lost,
  sum(CASE WHEN mask & bit > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT shapley
FROM m, s GROUP BY part, filter_order, step
"""
