"""Filter audit, collocations and line dedup against plain versions, on given, odd, hot and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.llm import audit, collocations, lines

from . import brute


@pytest.fixture(params=["given", "odd"])
def where(request, sf_dir, odd_dir):
    return sf_dir if request.param == "given" else odd_dir


def documents(spark, where):
    return spark.read.parquet(f"{where}/documents.parquet")


def key(x):
    return tuple((v is not None, v) for v in x)


def rows(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.fixture
def crowd(spark):
    """A line in most documents, ids that repeat or are null, texts of one line and of many."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefgh") * 3 for _ in range(n))
    common = "  This line is EVERYWHERE\t"
    docs = [(i, "\n".join([say(4), common, "Straße ÄÖ und mehr " + "x" * (i % 3), "short", say(5), common.lower()])) for i in range(300)]
    docs += [(None, f"{common}\nonly here {k}") for k in range(3)] + [(7, f"{common}\nanother text of one id\nanother text of one id"), (7, "another text of one id"), (400, "another text of one id\n"), (401, "\n\n\n"), (402, None), (403, "")]
    docs += [(500, "\n".join(f"line number {k % 5000} of a long text" for k in range(20_000))), (501, "line number 4999 of a long text")]
    return docs + [docs[-2]] * 2


def test_lines_of_a_crowd(spark, crowd):
    docs = spark.createDataFrame(crowd, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("n_lines", F.lit(1)).withColumn("rest_of_row", F.lit(2)).repartition(9)
    wanted = list(brute.kept_lines(crowd))
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.h, r.n_lines) for r in kept.collect()), key=key) == sorted(((i, None if t is None else k, "x", 1) for (i, t), (_, _, k) in zip(crowd, wanted, strict=True)), key=key)
    assert rows(lines.digest(docs)) == sorted(((i, n, gone, brute.sha(k)) for (i, _), (n, gone, k) in zip(crowd, wanted, strict=True)), key=key)


@pytest.mark.parametrize(("min_chars", "least"), [(1, 2), (10, 5), (0, 1)])
def test_lines_by_other_thresholds(spark, crowd, min_chars, least):
    docs = spark.createDataFrame(crowd, "doc_id long, text string")
    wanted = [(i, n, gone, brute.sha(k)) for (i, _), (n, gone, k) in zip(crowd, brute.kept_lines(crowd, min_chars, least), strict=True)]
    assert rows(lines.digest(docs, min_chars=min_chars, least=least)) == sorted(wanted, key=key)


def test_op13(spark, where):
    docs = [(r.doc_id, r.text) for r in documents(spark, where).collect()]
    wanted = [(i, n, gone, brute.sha(k)) for (i, _), (n, gone, k) in zip(docs, brute.kept_lines(docs), strict=True)]
    assert rows(lines.op13_line_dedup(spark, where)) == sorted(wanted, key=key)


def test_op11(spark, where):
    docs = [(r.doc_id, r.text, r.source) for r in documents(spark, where).collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows(audit.op11_filter_audit(spark, where)) == sorted(brute.audit(docs, labels), key=key)


@pytest.mark.parametrize("bits", [64, 4, 0])
def test_copies_are_told_apart_though_hashes_meet(spark, bits):
    """Texts of one length, equal but for one late character; copies of each; with hashes of few bits all classes meet."""
    long = "word " * 7000
    texts = [long[:k] + "X" + long[k + 1 :] for k in (0, 70, 1500, 17_000, 30_000)] + ["", "one", "two"]
    docs = [(i, texts[i % len(texts)], ["a", None, ""][i % 3]) for i in range(40)] + [(None, texts[0], "a"), (3, texts[3], "b"), (90, None, "a"), (2, texts[0], "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).repartition(5)
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 1), (None, 1, 1), (999, 1, 1), (5, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert rows(audit.interactions(df, labels, bits=bits)) == sorted(brute.audit(docs, [tuple(r) for r in labels.collect()]), key=key)


def test_op12(spark, where):
    docs = [(r.text, r.lang) for r in documents(spark, where).collect()]
    assert rows(collocations.op12_collocations(spark, where)) == sorted(brute.collocations(docs), key=key)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4_000, "part_bytes": 4_000}, {"block_bytes": 4_000, "part_bytes": 4_000, "fan": 3}])
def test_phrases_of_a_crowd(spark, options):
    """A phrase everywhere, one piece that is a third of all, tabs and marks within pieces, small blocks."""
    rng = random.Random(9)
    word = lambda: rng.choice(["new", "york", "city", "of", "the", "in", "große", "Straße", "x"])
    docs = [(" ".join(word() for _ in range(rng.randrange(0, 40))) + rng.choice([".", ";\t", "\n", "!?", ""]) + "New  York\tCITY of", rng.choice(["en", "de", None, "und"])) for _ in range(300)] + [("the very same piece", "en")] * 150 + [(None, "en"), ("", "xx"), (" . ", "yy")]
    df = spark.createDataFrame([(t, x, 1) for t, x in docs], "text string, lang string, n int").repartition(4)
    least, cover = 12, 70
    found = collocations.mined(df, least=least, cover=cover, top=50, **options)
    assert rows(found) == sorted(brute.collocations(docs, least=least, cover=cover, top=50), key=key)


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter_phrases(spark, longest):
    docs = [("a b c d e, a b c. " * 20, "en"), ("b c d " * 9, None)]
    found = collocations.mined(spark.createDataFrame(docs, "text string, lang string"), least=5, longest=longest)
    assert rows(found) == sorted(brute.collocations(docs, least=5, longest=longest), key=key)


def test_scores_are_exact_beyond_64_bits(spark):
    """Counts of which 2,000,000 times is more than 64 bits hold."""
    big = 9_000_000_000_000_000
    counted = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in collocations.scored(counted).collect()] == [("en", "a b", 2, big - 7, big, big - 1, 2_000_000 * (big - 7) // (2 * big - 1))]
    longer = spark.createDataFrame([("en", "a b", 2, 10**17 + 1, 1, 1, 5), ("en", "a b c", 3, 8 * 10**16, 1, 1, 5)], "lang string, phrase string, words int, a long, l long, r long, score long")
    assert {r.phrase for r in collocations.uncovered(longer).collect()} == {"a b", "a b c"}
    assert {r.phrase for r in collocations.uncovered(longer.withColumn("a", F.when(F.col("words") == 2, 10**17).otherwise(F.col("a")))).collect()} == {"a b c"}
