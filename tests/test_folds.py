"""Folds of long keys, in segments, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.operators import folds


def plain_links(rows):
    state, target, n = "UNMATCHED", None, 0
    for _, t, s, replay in rows:
        if state in ("CONFLICT", "SKIPPED") and not replay:
            continue
        if state == "LINKED" and s == "LINKED" and t != target:
            state, n = "CONFLICT", n + 1
        else:
            state, target = s, t if s == "LINKED" else None
    return state, target, n


def plain_winner(rows, ranking):
    rows = sorted(rows)
    held, n = rows[0], 0
    later = lambda x: (x[2], int(x[3]))
    for x in rows[1:]:
        fills = ranking and held[6] is None and x[6] is not None
        same = held[4] == x[4] and (not ranking or held[6] == x[6])
        if not fills and (held[1:3] == x[1:3] or same or not x[4]):
            continue
        if not fills and held[5] == x[5]:
            n += 1
        if fills or (x[5] if held[5] != x[5] else later(x) > later(held)):
            held = x
    return held, n


@pytest.mark.parametrize("segment", [3, 50, 4096])
def test_links_in_segments(spark, segment):
    rng = random.Random(segment)
    kinds = [["LINKED"] * 3 + ["UNMATCHED", "CONFLICT", "SKIPPED"], ["LINKED"], ["LINKED", "CONFLICT"], folds.STATES]
    rows = [(k if k else None, i, rng.choice([1, 2, None, 3][: 1 + k % 4]), rng.choice(kinds[k % 4]), rng.random() < [0.02, 0.5, 0, 0.1, 0.01][k % 5]) for k in range(40) for i in range(rng.choice([1, 5, 200]))]
    df = spark.createDataFrame(rows, "k int, i int, t int, s string, r boolean").repartition(7)
    found = {r.k: (r.state, r.target, r.n_relinks) for r in folds.link_states(df, key=["k"], order=["i"], target="t", state="s", replay="r", segment=segment).collect()}
    assert found == {k: plain_links([x[1:] for x in rows if x[0] == k]) for k in {x[0] for x in rows}}


@pytest.mark.parametrize(("segment", "ranking"), [(3, None), (3, "g"), (40, None), (40, "g"), (4096, "g")])
def test_winners_in_segments(spark, segment, ranking):
    rng = random.Random(7)
    rows = []
    for k in range(25):
        for i in range(rng.choice([1, 4, 150])):
            rows.append((k if k else None, rng.choice("ab"), f"f{rng.randrange(6)}", f"v{rng.randrange(9)}", str(i), float(rng.randrange([3, 30][k % 2])), rng.random() < 0.1, rng.choice([None, None, "x", "y"])))
    df = spark.createDataFrame(rows, "k int, source string, file string, version string, row string, v double, good boolean, g string").repartition(5)
    found = {r.k: ((r.source, r.file, r.version, r.row, r.v), r.n_conflicts) for r in folds.winners(df, key=["k"], value="v", source="source", file="file", version="version", row="row", preferred=F.col("good"), ranking=ranking, segment=segment).collect()}
    wanted = {}
    for k in {x[0] for x in rows}:
        held, n = plain_winner([x[1:5] + x[5:] for x in rows if x[0] == k], ranking)
        wanted[k] = (held[:5], n)
    assert found == wanted


def test_a_key_of_a_million_rows(spark):
    """Folded in segments that lie in several tasks; none holds more of the key than one segment."""
    n = 1_000_000
    df = spark.range(n).selectExpr("id % 20 = 7 AS k", "id AS i", "(id * 7919) % 5 AS t", "CASE WHEN id % 11 < 8 THEN 'LINKED' WHEN id % 11 = 8 THEN 'SKIPPED' ELSE 'UNMATCHED' END AS s", "id % 1009 = 3 AS r")
    rows = {k: [] for k in (True, False)}
    for i in range(n):
        rows[i % 20 == 7].append((i, i * 7919 % 5, "LINKED" if i % 11 < 8 else "SKIPPED" if i % 11 == 8 else "UNMATCHED", i % 1009 == 3))
    found = {r.k: (r.state, r.target, r.n_relinks) for r in folds.link_states(df, key=["k"], order=["i"], target="t", state="s", replay="r").collect()}
    assert found == {k: plain_links(x) for k, x in rows.items()}
    cut = folds._segments(df.withColumn("_k", F.struct("k")), F.struct("i", "t"), folds.SEGMENT).select("_k", F.size("_rows").alias("n"), F.spark_partition_id().alias("p"))
    by_key = {r._k.k: r for r in cut.groupBy("_k").agg(F.max("n").alias("most"), F.countDistinct("p").alias("tasks"), F.count("*").alias("segments")).collect()}
    assert by_key[False].most <= folds.SEGMENT and by_key[False].tasks > 3 and by_key[False].segments >= 230
