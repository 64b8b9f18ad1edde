"""Versions of a table, views refreshed by slices, candidates by rarest tokens, components by contraction."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from scholium.operators import identity, joins
from scholium.plans import views


def test_readers_find_a_whole_table_while_versions_come(spark, tmp_path):
    path, seen, errors, done = str(tmp_path / "t"), [], [], threading.Event()
    table = lambda v, n: spark.range(n).select(F.lit(v).alias("v"), F.lit(n).cast("int").alias("n"))
    assert views.publish(table(1, 5), path) == 1

    def read():
        try:
            while not done.is_set():
                rows = views.published(spark, path).collect()
                assert len(rows) == rows[0].n and len({r.v for r in rows}) == 1
                seen.append(rows[0].v)
        except Exception as e:
            errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(2, 14):
        assert views.publish(table(v, 5 + v), path, expected=5 + v, kept=4) == v
    with pytest.raises(ValueError, match="expected"):
        views.publish(table(99, 3), path, expected=4)
    done.set()
    reader.join()
    assert not errors and seen == sorted(seen) and len(seen) > 3
    assert {r.v for r in views.published(spark, path).collect()} == {13}
    assert {r.v for r in views.published(spark, path, 11).collect()} == {11}
    with pytest.raises(FileNotFoundError):
        views.published(spark, path, 2)


def test_unfinished_versions_and_other_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    views.publish(spark.range(3), path)
    (tmp_path / "t" / "versions" / "000000000002.json").write_text('{"version": 2, "data": "data/x"')  # being written
    assert views.published(spark, path).count() == 3
    with monkeypatch.context() as m:
        m.setattr(views, "_versions", lambda folder: [1])  # another writer takes the number meanwhile
        with pytest.raises(FileExistsError):
            views.publish(spark.range(4), path)
    assert views.publish(spark.range(4), path) == 3
    assert views.published(spark, path).count() == 4


def test_refreshed_views_are_those_built_anew(spark):
    rng, built = random.Random(3), []
    rows = [(k, i, rng.random()) for k in range(400) for i in range(3)]
    frame = lambda x: spark.createDataFrame(x, "k int, i int, v double")

    def build(df):
        built.append(df)
        return df.groupBy("k").agg(F.round(F.sum("v"), 6).alias("total"), F.count("*").alias("n"))

    old = frame(rows)
    for _ in range(2):
        edited = [r if rng.random() > 0.002 else (r[0], r[1], 2.0) for r in rows if rng.random() > 0.001] + [(1000 + rng.randrange(9), 0, 1.0)]
        new = frame(edited)
        view = views.refreshed(build(old), old, new, build, key=["k"], slices=256)
        assert sorted(map(tuple, view.collect())) == sorted(map(tuple, build(new).collect()))
        assert built[-2].count() < len(edited) / 8
    assert views.changed_slices(old, frame(rows[::-1]), key=["k"]).isEmpty()


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_candidates_by_rarest_tokens(spark, monkeypatch, share):
    monkeypatch.setattr(joins, "HOT", 30)
    rng = random.Random(2)
    some = lambda: {"all"} | {f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(6))}
    keys, known = {k: some() - ({"all"} if k % 3 else set()) for k in range(80)}, {e: some() for e in range(120)}
    a = spark.createDataFrame([(k, t) for k, x in keys.items() for t in x] + [(500, None), (1, None)], "k int, t string")
    b = spark.createDataFrame([(e, t) for e, x in known.items() for t in x] * 2 + [(7, None)], "e int, t string")
    wanted = {(k, e, len(x & y)) for k, x in keys.items() for e, y in known.items() if x and len(x & y) >= max(1, share * len(x) - 1e-9)}
    found = joins.likely(a, b, key="k", token="t", entity="e", known_token="t", share=share)
    assert {tuple(r) for r in found.collect()} == wanted


@pytest.mark.parametrize("common", [0, 3])
def test_candidates_of_an_entity_with_many_tokens(spark, common):
    """No pair meets all tokens of its entity; tokens that every entity has are asked for pairs found."""
    n, each = 60_000, range(common)
    known = spark.range(n).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("e"), F.col("id").cast("string").alias("t"))
    if common:
        known = known.unionByName(spark.createDataFrame([(f"e{i}", f"c{j}") for i in range(50) for j in each] + [("x", "c0")], "e string, t string"))
    keys = spark.range(n // 6).select("id", F.explode(F.transform(F.array(F.col("id") * 6, F.col("id") * 6 + 1, F.col("id") * 6 + 3), lambda x: x.cast("string"))).alias("t"))
    keys = keys.unionByName(spark.range(n // 6).select("id", F.explode(F.array(*(F.lit(f"c{j}") for j in each)).cast("array<string>")).alias("t")))
    found = joins.likely(keys, known, key="id", token="t", entity="e", known_token="t", share=0.5)
    got = {tuple(r) for r in found.groupBy("e", "n").agg(F.count("*"), F.countDistinct("id")).collect()}
    assert got == ({("x", 3, n // 6, n // 6)} | {(f"e{i}", 3, n // 6, n // 6) for i in range(50)} if common else {("x", 2, n // 6, n // 6)})
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_path_of_100000_keys(spark, monkeypatch):
    n, rounds, plain = 100_000, [], identity.contracted
    monkeypatch.setattr(identity, "contracted", lambda edges, number: (rounds.append(number), plain(edges, number))[1])
    path = spark.range(n).select("id", F.explode(F.array("id", F.col("id") + 1)).alias("t"))
    found = identity.resolved(path, key="id", token="t")
    assert found.where("identity <> 0").isEmpty() and found.count() == n
    assert len(rounds) < 20


def test_components(spark):
    rng = random.Random(6)
    rows = [(k, f"t{rng.randrange(140)}") for k in range(150) for _ in range(rng.choice([0, 1, 1, 2]))] + [(k, None) for k in range(0, 160, 3)] + [(k, "hub") for k in range(40, 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, t in rows:
        find(k)
        if t:
            root[find(k)] = find(t)
    least = {}
    for k in {k for k, _ in rows}:
        least[find(k)] = min(k, least.get(find(k), k))
    found = identity.resolved(spark.createDataFrame(rows, "k int, t string"), key="k", token="t")
    assert {r.k: r.identity for r in found.collect()} == {k: least[find(k)] for k, _ in rows}
