"""Lookups, filters, intake and later strategies on literal rows: nulls, blanks, repeats and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from scholium.operators import folds, ledger, lookups, scoring, search
from scholium.plans import intake, views
from scholium.sources import files, paged


def test_issn_bridge_and_lookup(spark):
    j = spark.createDataFrame([(1, "1234-567x", None, ["1234567X", None, "N/A"]), (2, "", "8765-4321", None), (3, None, None, [])], "j int, a string, b string, c array<string>")
    bridge = lookups.issn_bridge(j, journal="j", numbers=["a", "b"], lists=["c"])
    assert sorted(map(tuple, bridge.collect())) == [("1234567X", 1), ("87654321", 2)]
    asked = spark.createDataFrame([("1234 567x",), ("1234567X",), ("x",), (None,)], "q string")
    assert sorted(map(tuple, lookups.by_issn(asked, bridge, issn="q").collect())) == [("1234 567x", 1), ("1234567X", 1)]


def test_an_issn_that_many_share_is_dealt_and_its_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BLOCK", 4)
    monkeypatch.setattr(lookups, "TASK", 16)
    issn = lambda i: "1234567X" if i % 3 else f"0000{i:04d}"
    asked, held = [(i, issn(i)) for i in range(40)] + [(1, issn(1)), (50, None), (51, "x")], [(issn(i), i) for i in range(30)] + [(issn(1), 1), (None, 9)]
    found = lookups.by_issn(spark.createDataFrame(asked, "k int, q string"), spark.createDataFrame(held, "issn string, journal int"), issn="q")
    assert sorted(map(tuple, found.collect())) == sorted({(k, q, j) for k, q in asked for i, j in held if q and q == i})
    assert found.select(F.spark_partition_id()).distinct().count() > 2
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert lookups.by_issn(spark.createDataFrame([], "k int, q string"), spark.createDataFrame(held, "issn string, journal int"), issn="q").isEmpty()


def test_traversals(spark):
    edges = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("b", "q"), (None, "r")], "who string, what string")
    start = spark.createDataFrame([("a",), ("a",), (None,)], "who string")
    assert sorted(map(tuple, lookups.reached(start, (edges, "who", "what")).collect())) == [("a", "p")]
    assert sorted(map(tuple, lookups.reached(start, (edges, "who", "what"), (edges, "what", "who")).collect())) == [("a", "a"), ("a", "b")]
    aliases = spark.createDataFrame([("a", "A"), ("a", "A"), ("z", "Z")], "x string, y string")
    assert sorted(r.who for r in lookups.with_canonical(start, aliases, alias="x", canonical="y").collect()) == ["A", "a"]
    pubs = spark.createDataFrame([("p", 1), ("q", 2)], "id string, n int")
    cites = spark.createDataFrame([("p", "q"), ("p", "gone")], "cited string, citing string")
    assert [(r.id, r.citing_id) for r in lookups.cited_and_citing(pubs, cites, pubs, key="id").collect()] == [("p", "q")]
    with pytest.raises(Exception, match="unknown citing publication gone"):
        lookups.cited_and_citing(pubs, cites, pubs, key="id", strict=True).collect()


def test_filters(spark):
    df = spark.createDataFrame([(1, "a_b", ["x"], "2020-05", None), (2, "aXb", [], "soon", " "), (3, None, None, None, "v")], "k int, t string, a array<string>, d string, e string")
    kept = lambda c: [r.k for r in df.where(c).orderBy("k").collect()]
    assert kept(search.holding("a", "x")) == [1] and kept(search.matching("t", "a_b")) == [1, 2] and kept(search.present("e")) == [3] and kept(search.present("e", ["w"])) == []
    assert kept(search.facets(contains={"t": "A_B", "e": None}, equal={"k": None})) == [1] and kept(search.facets()) == [1, 2, 3]
    assert kept(search.in_years("d", 2020)) == [1] and kept(search.in_years("d", None, 2019)) == [] and kept(search.in_years("d")) == [1]
    assert kept(search.by_role("a", F.array(F.lit("x")), "MAIN")) == [1] and kept(search.by_role("a", F.array(F.lit("x")), "CO")) == [2, 3] and len(kept(search.by_role("a", F.array(F.lit("x")), "ALL"))) == 3
    assert [r.k for r in df.orderBy(*search.publication_order("d", "t", "k")).collect()] == [1, 3, 2]
    assert [r.k for r in search.after_key(df, "k", None, 2).collect()] == [1, 2] and [r.k for r in search.after_key(df, "k", 2, 5).collect()] == [3]
    assert [r.k for r in df.orderBy(*search.name_order("t", "k")).collect()] == [1, 2, 3]
    assert df.select(search.index_status("t", F.lit(None).cast("boolean"))).first()[0] == "not_applicable"
    patch = spark.createDataFrame([(1, "new"), (2, None)], "k int, t string")
    assert [r.t for r in search.patched(df, patch, key="k", columns=["t"]).orderBy("k").collect()] == ["new", "aXb", None]


def test_category_winner_takes_a_ranking_where_it_lacks_one(spark):
    rows = [("k", 1.0, "s", "f1", "v2", "9", None), ("k", 0.0, "s", "f2", "v1", "1", 4), ("k", 0.0, "s", "f3", "v1", "2", 4), ("k", 5.0, "s", "f4", "v0", "1", None)]
    df = spark.createDataFrame(rows, "k string, value double, source string, file string, version string, row string, rk int")
    r = folds.winners(df, key=["k"], value="value", source="source", file="file", version="version", row="row", preferred=F.lit(True), ranking="rk").first()
    assert (r.file, r.rk, r.value, r.n_conflicts) == ("f2", 4, 0.0, 1)


def test_university_and_activities(spark):
    who = spark.createDataFrame([(1, "u", 2020), (2, "none", 2020), (3, None, 2020)], "item int, university string, year int")
    ranks = spark.createDataFrame([("u", 2018, 100), ("u", 2020, 50), ("u", 2017, 7)], "university string, year int, rank int")
    assert {r.item: r.score for r in scoring.university(who, ranks, window="IY-3->IY").collect()} == {1: 50.0, 2: 0.0, 3: 0.0}
    acts = spark.createDataFrame([(1, {"a": "1,5"}, "x"), (2, {}, "y"), (3, None, None)], "item int, fields map<string,string>, a string")
    assert [(r.score, r.a) for r in scoring.activities(acts, "a * 2 + 1", ["a"]).orderBy("item").collect()] == [(4.0, "x"), (1.0, "y"), (1.0, None)]


def test_intake(spark):
    payloads = ['{"eid":"e1","title":"t","author_ids":"1;2","author_names":"A;B","source_id":"s"}', '{"eid":"e1","title":"u","author_ids":"2","author_names":"C","source_id":"s","publicationName":"P"}', '{"eid":" "}', "no json", None]
    made = intake.facts_of_payloads(spark.createDataFrame(list(enumerate(payloads)), "at int, payload string"), payload="payload", order=["at"])
    assert [(r.eid, r.title, len(r.hash)) for r in made["publications"].collect()] == [("e1", "u", 64)]
    assert sorted((r.id, r.name) for r in made["authors"].collect()) == [("1", "A"), ("2", "C")] and [r.name for r in made["forums"].collect()] == ["P"] and made["funding"].isEmpty()
    links = spark.createDataFrame([(1, "WOS", "LINKED", "r", None), (2, "WOS", None, "r", "t"), (3, "WOS", "LINKED", "r", "t")], "k int, source string, state string, record string, target string")
    assert [(r.state, r.target, r.outcome) for r in intake.repaired(links).orderBy("k").collect()] == [("UNMATCHED", None, "updated"), ("SKIPPED", None, "updated"), ("LINKED", "t", "skipped")]
    rows = spark.createDataFrame([("f", f"{i:02d}", None) for i in range(30)] + [("f", "x", "bad")], "file string, row string, error string")
    r = files.preview(rows, file="file", row="row", error="error").first()
    assert (r.planned, r.errors, r.samples) == (31, 1, [f"{i:02d}" for i in range(20)])


def test_swap_after_a_run_that_was_stopped(spark, tmp_path):
    path = f"{tmp_path}/t"
    views.swap(spark.range(3).toDF("k"), path, 3)
    (tmp_path / "t").rename(tmp_path / "t__old")
    assert views.swap(spark.range(5).toDF("k"), path, 5) == 5 and spark.read.parquet(path).count() == 5 and not (tmp_path / "t__old").exists()
    with pytest.raises(ValueError, match="expected"):
        views.swap(spark.range(1).toDF("k"), path, 2)
    assert spark.read.parquet(path).count() == 5


def test_issn_intake(spark):
    rows = [("d/AIS_2021.xlsx", 0, ["n", "1234-567x", "bad"]), ("d/AIS_2021.xlsx", 1, ["n", "bad", "worse"]), ("d/AIS_2021.xlsx", 2, ["n", "", None]), ("d/AIS_2015.xlsx", 3, ["n", "bad", "12345678"]), ("d/RIS_2019.xlsx", 4, ["n", "bad", "12345678"]), ("d/else.xlsx", 5, ["n", "bad"]), ("d/AIS_2021.xlsx", 6, None), ("d/AIS_2021.xlsx", 7, ["n"])]
    df = spark.createDataFrame(rows, "path string, row_item int, cells array<string>")
    got = {r.row_item: r.cells for r in files.with_valid_issns(df).collect()}
    assert got == {0: ["n", "1234-567x", ""], 2: ["n", "", None], 3: ["n", "bad", "12345678"], 5: ["n", "bad"], 6: None, 7: ["n"]}
    assert files.with_valid_issns(df.limit(0)).isEmpty()
    texts = ['{"issn":"1234-567X","eissn":"bad","t":{"a":[1,null]}}', '{"issn":"bad","t":1}', '{"t":1}', "[1]", None, '{"eissn":" ","eIssn":"12345678","issn":"x"}', "no json"]
    made = files.with_valid_identity(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")).collect()
    as_read = {r.i: r.payload if r.payload in (None, "no json") else json.loads(r.payload) for r in made}
    assert as_read == {0: {"issn": "1234-567X", "eissn": None, "t": {"a": [1, None]}}, 2: {"t": 1}, 3: [1], 4: None, 5: {"eissn": " ", "eIssn": "12345678", "issn": None}, 6: "no json"}


def test_edges_upserted(spark):
    stored = spark.createDataFrame([("a|b", "a", "b", "x", None), ("odd", "a", "c", "x", None), ("z|z", "z", "z", "x", "y")], "id string, l string, r string, p string, q string")
    commands = [("a", "b", "x", None, 1), ("a", "c", "x", None, 1), ("a", "c", "y", None, 2), ("n", "n", None, "q", 1), ("n", "n", "p", "q", 0), (" ", "b", "x", None, 1), ("a", None, "x", None, 1), ("a", None, "x", None, 1)]
    df = spark.createDataFrame(commands, "l string, r string, p string, q string, o int")
    options = dict(key=["l", "r"], edge_id="id", made_id=F.concat_ws("|", "l", "r"), lineage=["p", "q"], order="o")
    got = sorted(((r.l, r.r or "", r.id, r.p, r.q, r.action, r.conflict) for r in ledger.edges_upserted(stored, df, **options).collect()), key=str)
    rejected = [(" ", "b", None, "x", None, "reject", False), ("a", "", None, "x", None, "reject", False), ("a", "", None, "x", None, "reject", False)]
    assert got == sorted([*rejected, ("a", "b", "a|b", "x", None, "none", False), ("a", "c", "odd", "y", None, "update", True), ("n", "n", "n|n", None, "q", "insert", False)], key=str)
    assert ledger.edges_upserted(stored, df.limit(0), **options).isEmpty()


def test_paged_from_a_table(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"eid": "1"}, {"eid": " "}], "next_cursor": "n"}))
    (tmp_path / "a@n.json").write_text(json.dumps({"items": [{"eid": "2"}], "next_cursor": "n"}))
    tasks = spark.createDataFrame([("a", None), ("lost", "2020-01-01"), (None, "2020-01-01"), ("a", None)], "task string, from_date string")
    df = paged.paged_from(tasks, str(tmp_path), pause=0, attempts=2, slice=1)
    assert sorted((r.task, r.page, r.record or "") for r in df.collect()) == [("a", 0, "1"), ("a", 0, "1"), ("a", 1, "2"), ("a", 1, "2"), ("lost", 0, "")]
    assert paged.paged_from(tasks.limit(0), str(tmp_path)).isEmpty()
