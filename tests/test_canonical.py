"""Canonical plans, paged source, exports and positions on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from scholium.functions import text
from scholium.operators import scoring
from scholium.plans import canonical, exports, reports
from scholium.sources import files, paged


def test_targets_and_nulls(spark):
    known = spark.createDataFrame([("a", "e1", ["x", "y"]), ("b", "e1", ["y"]), ("c", None, None), ("d", " ", [None, "z"])], "id string, eid string, tags array<string>")
    df = spark.createDataFrame([(1, "e1", ["x"]), (2, None, ["x"]), (3, "", ["x", "z"]), (4, None, None), (5, "e9", ["q"])], "k int, eid string, tags array<string>")
    got = {r.k: (r.rung, r.target_id, r.several) for r in canonical.targets(df, known, key="k", target="id", rungs=["eid", "tags"], unique=["tags"]).collect()}
    assert got == {1: ("eid", "a", True), 2: ("tags", "a", False), 3: ("tags", None, True), 4: (None, None, False), 5: (None, None, False)}
    assert canonical.targets(df, known.limit(0), key="k", target="id", rungs=["eid"]).where("target_id is not null").isEmpty()


def test_assigned_and_entities(spark):
    facts = spark.createDataFrame([("r1", "A", 1), ("r2", "B", 2), ("r3", "C", 3), (" ", "D", 4), (None, None, 5)], "rec string, name string, at int")
    links = spark.createDataFrame([("r1", "x"), ("r2", None)], "record string, canonical_id string")
    known = spark.createDataFrame([("y", ["r2"]), ("x", [])], "canonical_id string, records array<string>")
    made = canonical.assigned(facts, links, known, record="rec", fallback=canonical.affiliation_id(F.col("rec"), F.col("name"), F.lit(None), F.lit(None)))
    got = {r.at: (r.canonical_id, r.outcome) for r in made.collect()}
    assert (got[1], got[2], got[3][1], got[4], got[5]) == (("x", "updated"), ("y", "updated"), "imported", (None, "skipped"), (None, "skipped"))
    assert {r.canonical_id: (r.records, r.name) for r in canonical.entities(made, record="rec", order=["at"], fields=["name"]).collect()}["x"] == (["r1"], "A")


def test_bridge(spark):
    df = spark.createDataFrame([(1, ["b", " ", "a", "b", None], "SCOPUS"), (2, None, "SCOPUS"), (3, [], None)], "k int, ids array<string>, source string")
    links = spark.createDataFrame([("scopus", "a", "A"), ("scopus", "b", None)], "source string, record string, canonical_id string")
    made = canonical.bridged(df, links, key="k", ids="ids", source="source")
    got = {r.k: (r.canonical_ids, r.pending_ids) for r in made.collect()}
    assert got[1][0][1] == "A" and len(got[1][0]) == 2 and got[1][1] == ["b"] and got[2] == got[3] == ([], [])
    link = canonical.pending_links(made, source="source").collect()
    assert [(r.record, r.canonical_id, r.state) for r in link] == [("b", got[1][0][0], "UNMATCHED")]


def test_onboarding(spark):
    journals = spark.createDataFrame([("j1", "One", ["1111-1111", "2222-2222"]), ("j2", None, None), ("j3", "Two", ["3333-3333", "4444-4444"]), ("j4", "New", ["5555-5555"]), ("j5", "Named", []), ("j6", "Linked", ["3333-3333"])], "id string, name string, issns array<string>")
    forums = spark.createDataFrame([("f1", "Own", "Journal", None, "2222-2222", None), ("f3", "A", "Journal", "3333-3333", None, None), ("f4", "B", "Journal", "4444-4444", None, []), ("f5", "named", "journal", None, None, None)], "id string, name string, aggregation string, issn string, eissn string, aliases array<string>")
    scopus = spark.createDataFrame([("s1", "Scopus One", "Trade", "1111-1111", None)], "id string, name string, aggregation string, issn string, eissn string")
    links = spark.createDataFrame([("j6", "f4"), ("j4", "gone")], "record string, canonical_id string")
    got = {r.journal: r for r in canonical.onboarded(journals, forums, scopus, links).collect()}
    assert len(got) == 6
    assert (got["j1"].state, got["j1"].forum_id, got["j1"].name, got["j1"].aggregation, got["j1"].issn, got["j1"].eissn, got["j1"].scopus_id) == ("UPDATED", "f1", "Scopus One", "Trade", "11111111", "22222222", "s1")
    assert (got["j2"].state, got["j2"].name) == ("IMPORTED", "j2")
    assert (got["j3"].state, got["j3"].reason, got["j3"].forum_id) == ("CONFLICT", "AMBIGUOUS_ISSN", None)
    assert (got["j4"].state, got["j4"].issn) == ("IMPORTED", "55555555") and got["j4"].forum_id.startswith("sforum_")
    assert (got["j5"].state, got["j5"].forum_id) == ("UPDATED", "f5")
    assert (got["j6"].state, got["j6"].forum_id, got["j6"].aliases) == ("UPDATED", "f4", ["33333333"])


def test_user_publications_and_collisions(spark):
    facts = spark.createDataFrame([("u1", "e1", None), ("u2", None, "10.1/x"), ("u3", None, "10.1/y"), ("u4", None, None), (None, "e1", None)], "record string, eid string, doi string").selectExpr("*", "'t' title", "'d' date", "'c' creator", "'f' forum")
    pubs = spark.createDataFrame([("p1", None, "e1", "10.1/x"), ("p2", None, None, "10.1/X"), ("p3", None, None, "doi:10.1/y"), ("p4", "u4", None, None)], "id string, user_record string, eid string, doi string")
    got = {r.record: (r.outcome, r.previous_id) for r in canonical.user_publications(facts, pubs).collect()}
    assert got == {"u1": ("updated", "p1"), "u2": ("conflict", None), "u3": ("updated", "p3"), "u4": ("updated", "p4"), None: ("skipped", None)}
    p = spark.createDataFrame([("a", "w1"), ("b", "w2"), ("c", "w2"), ("d", "non_wos"), ("e", "w5")], "id string, wos_id string")
    links = spark.createDataFrame([("w1", "a"), ("w5", "other")], "record string, canonical_id string")
    assert sorted((r.id, r.state) for r in canonical.collided_links(p, links).collect()) == [("a", "LINKED"), ("b", "CONFLICT"), ("c", "CONFLICT"), ("e", "CONFLICT")]


def test_json_files(spark, tmp_path):
    (tmp_path / "events.json").write_text(json.dumps({"events": [{"domain": "Music", "name": "M", "level": "1"}, {"domain": "Film", "name": "F", "level": "9"}]}))
    ranked, new = files.artistic_events(spark, f"{tmp_path}/events.json", spark.createDataFrame([("Music",)], "name string"))
    assert [tuple(r) for r in ranked.collect()] == [("Music", "M", "INTERNATIONAL_TOP")] and [r.name for r in new.collect()] == ["Film"]
    (tmp_path / "c.json").write_text(json.dumps({"eid": {"0": "a", "1": "b", "2": ""}, "citing articles": {"0": [{"eid": "x", "t": 1}, {"t": 2}], "1": 0, "2": [{"eid": "y"}]}}))
    pubs, cites, bad = files.citing_articles(spark, f"{tmp_path}/c.json")
    assert [tuple(r) for r in pubs.collect()] == [("x", '{"eid":"x","t":1}')] and [r.record for r in cites.collect()] == ["a->x"] and [r.payload for r in bad.collect()] == ['{"t":2}']


def test_paged(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"eid": "1"}, {"eid": ""}], "next_cursor": "n"}))
    (tmp_path / "a@n.json").write_text(json.dumps({"items": [{"eid": "2"}], "next_cursor": "n"}))
    df = paged.paged(spark, str(tmp_path), [("a", None), ("lost", "2020-01-01")], pause=0, attempts=2, slice=1)
    assert sorted((r.task, r.page, r.record or "") for r in df.collect()) == [("a", 0, "1"), ("a", 1, "2"), ("lost", 0, "")]
    assert "FileNotFoundError" in df.where("error is not null").first().error
    many = paged.paged(spark, str(tmp_path), [("a", None)] * 10_001, pause=0, attempts=1, slice=2_000)  # read as a table of tasks is
    assert sorted((r.page, r.record, r["count"]) for r in many.groupBy("page", "record").count().collect()) == [(0, "1", 10_001), (1, "2", 10_001)]
    known = spark.createDataFrame([("1",), ("2",), (None,)], "eid string")
    dates = spark.createDataFrame([("1", "2020-05-01"), ("1", "2021-05-01")], "cited_eid string, date string")
    assert sorted((r.eid, r.since) for r in paged.lower_bounds(known, dates).collect()) == [("1", "2021-05-01"), ("2", "1900-01-01")]


def test_exports(spark, tmp_path):
    pubs = spark.createDataFrame([("p", "e", "d", "T", "2020-01", ["a", "b"], "f", 3, ["i"]), ("q", "e2", None, "U", None, None, None, None, None)], "id string, eid string, doi string, title string, cover_date string, author_ids array<string>, forum_id string, cited_by_count int, affiliation_ids array<string>")
    cites = spark.createDataFrame([("p", "q"), ("p", "q"), ("q", "p")], "cited string, citing string")
    names = spark.createDataFrame([("a", "Ann")], "id string, name string")
    own, citing = exports.institution(pubs, cites, names, spark.createDataFrame([("f", "Forum")], "id string, name string"), ["i"])
    assert [tuple(r) for r in own.collect()] == [("e", "d", "T", 2020, "Ann,b", "Forum", 3)]
    assert [(r.cited_eid, r.citing_eid, r.authors) for r in citing.collect()] == [("e", "e2", "")]
    exports.by_member(spark.createDataFrame([("Doe", "Jo", 1), ("Roe", "Al", 2)], "last string, first string, n int"), f"{tmp_path}/zip", last="last", first="first")
    assert sorted(p.name for p in (tmp_path / "zip").glob("file=*")) == ["file=Doe_J_AB", "file=Roe_A_AB"]
    runs = exports.snapshots(spark.createDataFrame([("k", 1, None), ("k", 2, "x")], "k string, v int, p string"), key=["k"], payload=["p"], version=F.col("v"))
    assert runs.where("refresh_version = 1").first().payload == '{"p":null}'
    assert [tuple(r) for r in exports.latest_snapshots(runs, key=["k"], schema="p string").collect()] == [("k", 2, "x")]


def test_position(spark):
    given = ["Asist. Cerc. X", "Asist. X", "CS III", "Dr.", None]
    got = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, p string").orderBy("i").select(text.position(F.col("p"))).collect()
    assert [r[0] for r in got] == ["ASIST_C", "ASIST_UNIV", "CS_I", "OTHER", None]


def test_by_title(spark):
    rows = [("o", f"i{i:02}", "same" if i < 2 else f"t{i}", 1.0, float(i + 1)) for i in range(12)] + [("o", "i99", "t11", 0.0, 0.0), ("o", "i98", None, 1.0, 50.0)]
    made = reports.scores_by_title(spark.createDataFrame(rows, "owner string, item string, title string, score double, author_score double"), key=["owner"], title="title", order="item")
    got = {r.item: r.author_score for r in made.collect()}
    assert (len(got), got["i00"], got["i01"], got["i99"], got["i98"]) == (14, 2.0, 2.0, 12.0, 50.0)
    assert reports.indicator_totals(made, key=["owner"], selector="TOP_10").first().total == 50 + 12 + 12 + sum(range(5, 12))


def test_classification_of_first_category(spark):
    items = spark.createDataFrame([("p", "j", 2020, "ar", "X", False)], "item string, journal string, year int, subtype string, forum_name string, indexed boolean")
    facts = spark.createDataFrame([("j", 2020, "A - SCIE", "AIS", "Q1"), ("j", 2020, "B - SCIE", "AIS", "Q2"), ("j", 2023, "A - SCIE", "AIS", "Q3"), ("j", 2023, "B - SCIE", "AIS", "Q4")], "journal string, year int, category string, metric string, quarter string")
    flags = lambda compat: [getattr(scoring.classification(items, facts, compat=compat).first(), q) for q in ("q1", "q2", "q3", "q4")]
    assert flags(False) == [True, True, False, False] and flags(True) == [True, False, False, True]
