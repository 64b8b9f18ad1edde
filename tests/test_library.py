"""Operators on literal rows, and every query against its SQL."""

import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from scholium import catalog_queries, queries, scoring_queries  # noqa: F401
from scholium.functions import formula, text, years
from scholium.operators import folds, identity, joins, ledger, ranking, scoring, search
from scholium.plans import reports, views
from scholium.sources import files, xlsx
from scholium.streaming import ledger as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    wanted = con.execute(queries.SQL[name])
    names = [c[0] for c in wanted.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [(v is not None, str(v)) for v in r]
    assert sorted(([plain(r[c]) for c in names] for r in df.collect()), key=key) == sorted(([plain(v) for v in r] for r in wanted.fetchall()), key=key)


@pytest.mark.parametrize(
    ("made", "wanted"),
    [
        (lambda: text.jtrim(F.lit("\t a \x00")), "a"), (lambda: text.extract_year(F.lit("2024-05")), 2024), (lambda: text.extract_year(F.lit("20a4")), None), (lambda: text.issn_token(F.lit("1234-567x")), "1234567X"), (lambda: text.issn_token(F.lit("N/A")), None),
        (lambda: text.issn_display(F.lit("12345678")), "1234-5678"), (lambda: text.issn_candidates(F.lit("a 1234-5678, 8765432x b 1234-5678")), ["12345678", "8765432X"]), (lambda: text.fingerprint(F.lit("Éa--B  ç!")), "ea b c"),
        (lambda: text.normalize_doi(F.lit("https://doi.org/10.1/AbC ")), "10.1/abc"), (lambda: text.edition_candidates(F.lit("social sciences")), ["SSCI"]), (lambda: text.edition_candidates(F.lit(" ")), ["UNKNOWN"]), (lambda: text.edition_candidates(F.lit("SCIE, SSCI")), ["SSCI", "SCIE"]),
        (lambda: text.category_name(F.lit("A - B - SCIE")), "A - B"), (lambda: text.category_index(F.lit("A - B - SCIE")), "SCIE"), (lambda: text.first_dash_index(F.lit("A - B - SCIE")), "B - SCIE"), (lambda: text.metric_value(F.lit("0,5")), 0.5), (lambda: text.metric_value(F.lit("-999.999")), None),
        (lambda: text.lenient_int(F.lit("3.9")), 3), (lambda: text.quarter(F.lit("1.0")), "Q1"), (lambda: text.conference_rank(F.lit("A*")), "A_STAR"), (lambda: text.acronym(F.lit("Conf, X, ICML 2020")), "ICML"), (lambda: text.split_trimmed(F.lit("a; b;;c;;")), ["a", "b", "", "c"]),
        (lambda: text.locale_double(F.lit("1.234,56")), 1234.56), (lambda: text.locale_double(F.lit("1,234.56")), 1234.56), (lambda: text.points_category(F.lit(12.0)), "A*"), (lambda: text.json_bool(F.lit('{"a":"Yes"}'), "a"), True),
        (lambda: formula.compiled("max(2, 3) * (1 > 0 ? 4 : 5)", set()), 12.0), (lambda: years.years("2019,2021->2023,IY-1", F.lit(2000), 2024), [1999, 2019, 2021, 2022, 2023]), (lambda: years.allowed_years("IY", F.lit(2025), 2026), [2025, 2023]),
        (lambda: folds.best_since_gap(F.array(F.lit(100.0), F.lit(None).cast("double"), F.lit(50.0))), 50.0),
    ],
)
def test_functions(spark, made, wanted):
    assert one(spark, made()) == wanted


@pytest.mark.parametrize("bad", ["__import__('os')", "S; S", "S +", "exec(1)", "S ? 1", "((S)", "X", ""])
def test_formula_refuses(spark, bad):
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(formula.compiled(bad, {"S"})).collect()


def test_quartiles(spark):
    df = spark.createDataFrame([("g", i, float(10 - i)) for i in range(6)], "g string, id int, v double")
    assert [r.quarter for r in ranking.ranked(df, group=["g"], value="v", tie="id").orderBy("id").collect()] == ["Q1", "Q1", "Q2", "Q3", "Q3", "Q4"]


def test_enrichment(spark):
    rows = [("j1", 9.0, None, None, None), ("j2", 9.0, None, "Q4", None), ("j3", 7.5, 3, "Q3", 1)]
    df = spark.createDataFrame([("E", *r) for r in rows], "c string, j string, v double, rank int, quarter string, quartile_rank int")
    out = ranking.filled(df, key=["c", "j"], group=["c"], value="v", tie="j").orderBy("j").collect()
    assert [(r.rank, r.quarter, r.quartile_rank) for r in out] == [(1, "Q1", 1), (1, "Q4", 1), (3, "Q3", 1)]


@pytest.mark.parametrize(
    ("rows", "value", "conflicts"),
    [
        ([(1.1, "f", "v2023", "1"), (1.1, "g", "v2024", "8")], 1.1, 0), ([(2.5, "a_old", "v2023", "1"), (0.0, "b_new", "v2024", "8")], 2.5, 0), ([(1.1, "AIS", "v2023", "1"), (1.4, "AIS", "v2023", "2")], 1.1, 0), ([(0.8, "a", "v2022", "1"), (1.1, "b", "v2023", "2")], 1.1, 1),
    ],
)
def test_winner(spark, rows, value, conflicts):
    df = spark.createDataFrame([("k", "gov", *r) for r in rows], "k string, source string, value double, file string, version string, row string")
    r = folds.winners(df, key=["k"], value="value", source="source", file="file", version="version", row="row", preferred=F.lit(True)).first()
    assert (r.value, r.n_conflicts) == (value, conflicts)


def test_identity_against_union_find(spark, sf_dir):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    parts = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        for t in (f"n|{r.p_name}|{r.p_size}", f"{r.p_brand}|{r.p_type}|{r.p_size}"):
            root[find(t)] = find(r.p_partkey)
    least = {}
    for p in parts:
        least[find(p)] = min(p, least.get(find(p), p))
    assert {r.p_partkey: r.identity for r in queries.identity_resolution(spark, sf_dir).collect()} == {p: least[find(p)] for p in parts}
    chain = spark.createDataFrame([(i, t) for i in range(40) for t in (i, i + 1)], "k int, t int")
    assert {r.identity for r in identity.resolved(chain, key="k", token="t").collect()} == {0}


def test_as_of_and_h_index(spark):
    left = spark.createDataFrame([("a", 2010), ("a", 2020), ("b", 2010)], "k string, year int")
    right = spark.createDataFrame([("a", 2008, 1.0), ("a", 2012, 2.0), ("a", 2014, 3.0)], "k string, y int, v double")
    got = joins.nearest_year(left, right, key=["k"], year="year", right_year="y").collect()
    assert {(r.k, r.year): r.v for r in got} == {("a", 2010): 1.0, ("a", 2020): None, ("b", 2010): None}
    cited = spark.createDataFrame([("x", c) for c in (10, 8, 5, 4, 3)] + [("y", 0)], "k string, c int")
    assert {r.k: r.h_index for r in ranking.h_index(cited, key=["k"], cited="c").collect()} == {"x": 4, "y": 0}


FACTS = "journal string, year int, category string, metric string, value double, quarter string, rank int"


def test_scores(spark):
    facts = spark.createDataFrame([("j", 2023, "ECONOMICS - SCIE", "AIS", 1.9, "Q1", 1), ("j", 2023, "CS - SCIE", "AIS", 1.9, "Q3", None), ("j", 2023, "ARTS - AHCI", "AIS", 9.0, "Q1", 1), ("j", 2023, "CS - SCIE", "RIS", 3.0, None, None)], FACTS)
    items = spark.createDataFrame([("p", "j", 2023, "ar", None), ("q", "none", 2023, "ar", "eid"), ("r", "j", 2023, "cp", "eid")], "item string, journal string, year int, subtype string, eid string")
    ais = {r.item: (r.score, r.score_year, r.quarter) for r in scoring.metric(items, facts, "AIS").collect()}
    assert ais == {"p": (1.9, 2023, "Q1"), "q": (0.0, None, "NOT_FOUND"), "r": (0.0, None, "NOT_FOUND")}
    assert scoring.metric(items, facts, "RIS", quarter_of="AIS").where("item = 'p'").first().score == 3.0
    cuts = spark.createDataFrame([("ECONOMICS - SCIE", 2023, 20)], "category string, year int, cut int")
    cs = {r.item: (r.score, r.quarter, r.points_category) for r in scoring.journal_points(items, facts, cuts).collect()}
    assert cs == {"p": (12.0, "Q1", "A*"), "q": (2.0, "SCOPUS", "C"), "r": (0.0, "NOT_FOUND", None)}
    econ = {r.item: (r.score, r.m) for r in scoring.economics(items, facts, core=["ECONOMICS"], informatics=["CS"]).collect()}
    assert econ["p"] == (1.9, 10)
    flags = scoring.classification(items.withColumn("forum_name", F.lit("IEEE X")).withColumn("indexed", F.lit(True)), facts).collect()
    assert {r.item: (r.q1, r.ahci, r.ieee) for r in flags} == {"p": (True, True, False), "q": (False, False, False), "r": (False, False, True)}


def test_conferences_and_publishers(spark):
    items = spark.createDataFrame([("a", "Conf on X, ICX 2020", 2020, "cp"), ("b", "Lecture Notes in Y, ICX", 2020, "cp"), ("c", "Other, ZZ", 2020, "cp")], "item string, forum_name string, year int, subtype string")
    ranks = spark.createDataFrame([("ICX", "Conf on X", 2018, "A_STAR")], "acronym string, name string, year int, rank string")
    assert {r.item: r.score for r in scoring.conference_points(items, ranks).collect()} == {"a": 12.0, "b": 2.0, "c": 1.0}
    books = spark.createDataFrame([("a", "Springer", "bk"), ("b", "SPRINGER", "ch"), ("c", "none", "bk")], "item string, publisher string, subtype string")
    known = spark.createDataFrame([("springer", "A")], "name string, ranking string")
    assert {r.item: r.score for r in scoring.publisher_points(books, known).collect()} == {"a": 16.0, "b": 8.0, "c": 1.0}


def test_reports(spark):
    scored = spark.createDataFrame([("o", 1, f"i{i}", float(i), 2, "Q1", f"t{i // 2}") for i in range(24)], "owner string, indicator int, item string, score double, n_authors int, quarter string, title string")
    made = reports.author_scores(scored, "S * N")
    assert reports.indicator_totals(made, key=["owner", "indicator"]).first().total == 2 * sum(range(24))
    assert reports.indicator_totals(made, key=["owner", "indicator"], selector="TOP_10").first().total == 2 * sum(range(14, 24))
    assert reports.indicator_totals(made, key=["owner", "indicator"], selector="TOP_10", title="title").first().total == 2 * sum(range(5, 24, 2))
    config = spark.createDataFrame([("c", [1, 7])], "criterion string, indicators array<int>")
    sums = reports.criteria(reports.indicator_totals(made, key=["owner", "indicator"]), config)
    assert sums.first().n_missing == 1
    limits = spark.createDataFrame([("c", "LECTURER", 100.0), ("c", "PROFESSOR", 1000.0)], "criterion string, position string, threshold double")
    who = spark.createDataFrame([("o", "PROFESSOR")], "owner string, position string")
    assert reports.judged(sums.drop("n_missing"), limits, who).first().passed is False


def test_search_and_pages(spark):
    df = spark.createDataFrame([(1, "b_"), (2, None), (3, "B%x")], "id int, name string")
    assert [r.id for r in df.where(search.contains_any(["name"], "%")).collect()] == [3]
    p = search.page(df, sort="name", allowed=["name"], tie="id", direction="desc", number=9, size=2, clamp=True)
    assert (p.total, p.pages, p.page, len(p.items.collect())) == (3, 2, 1, 1)
    with pytest.raises(ValueError):
        search.page(df, sort="id; drop", allowed=["name"], tie="id")
    with pytest.raises(ValueError):
        search.query("x" * 101)


def test_ledger(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, p string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, p string")
    got = {r.k: (r.p, r.outcome) for r in ledger.upserted(old, new, key=["k"], payload=["p"]).collect()}
    assert got == {"a": ("1", "skipped"), "b": ("2", "updated"), "c": ("1", "kept"), "d": ("1", "imported")}
    states = spark.createDataFrame([("k", 1, "x", "LINKED", False), ("k", 2, "y", "LINKED", False), ("k", 3, "z", "LINKED", False), ("l", 1, None, "UNMATCHED", False)], "k string, o int, t string, s string, r boolean")
    got = {r.k: (r.state, r.target, r.n_relinks) for r in folds.link_states(states, key=["k"], order=["o"], target="t", state="s", replay="r").collect()}
    assert got == {"k": ("CONFLICT", "x", 1), "l": ("UNMATCHED", None, 0)}


def test_views(spark, tmp_path):
    journals = spark.createDataFrame([("j", "J"), ("k", "K")], "journal string, name string")
    metrics = spark.createDataFrame([("j", 2020, "AIS", 1.0), ("j", 2021, "AIS", None)], "journal string, year int, metric string, value double")
    cats = spark.createDataFrame([("j", 2020, "AIS", "C", "SCIE", "v1", "1"), ("j", 2021, "AIS", "C", "ESCI", "v2", "1")], "journal string, year int, metric string, category string, edition string, version string, row string")
    assert [(r.journal, r.latest_ais_year, r.latest_edition) for r in views.ranking_view(journals, metrics, cats).collect()] == [("j", 2020, "ESCI")]
    out = f"{tmp_path}/t"
    assert views.swap(journals, out, 2) == views.swap(journals, out) == 2
    with pytest.raises(ValueError):
        views.swap(journals.limit(1), out, 2)
    assert spark.read.parquet(out).count() == 2
    state, run = {}, lambda: views.synced(spark, {"s": (journals, ["name"], lambda df: None)}, state)
    assert (run(), run()) == ([("s", "rebuilt")], [("s", "skipped")])


def test_files(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "AIS_2020.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Title</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1"><v>h</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "AIS_2021.xlsx").write_bytes(b"no workbook")
    rows = xlsx.read(spark, str(tmp_path)).collect()
    assert sorted((r.cells or [], r.error is None) for r in rows) == [([], False), (["Title", None, "2.5"], True)]
    event = files.metric_events(xlsx.read(spark, str(tmp_path))).first()
    assert (event.source_version, event.payload) == ("v2020", '{"metricType":"AIS","year":2020,"cells":{"c0":"Title","c1":"","c2":"2.5"}}')
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert [(r.row_item, r.payload) for r in files.json_items(spark, f"{tmp_path}/a.json").orderBy("row_item").collect()] == [(0, '{"x":1}'), (1, '{"x":2}')]
    df = spark.createDataFrame([('{"a": {"0": "x", "1": "y"}, "b": {"1": "z"}}',)], "j string")
    assert sorted(tuple(r) for r in files.columnar(df, "j", ["a", "b"]).fillna("-").collect()) == [("0", "x", "-"), ("1", "y", "z")]
    (tmp_path / "roster.csv").write_text("group,email,lastName,firstName,position,ids\ng,a@b.co,L,F,CS I,1;2;1\n")
    assert files.roster(spark, f"{tmp_path}/roster.csv").first().ids == ["1", "2"]
    (tmp_path / "bad.csv").write_text("g,nomail,L,F,P\n")
    with pytest.raises(ValueError):
        files.roster(spark, f"{tmp_path}/bad.csv")


def test_stream(spark, tmp_path):
    schema = "k string, p string"
    src, led, cp = (f"{tmp_path}/{x}" for x in ("src", "ledger", "cp"))
    for rows in ([("a", "1"), ("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream.follow(spark, src, schema, ledger=led, checkpoint=cp, key=["k"], payload=["p"]).awaitTermination()
    assert sorted((r.k, r.p) for r in stream.read(spark, led, schema).collect()) == [("a", "1"), ("b", "1"), ("b", "2")]
