"""The scoring strategies and reports on facts made of the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import ranking, scoring
from .plans import reports, views
from .queries import query, table

_METRICS = {0: "AIS", 1: "RIS", 2: "IF"}
_INDEXES = {0: " - SCIE", 1: " - SSCI", 2: " - ESCI", 3: " - AHCI"}

#: Items, facts and cuts as all of these queries take them.
WITH = """
WITH items AS (SELECT o_orderkey item, o_custkey % 40 journal, year(o_orderdate)::INT AS year, ['ar', 're', 'cp', 'ch'][(o_orderkey % 4 + 1)::INT] subtype, CASE WHEN o_orderkey % 5 > 0 THEN 'e' || o_orderkey END eid FROM orders),
facts AS (SELECT l_partkey % 40 journal, year(l_shipdate)::INT AS year, p_brand || [' - SCIE', ' - SSCI', ' - ESCI', ' - AHCI'][(p_size % 4 + 1)::INT] category, ['AIS', 'RIS', 'IF'][(l_linenumber % 3 + 1)::INT] metric, max(l_quantity)::INT q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
f AS (SELECT journal, year, category, metric, q / 10.0::DOUBLE AS value, CASE WHEN q % 11 > 0 THEN 'Q' || (1 + q % 4) END AS quarter, CASE WHEN q % 7 > 0 THEN q % 5 END AS rank FROM facts),
ok AS (SELECT * FROM f WHERE category LIKE '% - SCIE' OR category LIKE '% - SSCI'),
arts AS (SELECT * FROM items WHERE subtype IN ('ar', 're'))"""


def items(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("ar", "re", "cp", "ch")))
    return o.select(k.alias("item"), (F.col("o_custkey") % 40).alias("journal"), F.year("o_orderdate").alias("year"), F.get(kinds, (k % 4).cast("int")).alias("subtype"), F.when(k % 5 > 0, F.concat(F.lit("e"), k.cast("string"))).alias("eid"))


def facts(spark, d):
    lines, parts = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_linenumber", "l_quantity"), table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    pick = lambda n, of: F.get(F.array(*(F.lit(of[i]) for i in sorted(of))), n.cast("int"))
    made = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy((F.col("l_partkey") % 40).alias("journal"), F.year("l_shipdate").alias("year"), F.concat("p_brand", pick(F.col("p_size") % 4, _INDEXES)).alias("category"), pick(F.col("l_linenumber") % 3, _METRICS).alias("metric")).agg(F.max("l_quantity").cast("int").alias("q"))
    q = F.col("q")
    return made.select("journal", "year", "category", "metric", (q / F.lit(10.0)).alias("value"), F.when(q % 11 > 0, F.concat(F.lit("Q"), (1 + q % 4).cast("string"))).alias("quarter"), F.when(q % 7 > 0, q % 5).alias("rank"))


def _ranked(rows: str, tie: str = "") -> str:
    """Rows (item, score, category, quarter) in the order in which an item takes them."""
    return f"b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, {tie} coalesce(quarter[2:]::INT, 9), category DESC) i FROM ({rows}) WHERE score > 0)"


def _picked(columns: str = "") -> str:
    """The items, each with its first row of b."""
    return f"SELECT items.*, coalesce(b.score, 0) score, CASE WHEN b.item IS NOT NULL THEN items.year END score_year, b.category, coalesce(b.quarter, 'NOT_FOUND') AS quarter{columns} FROM items LEFT JOIN b ON b.item = items.item AND i = 1"


def _rows(name: str, quarter_of: str) -> str:
    return f"SELECT item, arts.year, category, max(CASE WHEN metric = '{name}' THEN value END) score, min(CASE WHEN metric = '{quarter_of}' THEN quarter END) AS quarter FROM arts JOIN ok USING (journal, year) GROUP BY 1, 2, 3"


def _metric(name: str, quarter_of: str) -> str:
    return f"{WITH}, {_ranked(_rows(name, quarter_of))} {_picked()}"


@query(_metric("AIS", "AIS"))
def score_ais(spark, d):
    """The best article influence score of an item's journal, with its quarter."""
    return scoring.metric(items(spark, d), facts(spark, d), "AIS")


@query(_metric("RIS", "AIS"))
def score_ris(spark, d):
    """R2: the best relative influence score, with the quarter of the article influence score."""
    return scoring.metric(items(spark, d), facts(spark, d), "RIS", quarter_of="AIS")


@query(_metric("IF", "IF"))
def score_impact_factor(spark, d):
    """R3"""
    return scoring.metric(items(spark, d), facts(spark, d), "IF")


_CUTS = "cuts AS (SELECT category, year, floor(count(DISTINCT journal) * 0.2)::BIGINT cut FROM f WHERE metric = 'AIS' AND quarter = 'Q1' GROUP BY 1, 2)"
_R4 = f"""{_CUTS}, p AS (SELECT item, category, ok.quarter, CASE WHEN rank < coalesce(cut, 0) THEN CASE ok.quarter WHEN 'Q1' THEN 12 WHEN 'Q2' THEN 8 WHEN 'Q3' THEN 4 WHEN 'Q4' THEN 2 END
ELSE CASE ok.quarter WHEN 'Q1' THEN 8 WHEN 'Q2' THEN 4 WHEN 'Q3' THEN 2 WHEN 'Q4' THEN 2 END END::DOUBLE score FROM arts JOIN ok USING (journal, year) LEFT JOIN cuts USING (category, year) WHERE metric = 'AIS'),
s AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, quarter, category DESC) i FROM p WHERE score > 0),
r4 AS (SELECT items.*, coalesce(s.score, CASE WHEN eid IS NOT NULL AND subtype IN ('ar', 're') THEN 2 ELSE 0 END)::DOUBLE score, s.item IS NULL AND eid IS NOT NULL AND subtype IN ('ar', 're') fell, category, s.quarter FROM items LEFT JOIN s ON s.item = items.item AND i = 1)"""


def cuts(spark, d):
    first = ranking.top_count(facts(spark, d).where("metric = 'AIS' and quarter = 'Q1'"), group=["category", "year"], entity="journal")
    return first.select("category", "year", "cut")


@query(f"""{WITH}, {_R4} SELECT item, journal, year, subtype, eid, score, CASE WHEN fell THEN 2023 WHEN score > 0 THEN year END score_year, category, CASE WHEN fell THEN 'SCOPUS' ELSE coalesce(quarter, 'NOT_FOUND') END AS quarter,
CASE score WHEN 12 THEN 'A*' WHEN 8 THEN 'A' WHEN 4 THEN 'B' WHEN 2 THEN 'C' WHEN 1 THEN 'D' END points_category FROM r4""")
def score_cs_journal(spark, d):
    """Points of a quarter, more within the top fifth of a category's first-quarter journals."""
    return scoring.journal_points(items(spark, d), facts(spark, d), cuts(spark, d))


_R5 = """k AS (SELECT DISTINCT replace(p_brand, 'Brand#', 'CONF') acronym, p_brand || ' on ' || split_part(p_type, ' ', 1) AS name, 1990 + p_size % 10 rank_year, ['A_STAR', 'A', 'B', 'C', 'D'][(p_size % 5 + 1)::INT] r FROM part),
kk AS (SELECT name, acronym, rank_year, min(r) r FROM k GROUP BY 1, 2, 3), many AS (SELECT acronym, count(DISTINCT name) n FROM k GROUP BY 1),
papers AS (SELECT item, year, subtype, CASE WHEN item % 9 = 0 THEN 'Lecture Notes in ' ELSE '' END || 'Brand#' || (11 + item % 45) || ' on ' || ['PROMO', 'SMALL', 'LARGE'][(item % 3 + 1)::INT] || ', CONF' || (11 + item % 45) || ' ' || year forum_name FROM items),
x AS (SELECT item, papers.year, kk.r, row_number() OVER (PARTITION BY item, kk.name ORDER BY abs(rank_year - papers.year), rank_year) i FROM papers JOIN kk ON split_part(split_part(forum_name, ', ', -1), ' ', 1) = kk.acronym JOIN many USING (acronym) WHERE (n = 1 OR contains(lower(forum_name), lower(name))) AND abs(rank_year - papers.year) <= 5),
m AS (SELECT item, max(CASE r WHEN 'A_STAR' THEN 12 WHEN 'A' THEN 8 WHEN 'B' THEN 4 WHEN 'C' THEN 2 ELSE 1 END)::DOUBLE p FROM x WHERE i = 1 GROUP BY 1),
r5 AS (SELECT papers.*, CASE WHEN subtype = 'cp' AND forum_name LIKE 'Lecture Notes in %' THEN 2 WHEN subtype = 'cp' THEN coalesce(p, 1) ELSE 1 END::DOUBLE score FROM papers LEFT JOIN m USING (item))"""


def papers(spark, d):
    k, n = F.col("item"), (11 + F.col("item") % 45).cast("string")
    kinds = F.get(F.array(*map(F.lit, ("PROMO", "SMALL", "LARGE"))), (k % 3).cast("int"))
    name = F.concat(F.when(k % 9 == 0, "Lecture Notes in ").otherwise(""), F.lit("Brand#"), n, F.lit(" on "), kinds, F.lit(", CONF"), n, F.lit(" "), F.col("year").cast("string"))
    return items(spark, d).select("item", "year", "subtype", name.alias("forum_name"))


def conference_ranks(spark, d):
    ranks = F.get(F.array(*map(F.lit, ("A_STAR", "A", "B", "C", "D"))), (F.col("p_size") % 5).cast("int"))
    return table(spark, d, "part").select(F.regexp_replace("p_brand", "Brand#", "CONF").alias("acronym"), F.concat("p_brand", F.lit(" on "), F.split("p_type", " ")[0]).alias("name"), (1990 + F.col("p_size") % 10).alias("year"), ranks.alias("rank"))


@query(f"{WITH}, {_R5} SELECT item, year, subtype, forum_name, score FROM r5")
def score_cs_conference(spark, d):
    """Points of the conference's rank in the nearest year; lecture notes have two."""
    return scoring.conference_points(papers(spark, d), conference_ranks(spark, d)).drop("acronym")


@query(f"{WITH}, {_R4}, {_R5} SELECT item, CASE WHEN subtype IN ('ar', 're') THEN r4.score WHEN subtype = 'cp' THEN r5.score ELSE 0 END score FROM r4 JOIN r5 USING (item, subtype)")
def score_computer_science(spark, d):
    """Each kind of item by its own strategy."""
    both = items(spark, d).join(papers(spark, d).select("item", "forum_name"), "item")
    return scoring.computer_science(both, facts(spark, d), cuts(spark, d), conference_ranks(spark, d)).select("item", "score")


_BOOKS = """b AS (SELECT l_orderkey * 10 + l_linenumber item, CASE WHEN l_linenumber % 3 = 0 THEN 'ch' WHEN l_linenumber % 3 = 1 THEN 'bk' ELSE 'ar' END subtype, upper(s_name) publisher FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
pub AS (SELECT lower(s_name) p, min(['A', 'B', 'C', 'D'][(s_nationkey % 4 + 1)::INT]) r FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY 1)"""


def _books(spark, d):
    lines, k = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), F.col("l_linenumber") % 3
    names = table(spark, d, "supplier").select("s_suppkey", F.upper("s_name").alias("publisher"))
    return lines.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.when(k == 0, "ch").when(k == 1, "bk").otherwise("ar").alias("subtype"), "publisher")


def _publishers(spark, d):
    letters = F.get(F.array(*map(F.lit, "ABCD")), (F.col("s_nationkey") % 4).cast("int"))
    return table(spark, d, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_name").alias("name"), letters.alias("ranking"))


@query(f"WITH {_BOOKS} SELECT b.*, CASE subtype WHEN 'bk' THEN 1 WHEN 'ch' THEN 0.5 ELSE 0 END * CASE r WHEN 'A' THEN 16 WHEN 'B' THEN 8 WHEN 'C' THEN 4 ELSE 1 END::DOUBLE score FROM b LEFT JOIN pub ON lower(publisher) = p")
def score_books(spark, d):
    """Points of a publisher's rank, halved for chapters."""
    return scoring.publisher_points(_books(spark, d), _publishers(spark, d))


@query(f"WITH {_BOOKS} SELECT b.*, (CASE subtype WHEN 'bk' THEN 1 WHEN 'ch' THEN 0.5 ELSE 0 END * CASE WHEN p IS NULL THEN 0 ELSE 1 END)::DOUBLE score FROM b LEFT JOIN pub ON lower(publisher) = p")
def score_listed_publishers(spark, d):
    """Whether a publisher is listed at all, halved for chapters."""
    return scoring.publisher_points(_books(spark, d), _publishers(spark, d), listed_only=True)


_M = "CASE WHEN category[:8] IN ('Brand#11', 'Brand#23') THEN 10 WHEN category[:8] IN ('Brand#34') THEN 8 ELSE 6 END"


_ECONOMICS = f"SELECT item, category, quarter, value score, {_M} m FROM arts JOIN ok USING (journal, year) WHERE metric = 'AIS'"


@query(f"{WITH}, {_ranked(_ECONOMICS, 'm DESC,')} {_picked(', CASE WHEN b.item IS NOT NULL THEN m END m')}")
def score_economics(spark, d):
    """Of equal article influence scores that with the larger multiplier."""
    return scoring.economics(items(spark, d), facts(spark, d), core=["Brand#11", "Brand#23"], informatics=["Brand#34"])


@query("""WITH i AS (SELECT c_custkey item, c_nationkey university, (2015 + c_custkey % 10)::INT AS year FROM customer), r AS (SELECT s_nationkey university, (2012 + s_suppkey % 13)::INT AS year, min(100 + s_suppkey % 37)::DOUBLE r FROM supplier GROUP BY 1, 2),
y AS (SELECT item, university, year, unnest(range(year - 3, year + 1)) y FROM i), yy AS (SELECT item, university, y FROM y UNION SELECT item, university, 2023 FROM i WHERE year - 3 > 2023), v AS (SELECT item, y, r FROM yy LEFT JOIN r ON r.university = yy.university AND r.year = y),
g AS (SELECT item, max(CASE WHEN r IS NULL THEN y END) gap FROM v GROUP BY 1) SELECT i.item, i.university, i.year, coalesce((SELECT min(r) FROM v JOIN g USING (item) WHERE v.item = i.item AND y > coalesce(gap, 0)), 0) score FROM i""")
def score_university(spark, d):
    """The best rank of a university since the last year without one."""
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("university"), (2015 + F.col("c_custkey") % 10).cast("int").alias("year"))
    ranks = table(spark, d, "supplier").select(F.col("s_nationkey").alias("university"), (2012 + F.col("s_suppkey") % 13).cast("int").alias("year"), (100 + F.col("s_suppkey") % 37).alias("rank"))
    return scoring.university(who, ranks, window="IY-3->IY")


@query("SELECT event_id, CASE WHEN k > 50 THEN k * 2 ELSE greatest(k, 10) END::DOUBLE score FROM (SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) k FROM events)")
def score_activities(spark, d):
    """A formula over the fields of an activity."""
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("fields"))
    return scoring.activities(e, "k > 50 ? k * 2 : max(k, 10)", ["k"]).select("event_id", "score")


@query(f"{WITH} SELECT journal, coalesce(min(quarter), 'NOT_FOUND') AS quarter FROM f WHERE metric IN ('AIS', 'IF') GROUP BY 1")
def best_quarters(spark, d):
    """R16"""
    return scoring.best_quarter(facts(spark, d))


@query(f"""{WITH}, n AS (SELECT *, CASE WHEN item % 3 = 0 THEN 'IEEE Days' WHEN item % 3 = 1 THEN 'Lecture Notes' END forum_name, item % 2 = 0 indexed FROM items),
c AS (SELECT item, bool_or(coalesce(f.quarter = 'Q1', false) AND (category LIKE '%SCIE' OR category LIKE '%SSCI')) q1, bool_or(coalesce(f.quarter = 'Q2', false) AND (category LIKE '%SCIE' OR category LIKE '%SSCI')) q2, bool_or(coalesce(f.quarter = 'Q3', false) AND (category LIKE '%SCIE' OR category LIKE '%SSCI')) q3,
bool_or(coalesce(f.quarter = 'Q4', false) AND (category LIKE '%SCIE' OR category LIKE '%SSCI')) q4, bool_or(category LIKE '%ESCI') esci, bool_or(category LIKE '%AHCI') ahci, bool_or(category NOT LIKE '%ESCI' AND category NOT LIKE '%AHCI') erih FROM n JOIN f USING (journal, year) WHERE subtype IN ('ar', 're') AND metric = 'AIS' GROUP BY 1),
a AS (SELECT n.item, coalesce(q1, false) q1, coalesce(q2, false) q2, coalesce(q3, false) q3, coalesce(q4, false) q4, coalesce(esci, false) esci, coalesce(ahci, false) ahci, coalesce(erih, false) erih, subtype = 'cp' AND coalesce(forum_name, '') LIKE 'IEEE%' ieee,
subtype = 'cp' AND coalesce(forum_name, '') NOT LIKE 'IEEE%' AND indexed isi_proceedings, subtype IN ('ch', 'cp') AND coalesce(forum_name, '') LIKE 'Lecture Notes%' lecture_notes, eid FROM n LEFT JOIN c USING (item))
SELECT *, CASE WHEN q1 THEN 'q1' WHEN q2 THEN 'q2' WHEN q3 THEN 'q3' WHEN q4 THEN 'q4' WHEN esci THEN 'esci' WHEN ahci THEN 'ahci' WHEN erih THEN 'erih' WHEN isi_proceedings THEN 'isi_proceedings' WHEN ieee THEN 'ieee' WHEN lecture_notes THEN 'lecture_notes' END class FROM a WHERE eid IS NOT NULL""")
def classification_export(spark, d):
    """Flags by quarter and index, and the first one as the class of what is exported."""
    k = F.col("item")
    named = items(spark, d).withColumns({"forum_name": F.when(k % 3 == 0, "IEEE Days").when(k % 3 == 1, "Lecture Notes"), "indexed": k % 2 == 0, "doi": F.col("eid"), "wos_id": F.lit(" ")})
    flags = ["q1", "q2", "q3", "q4", "esci", "ahci", "erih", "ieee", "isi_proceedings", "lecture_notes"]
    return scoring.export_class(scoring.classification(named, facts(spark, d))).select("item", *flags, "eid", "class")


_OWN = f"""{WITH}, {_ranked(_rows("AIS", "AIS"))}, scored AS ({_picked()}), o AS (SELECT item % 25 AS owner, item, journal % 7 AS title, round(score * 1000)::BIGINT s, score, (1 + item % 3)::DOUBLE n, quarter FROM scored),
w AS (SELECT *, CASE WHEN score > 0 THEN CASE WHEN n > 2 THEN s / n ELSE s * 1.0 END ELSE 0 END v FROM o)"""


def _scored(spark, d):
    found = scoring.metric(items(spark, d), facts(spark, d), "AIS")
    return reports.author_scores(found.withColumns({"owner": F.col("item") % 25, "title": F.col("journal") % 7, "n_authors": 1 + F.col("item") % 3, "score": F.round(F.col("score") * 1000)}), "N > 2 ? S / N : S")


@query(f"{_OWN} SELECT owner, count(*) n, sum(round(v * 1000)::BIGINT)::BIGINT total FROM w GROUP BY 1")
def indicator_all(spark, d):
    """Every author's score by a formula, and totals of an indicator."""
    exact = _scored(spark, d).withColumn("author_score", F.round(F.col("author_score") * 1000).cast("long"))
    return reports.indicator_totals(exact, key=["owner"]).select("owner", "n", F.col("total").cast("long").alias("total"))


@query(f"""{_OWN}, t AS (SELECT owner, title, max(round(v * 1000)::BIGINT) v FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY v DESC) i FROM t) SELECT owner, count(*) n, sum(v)::BIGINT total FROM r WHERE i <= 5 GROUP BY 1""")
def indicator_top_titles(spark, d):
    """The best five, each title once."""
    exact = _scored(spark, d).withColumn("author_score", F.round(F.col("author_score") * 1000).cast("long"))
    best = ranking.top_titles(exact, group=["owner"], title="title", score="author_score", tie="item", n=5)
    return best.groupBy("owner").agg(F.count("*").alias("n"), F.sum("author_score").alias("total"))


_TOTALS = "t AS (SELECT o_custkey % 20 AS owner, (o_orderkey % 4)::INT indicator, count(*)::BIGINT total FROM orders GROUP BY 1, 2), c AS (SELECT * FROM (VALUES ('a', 0), ('a', 1), ('a', 9), ('b', 2), ('b', 3)) v(criterion, indicator))"
_CRITERIA = f"{_TOTALS}, s AS (SELECT owner, criterion, sum(total)::BIGINT score FROM t JOIN c USING (indicator) GROUP BY 1, 2)"


def _criteria(spark, d):
    totals = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("owner"), (F.col("o_orderkey") % 4).cast("int").alias("indicator")).agg(F.count("*").alias("total"))
    return reports.criteria(totals, spark.createDataFrame([("a", [0, 1, 9]), ("b", [2, 3])], "criterion string, indicators array<int>"))


@query(f"WITH {_CRITERIA} SELECT owner, criterion, score, CASE criterion WHEN 'a' THEN 1 ELSE 0 END::BIGINT n_missing FROM s")
def criterion_scores(spark, d):
    """Indicators summed by criterion; those that are missing are counted."""
    return _criteria(spark, d)


@query(f"""WITH {_CRITERIA}, l AS (SELECT owner, criterion, score, CASE WHEN criterion = 'a' THEN CASE WHEN owner % 3 = 0 THEN 60 WHEN owner % 3 = 1 THEN 30 ELSE 60 END ELSE CASE WHEN owner % 3 = 1 THEN 40 ELSE 40 END END::BIGINT threshold FROM s) SELECT *, score >= threshold passed FROM l""")
def thresholds_met(spark, d):
    """Criteria against the thresholds of each owner's position, or the first where it has none."""
    limits = spark.createDataFrame([("a", "CONF", 60), ("a", "LECT", 30), ("b", "LECT", 40)], "criterion string, position string, threshold long")
    k = F.col("owner")
    who = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("owner")).distinct().select("owner", F.when(k % 3 == 0, "CONF").when(k % 3 == 1, "LECT").otherwise("PROF").alias("position"))
    return reports.judged(_criteria(spark, d).select("owner", "criterion", "score"), limits, who)


@query("""WITH e AS (SELECT user_id AS owner, count(*) n FROM events WHERE event_type = 'click' AND value > 95 GROUP BY 1), r AS (SELECT user_id AS owner, count(*) n FROM events WHERE value < 60 GROUP BY 1)
SELECT coalesce(r.owner, e.owner) AS owner, CASE WHEN r.n IS NULL THEN 'FAILED' WHEN e.n > 0 THEN 'PARTIAL' ELSE 'READY' END status, coalesce(r.n, 0) n_results, coalesce(e.n, 0) n_errors FROM r FULL JOIN e ON r.owner = e.owner""")
def run_states(spark, d):
    """P18, A30"""
    e = table(spark, d, "events").withColumnRenamed("user_id", "owner")
    return reports.run_status(e.where("event_type = 'click' AND value > 95"), e.where("value < 60"))


@query(f"{WITH} SELECT a.journal, a.year, a.metric, a.category, b.value FROM f a LEFT JOIN (SELECT journal, year, metric, max(value) AS value FROM f WHERE category LIKE '%SCIE' GROUP BY 1, 2, 3) b USING (journal, year, metric)")
def scoring_rows(spark, d):
    """Every category fact with its journal's metric of the year."""
    every = facts(spark, d)
    metrics = every.where("category LIKE '%SCIE'").groupBy("journal", "year", "metric").agg(F.max("value").alias("value"))
    return views.scoring_view(every.select("journal", "year", "metric", "category"), metrics)


@query(f"""{WITH}, j AS (SELECT DISTINCT c_custkey % 50 AS journal FROM customer), l AS (SELECT journal, max(CASE WHEN metric = 'AIS' THEN year END) a, max(CASE WHEN metric = 'RIS' THEN year END) r, max(CASE WHEN metric = 'IF' THEN year END) i FROM f WHERE value > 2 GROUP BY 1),
e AS (SELECT journal, arg_max(split_part(category, ' - ', 2), (year, category)) FILTER (metric = 'AIS') a, arg_max(split_part(category, ' - ', 2), (year, category)) FILTER (metric = 'RIS') r FROM f GROUP BY 1)
SELECT j.journal, l.a latest_ais_year, l.r latest_ris_year, l.i latest_if_year, coalesce(e.a, e.r, 'UNKNOWN') latest_edition FROM j LEFT JOIN l USING (journal) LEFT JOIN e USING (journal) WHERE l.journal IS NOT NULL OR e.journal IS NOT NULL""")
def ranking_rows(spark, d):
    """Journals with the last year of each metric and the latest edition; those without facts go."""
    every = facts(spark, d)
    journals = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("journal")).distinct()
    return views.ranking_view(journals, every.where("value > 2"), every.withColumns({"edition": F.split("category", " - ")[1], "version": F.col("category"), "row": F.lit(0)}))


@query("""WITH c AS (SELECT l_partkey cited, list_sort(list(DISTINCT l_suppkey::VARCHAR)) ids FROM lineitem GROUP BY 1) SELECT p_partkey id, coalesce(CASE WHEN p_size > 25 THEN p_size END, len(ids), 0)::INT cited_by_count, coalesce(array_to_string(ids, ','), '') citing FROM part LEFT JOIN c ON cited = p_partkey""")
def publication_rows(spark, d):
    """Publications with the ids that cite them, and their count where none is given."""
    pubs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_size")).cast("int").alias("cited_by_count"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cited"), F.col("l_suppkey").cast("string").alias("citing"))
    return views.publication_view(pubs, edges).select("id", "cited_by_count", F.array_join("citing_ids", ",").alias("citing"))


@query(f"""{WITH}, e AS (SELECT journal, year, category, value FROM f WHERE metric = 'AIS'), a AS (SELECT journal, year, category, CASE WHEN value > 3 THEN value + 0.5 ELSE value END AS value FROM e WHERE journal % 9 > 0)
SELECT e.journal, e.year, e.category, e.value AS expected, a.value actual FROM e LEFT JOIN a USING (journal, year, category) WHERE (a.value IS NULL OR abs(a.value - e.value) > 1e-8) AND e.year <> 1995""")
def parity_rows(spark, d):
    """What differs from what is expected, unless it is allowed to."""
    e = facts(spark, d).where("metric = 'AIS'").select("journal", "year", "category", "value")
    a = e.where("journal % 9 > 0").withColumn("value", F.when(F.col("value") > 3, F.col("value") + 0.5).otherwise(F.col("value")))
    return views.parity(a, e, key=["journal", "year", "category"], value="value", allowed=e.where("year = 1995").select("journal", "year", "category").distinct())
