"""Searches, lookups, traversals, read views and text functions on the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import lookups, search
from .plans import intake
from .queries import query, table
from .sources import files

# Lookups and traversals


@query("""WITH j AS (SELECT p_partkey journal, '1000-' || lpad((p_partkey % 900)::VARCHAR, 3, '0') || 'x' a, lpad((p_partkey * 7 % 5000)::VARCHAR, 8, '2') b, CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE '3000-' || lpad((p_size)::VARCHAR, 4, '0') END c FROM part),
e AS (SELECT journal, regexp_replace(upper(unnest([a, b, c])), '[- ]', '', 'g') n FROM j), g AS (SELECT DISTINCT n issn, journal FROM e WHERE regexp_matches(n, '^[0-9]{7}[0-9X]$'))
SELECT DISTINCT c_custkey, journal FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '1000' || lpad((c_custkey % 900)::VARCHAR, 3, '0') || 'X' ELSE '3000' || lpad((c_custkey % 50)::VARCHAR, 4, '0') END q FROM customer) JOIN g ON q = issn""")
def journals_by_issn(spark, d):
    """Journals by any of their ISSNs: print, electronic or alternative. q follows from c_custkey, so no pair comes twice."""
    k = F.col("p_partkey")
    pad = lambda c, n, fill="0": F.lpad(c.cast("string"), n, fill)
    journals = table(spark, d, "part").select(k.alias("journal"), F.concat(F.lit("1000-"), pad(k % 900, 3), F.lit("x")).alias("issn"), pad(k * 7 % 5000, 8, "2").alias("eissn"), F.array(F.when(F.col("p_size") % 3 == 0, "N/A").otherwise(F.concat(F.lit("3000-"), pad(F.col("p_size"), 4)))).alias("others"))
    c = F.col("c_custkey")
    asked = table(spark, d, "customer").select("c_custkey", F.when(c % 2 == 0, F.concat(F.lit("1000"), pad(c % 900, 3), F.lit("x"))).otherwise(F.concat(F.lit("3000-"), pad(c % 50, 4))).alias("q"))
    return lookups.by_issn(asked, lookups.issn_bridge(journals, journal="journal", numbers=["issn", "eissn"], lists=["others"]), issn="q").select("c_custkey", "journal")


@query("SELECT DISTINCT c_custkey AS start, l_partkey AS \"end\" FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 5000")
def publications_of_authors(spark, d):
    """Two hops along edges, each pair once."""
    start = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    return lookups.reached(start, (table(spark, d, "orders"), "o_custkey", "o_orderkey"), (table(spark, d, "lineitem"), "l_orderkey", "l_partkey"))


@query("SELECT c_custkey id FROM customer WHERE c_custkey % 3 = 0 UNION SELECT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0")
def canonical_ids(spark, d):
    """Ids and what they are aliases of."""
    return lookups.with_canonical(table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")), table(spark, d, "orders"), alias="o_custkey", canonical="o_orderkey")


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 20 THEN p_brand END, p_name, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type END], lambda x: x IS NOT NULL AND trim(x) <> ''), '|') ids FROM part")
def author_keys(spark, d):
    """The ids of some sources in order, each once."""
    p = table(spark, d, "part")
    ids = lookups.all_ids(F.array(F.when(F.col("p_size") > 20, F.col("p_brand")), F.col("p_name")), F.array(F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_type")), F.col("p_name")))
    return p.select("p_partkey", F.array_join(ids, "|").alias("ids"))


@query("SELECT p_partkey id, p_size AS size, l_suppkey citing_id, s_name citing_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size > 40 AND s_nationkey > 5")
def citations_of(spark, d):
    """Cited rows with those that cite them; unknown ones are left out."""
    cited = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cited"), F.col("l_suppkey").alias("citing"))
    return lookups.cited_and_citing(cited, edges, table(spark, d, "supplier").where("s_nationkey > 5").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), key="id")


@query("SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: list_contains(string_split(lower(p_type), ' '), x) OR starts_with(x, 'b') AND x IN ('blue', 'black')))::INT n FROM part")
def affiliated_counts(spark, d):
    """Elements among others, repeats counted."""
    p = table(spark, d, "part")
    others = F.concat(F.split(F.lower("p_type"), " "), F.array(F.lit("blue"), F.lit("black")))
    return p.select("p_partkey", lookups.shared_count(F.split("p_name", " "), others).alias("n"))


@query("SELECT DISTINCT p_type FROM part WHERE trim(p_type) <> ''")
def type_list(spark, d):
    """A27, Y2"""
    return lookups.values_of(table(spark, d, "part"), "p_type")


@query("SELECT 'customer' AS name, count(*) n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def verification_counts(spark, d):
    """A29"""
    return lookups.row_counts({n: table(spark, d, n) for n in ("part", "orders", "customer")})


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority))[:3], ',') wrong FROM orders GROUP BY 1")
def first_mismatches(spark, d):
    """G8"""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(lookups.mismatches(None, "o_orderpriority", 3), ",").alias("wrong"))


# Filters and orders


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'blue') OR p_type ILIKE '%s_all%'")
def raw_search(spark, d):
    """An element of an array, or a text whose marks are wildcards."""
    p = table(spark, d, "part").withColumn("words", F.split("p_name", " "))
    return p.where(search.holding("words", "blue") | search.matching("p_type", "s_all")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'ur') AND o_orderdate BETWEEN '1993-01-01' AND '1996-06-30'")
def faceted_links(spark, d):
    """Facets that are given, within times."""
    return table(spark, d, "orders").where(search.facets(equal={"o_orderstatus": "O", "o_custkey": None}, contains={"o_orderpriority": " UR ", "o_orderstatus": ""}, between=("o_orderdate", "1993-01-01", "1996-06-30"))).select("o_orderkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND trim(p_type) <> ''")
def supported_rows(spark, d):
    """F10"""
    return table(spark, d, "part").where(search.present("p_brand", ["Brand#11", "Brand#12"]) & search.present("p_type")).select("p_partkey", "p_brand")


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 3 = l_partkey % 3 main FROM lineitem WHERE year(l_shipdate) BETWEEN 1994 AND 1996")
def roles_in_years(spark, d):
    """Whether the first author is one of mine, within years."""
    lines = table(spark, d, "lineitem").withColumns({"authors": F.array(F.col("l_suppkey") % 3, F.lit(0)), "mine": F.array(F.col("l_partkey") % 3), "date": F.date_format("l_shipdate", "yyyy-MM-dd")})
    return lines.where(search.in_years("date", 1994, 1996)).select("l_orderkey", "l_linenumber", search.by_role("authors", F.col("mine"), "MAIN").alias("main"))


@query("""SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) <> 'PROMO' THEN 'not_applicable' WHEN p_size > 25 THEN 'indexed' ELSE 'not_indexed' END status FROM part""")
def forum_status(spark, d):
    """F20, Y6"""
    p = table(spark, d, "part").withColumn("kind", F.when(F.split("p_type", " ")[0] == "PROMO", "Journal").otherwise("Book"))
    return p.select("p_partkey", search.index_status("kind", F.col("p_size") > 25).alias("status"))


@query("SELECT event_id FROM events WHERE event_type <> 'view' OR user_id % 2 = 0")
def official_facts(spark, d):
    """one metric counts from its official source alone."""
    e = table(spark, d, "events")
    metric, source = F.when(F.col("event_type") == "view", "IF").otherwise("AIS"), F.when(F.col("user_id") % 2 == 0, "official").otherwise("other")
    return e.where(search.allowed_source(metric, source, "official")).select("event_id")


@query("SELECT o_custkey, arg_max(o_orderstatus, (year(o_orderdate), o_orderkey)) status, max(year(o_orderdate))::INT AS year FROM orders GROUP BY 1")
def latest_snapshot(spark, d):
    """Each key's row of its latest year."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return search.snapshot(o, key=["o_custkey"], year="year").select("o_custkey", "status", "year")


@query("SELECT p_partkey, p_brand || ' - ' || p_size label FROM part")
def category_labels(spark, d):
    """F24"""
    return table(spark, d, "part").select("p_partkey", search.category_label("p_brand", F.col("p_size").cast("string")).alias("label"))


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END date FROM orders)
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END DESC NULLS LAST, lower(coalesce(o_orderpriority, '')), o_orderkey::VARCHAR) keys FROM o GROUP BY 1""")
def ordered_publications(spark, d):
    """Each owner's publications, the newest first."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    date = F.when(k % 7 == 0, "soon").when(k % 7 == 1, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    placed = table(spark, d, "orders").withColumn("date", date).withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*search.publication_order("date", "o_orderpriority", "o_orderkey"))))
    return placed.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("i", "o_orderkey"))).alias("x")).select("o_custkey", F.array_join(F.transform("x.o_orderkey", lambda v: v.cast("string")), ",").alias("keys"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 40")
def next_chunk(spark, d):
    """The rows that follow a key."""
    return search.after_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 40)


@query("SELECT event_id FROM events ORDER BY ts NULLS FIRST, event_id LIMIT 1000")
def oldest_touched(spark, d):
    """What a queue hands out at once; the limit is the feature."""
    return search.drained(table(spark, d, "events"), oldest="ts", tie="event_id").select("event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id::VARCHAR) - 1)::INT AS place FROM events")
def replayed_events(spark, d):
    """Events of a key in the order of replay, where numbers sort as text."""
    from pyspark.sql import Window

    return table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy(*search.replay_order("event_type", "event_id"))) - 1).alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY lower(c_name), c_custkey")
def affiliations_in(spark, d):
    """F27, G5"""
    c = table(spark, d, "customer").where(search.facets(equal={"c_nationkey": 3}))
    return c.orderBy(*search.name_order("c_name", "c_custkey")).select("c_custkey", "c_name")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'patched' ELSE p_type END AS p_type FROM part")
def patched_rows(spark, d):
    """Rows with what patches say instead."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return search.patched(p, p.where("p_partkey % 5 = 0").select("p_partkey", F.lit("patched").alias("p_type")), key="p_partkey", columns=["p_type"])


@query("""SELECT l_returnflag AS file, count(*) planned, count(*) FILTER (l_quantity > 45) errors, array_to_string(list_sort(list(l_orderkey::VARCHAR || '/' || l_linenumber))[:20], ',') samples FROM lineitem GROUP BY 1""")
def dry_run(spark, d):
    """What an import would do with each file; nothing is written. At most 20 samples are the feature."""
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row"), F.when(F.col("l_quantity") > 45, "too many").alias("error"))
    return files.preview(lines, file="file", row="row", error="error").withColumn("samples", F.array_join("samples", ","))


# Intake

_PAYLOADS = """p AS (SELECT CASE WHEN p_size % 9 = 0 THEN '' ELSE 'e' || p_partkey % 300 END eid, p_name title, 'f' || p_partkey % 40 fid, p_brand fname, p_partkey k, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END acr FROM part),
q AS (SELECT * FROM p WHERE eid <> '')"""


def _payloads(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    one, two = (k % 70).cast("string"), (k % 90 + 50).cast("string")
    fields = {"eid": F.when(size % 9 == 0, "").otherwise(F.concat(F.lit("e"), (k % 300).cast("string"))), "title": F.col("p_name"), "source_id": F.concat(F.lit("f"), (k % 40).cast("string")), "publicationName": F.col("p_brand"), "author_ids": F.concat_ws(";", one, two, one), "author_names": F.concat_ws("; ", "p_name", "p_type", "p_brand"), "fund_acr": F.when(size % 4 == 0, "").otherwise(F.col("p_type")), "citedby_count": size.cast("string")}
    return table(spark, d, "part").select(k.alias("at"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("payload"))


@query(f"""WITH {_PAYLOADS} SELECT 'publications' AS kind, eid AS id, arg_max(title, k) AS name FROM q GROUP BY 2 UNION ALL SELECT 'forums', fid, arg_max(fname, k) FROM q GROUP BY 2 UNION ALL SELECT 'funding', lower(acr) || '||', arg_max(acr, k) FROM q WHERE acr <> '' GROUP BY 2
UNION ALL SELECT 'authors', a, arg_max(n, (k, pos)) FROM (SELECT (k % 70)::VARCHAR a, title n, k, 0 pos FROM q UNION ALL SELECT (k % 90 + 50)::VARCHAR, p_type, k, 1 FROM q JOIN part ON p_partkey = k UNION ALL SELECT (k % 70)::VARCHAR, fname, k, 2 FROM q) GROUP BY 2""")
def payload_facts(spark, d):
    """P5: the facts of each kind; the last payload holds."""
    from functools import reduce

    made = intake.facts_of_payloads(_payloads(spark, d), payload="payload", order=["at"])
    names = {"publications": ("eid", "title"), "forums": ("id", "name"), "funding": ("id", "acronym"), "authors": ("id", "name")}
    return reduce(lambda a, b: a.unionByName(b), (made[k].select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name")) for k, (i, n) in names.items()))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') WHEN event_type = 'view' AND value > 50 THEN 'v' || user_id END record, CASE WHEN event_type NOT IN ('click', 'view') THEN 'skipped' WHEN event_type = 'click' AND json_extract_string(props, '$.k') IS NULL OR event_type = 'view' AND coalesce(value <= 50, true) THEN 'error' ELSE 'parsed' END outcome FROM events")
def parsed_events(spark, d):
    """Events by the parser of their kind; others are skipped, what a parser can't read is an error."""
    view = F.when(F.col("value") > 50, F.concat(F.lit("v"), F.col("user_id").cast("string")))
    return intake.parsed(table(spark, d, "events"), kind="event_type", parsers={"click": F.get_json_object("props", "$.k"), "view": view}, keep=["event_id"])


@query("""WITH l AS (SELECT event_id, ['wos json', 'SCOPUS', ' scopus '][(event_id % 3 + 1)::INT] src, ['linked', 'UNMATCHED', 'CONFLICT', 'gone', 'SKIPPED'][(event_id % 5 + 1)::INT] st, CASE WHEN event_id % 4 > 0 THEN 't' || event_id END t FROM events)
SELECT event_id, CASE WHEN src = 'wos json' THEN 'WOS' ELSE 'SCOPUS' END AS source, CASE WHEN st = 'linked' AND t IS NULL THEN 'UNMATCHED' WHEN st = 'linked' THEN 'LINKED' WHEN st = 'gone' THEN 'SKIPPED' ELSE st END AS state, 'r' AS record, CASE WHEN st IN ('linked', 'UNMATCHED') THEN t END target,
CASE WHEN src = 'SCOPUS' AND (st = 'UNMATCHED' OR st IN ('CONFLICT', 'SKIPPED') AND t IS NULL) THEN 'skipped' ELSE 'updated' END outcome FROM l""")
def repaired_links(spark, d):
    """Links as they should be written."""
    k = F.col("event_id")
    pick = lambda *of: F.get(F.array(*map(F.lit, of)), (k % len(of)).cast("int"))
    links = table(spark, d, "events").select("event_id", pick("wos json", "SCOPUS", " scopus ").alias("source"), pick("linked", "UNMATCHED", "CONFLICT", "gone", "SKIPPED").alias("state"), F.lit("r").alias("record"), F.when(k % 4 > 0, F.concat(F.lit("t"), k.cast("string"))).alias("target"))
    return intake.repaired(links)


# Read views


@query("SELECT p_type, count(*) n, count(DISTINCT p_brand) n_brands, max(p_size)::INT latest FROM part GROUP BY 1 HAVING count(*) > 3 ORDER BY n DESC, p_type LIMIT 10")
def category_page(spark, d):
    """Categories with their counts, a page by count."""
    counted = table(spark, d, "part").where(search.present("p_type")).groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands"), F.max("p_size").cast("int").alias("latest")).where("n > 3").withColumn("order", -F.col("n"))
    return search.page(counted, sort="order", allowed=["order"], tie="p_type", size=10, count=False).items.drop("order")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 100000 AND contains(lower(o_orderstatus), 'o')")
def dashboard_rows(spark, d):
    """Rows by text, least score and value."""
    rows = table(spark, d, "orders").where(search.facets(equal={"o_orderpriority": "1-URGENT"}, contains={"o_orderstatus": "o"}))
    return rows.where("o_totalprice >= 100000").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("""WITH n AS (SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, l_partkey) names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT o_orderkey, year(o_orderdate)::INT AS year, coalesce(names, '—') names FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 3""")
def group_export(spark, d):
    """A group's publications with the names of their authors in order."""
    from .operators import joins

    group = table(spark, d, "orders").where("o_custkey % 10 = 3").select("o_orderkey", F.year("o_orderdate").alias("year"))
    ids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).select("l_orderkey", F.col("x.l_partkey").alias("ids"))
    rows = group.join(ids, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    named = joins.names_in_order(rows, table(spark, d, "part"), key="o_orderkey", ids="ids", name_id="p_partkey", name="p_name", out="names")
    return named.select("o_orderkey", "year", text.or_dash(F.array_join("names", "; ")).alias("names"))


# Functions


@query("""WITH p AS (SELECT p_partkey, p_name, p_type, p_size, lpad((p_partkey * 977 % 10000000)::VARCHAR, 7, '0') || CASE WHEN p_size % 11 = 10 THEN 'x' ELSE (p_size % 10)::VARCHAR END n FROM part)
SELECT p_partkey, upper(n) issn_norm, CASE WHEN p_size % 4 = 0 THEN NULL ELSE upper(n) END issn_token, n[:4] || '-' || n[5:] issn_display, upper(n) || ',' || '12345678' found, '10.1/' || lower(replace(p_name, ' ', '.')) doi,
'spub_' || substr(sha256(p_name), 1, 24) canonical, sha256('issn:1|2') key, lower(p_name || '|' || p_type || '|') joined, sha256(p_name || '|' || p_size || '|') content FROM p""")
def identifier_texts(spark, d):
    """X3-X6, X8, X10-X12, X30, X31"""
    k, size = F.col("p_partkey"), F.col("p_size")
    n = F.concat(F.lpad((k * 977 % 10000000).cast("string"), 7, "0"), F.when(size % 11 == 10, "x").otherwise((size % 10).cast("string")))
    shown = F.concat(F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 4))
    nothing = F.lit(None).cast("string")
    return table(spark, d, "part").select(
        "p_partkey", text.issn_norm(F.concat(F.lit(" "), shown)).alias("issn_norm"), text.issn_token(F.when(size % 4 == 0, "N/A").otherwise(shown)).alias("issn_token"), text.issn_display(n).alias("issn_display"),
        F.array_join(text.issn_candidates(shown, F.lit("and 1234-5678 or 12345678")), ",").alias("found"), text.normalize_doi(F.concat(F.lit("https://doi.org/10.1/"), F.replace("p_name", F.lit(" "), F.lit(".")))).alias("doi"),
        text.canonical_id("spub_", nothing, F.lit(" "), F.col("p_name")).alias("canonical"), text.identity_key(F.array(F.lit("2"), F.lit("1"), nothing, F.lit("2")), F.col("p_name")).alias("key"),
        text.joined_key(F.col("p_name"), F.col("p_type"), nothing).alias("joined"), text.content_hash(F.col("p_name"), size, nothing).alias("content"),
    )


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'SSCI' WHEN 1 THEN 'SCIE' WHEN 2 THEN 'AHCI,ESCI' WHEN 3 THEN 'OTHER' ELSE 'UNKNOWN' END editions, p_brand || ' - x' category_name, 'SCIE' category_index, 'x - SCIE' after_first,
CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size / 2.0::DOUBLE END metric, (p_size // 2)::INT lenient, 'Q' || (1 + p_size % 4) AS quarter, CASE p_size % 5 WHEN 0 THEN 'A_STAR' WHEN 1 THEN 'B' WHEN 2 THEN 'D' WHEN 3 THEN 'NON_RANK' ELSE 'C' END AS rank,
CASE p_size % 3 WHEN 0 THEN 'A*' WHEN 1 THEN 'B' END points FROM part""")
def ranking_texts(spark, d):
    """X14-X19, X21, X22"""
    size = F.col("p_size")
    pick = lambda n, *of: F.get(F.array(*map(F.lit, of)), (size % n).cast("int"))
    category = F.concat("p_brand", F.lit(" - x - SCIE"))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(text.edition_candidates(pick(5, "Social Sciences Edition", " scie ", "Arts; Emerging Sources", "Books", " ")), ",").alias("editions"), text.category_name(category).alias("category_name"), text.category_index(category).alias("category_index"),
        text.first_dash_index(F.concat("p_brand", F.lit("-x - SCIE"))).alias("after_first"), text.metric_value(F.when(size % 6 == 0, "-999.999").otherwise(F.regexp_replace((size / 2).cast("string"), r"\\.", ","))).alias("metric"), text.lenient_int((size / 2).cast("string")).alias("lenient"),
        text.quarter(pick(4, "1.0", "q2", "Q3", "4")).alias("quarter"), text.conference_rank(pick(5, "A*", "b", "National: x", "Australasian B", "C")).alias("rank"), text.points_category(F.when(size % 3 == 0, 12.0).when(size % 3 == 1, 4.0)).alias("points"),
    )


@query("""SELECT p_partkey, p_brand || ',' || p_name parts, p_size % 2 = 0 flag, CASE p_size % 4 WHEN 0 THEN '1995-01-01' WHEN 1 THEN '1995-03-01' WHEN 2 THEN '1995-03-09' END AS day, CASE WHEN p_size % 2 = 0 THEN 1234.5 ELSE 1234567.25 END::DOUBLE AS number, CASE p_size % 4 WHEN 0 THEN 'JOURNAL' WHEN 1 THEN 'CONFERENCE' WHEN 2 THEN 'BOOK' ELSE 'OTHER' END forum,
CASE p_size % 5 WHEN 0 THEN 'SCOPUS' WHEN 1 THEN 'WOS' WHEN 2 THEN 'GSCHOLAR' WHEN 3 THEN 'USER_DEFINED' ELSE 'ORCID' END AS source, CASE WHEN p_size % 3 = 0 THEN '—' ELSE p_brand END shown, CASE WHEN p_size % 3 = 0 THEN 'ar' ELSE 'cp' END subtype, CASE p_size % 4 WHEN 0 THEN 'ASIST_C' WHEN 1 THEN 'ASIST_UNIV' WHEN 2 THEN 'PROF_UNIV' ELSE 'OTHER' END AS position FROM part""")
def record_texts(spark, d):
    """X24, X26-X29, X32-X36, F19"""
    size = F.col("p_size")
    pick = lambda *of: F.get(F.array(*map(F.lit, of)), (size % len(of)).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(text.split_trimmed(F.concat_ws(" ; ", "p_brand", "p_name", F.lit(" "), "p_brand"), distinct=True), ",").alias("parts"), text.json_bool(F.when(size % 2 == 0, '{"a": "Yes"}').otherwise('{"a": 0}'), "a").alias("flag"),
        F.date_format(text.partial_date(pick("1995", "1995-03", " 1995-03-09", "soon")), "yyyy-MM-dd").alias("day"), text.locale_double(F.when(size % 2 == 0, "1.234,50").otherwise("1,234,567.25")).alias("number"), text.forum_type(pick("A Journal", "Proceedings of", "Book Series", "Patent")).alias("forum"),
        text.source_name(pick("scopus-json", " Web of Science", "google_scholar", "user", "orcid")).alias("source"), text.or_dash(F.when(size % 3 == 0, " ").otherwise(F.col("p_brand"))).alias("shown"), text.subtype(F.when(size % 3 == 0, " AR "), F.lit("cp")).alias("subtype"),
        text.position(pick("Asist. Cerc. dr.", "Asist. univ.", "Prof.", "x")).alias("position"),
    )
