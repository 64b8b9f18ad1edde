"""The library's operators on the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import formula, text, years
from .operators import folds, identity, joins, ledger, ranking, search
from .plans import canonical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _brand_revenue(spark, d):
    sales = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("r"))
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return sales.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.round(F.sum("r"), 2).alias("revenue"))


_BRANDS = "WITH b AS (SELECT p_type, p_brand, round(sum(l_extendedprice), 2) revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"""{_BRANDS}, r AS (SELECT *, rank() OVER w rank, row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, p_brand) i, count(*) OVER (PARTITION BY p_type) n FROM b WINDOW w AS (PARTITION BY p_type ORDER BY revenue DESC)),
q AS (SELECT *, CASE WHEN i <= ceil(n / 4.0) THEN 'Q1' WHEN i <= ceil(n / 2.0) THEN 'Q2' WHEN i <= ceil(3 * n / 4.0) THEN 'Q3' ELSE 'Q4' END AS quarter FROM r)
SELECT p_type, p_brand, revenue, rank::INT rank, quarter, rank() OVER (PARTITION BY p_type, quarter ORDER BY revenue DESC)::INT quartile_rank FROM q""")
def brand_quartiles(spark, d):
    """Competition rank, quartile by position, rank inside the quartile."""
    return ranking.ranked(_brand_revenue(spark, d), group=["p_type"], value="revenue", tie="p_brand")


@query(f"""{_BRANDS}, r AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY revenue DESC) rank, row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, p_brand) i, count(*) OVER (PARTITION BY p_type) n FROM b),
q AS (SELECT *, CASE WHEN i <= ceil(n / 4.0) THEN 'Q1' WHEN i <= ceil(n / 2.0) THEN 'Q2' WHEN i <= ceil(3 * n / 4.0) THEN 'Q3' ELSE 'Q4' END AS quarter FROM r),
k AS (SELECT *, rank() OVER (PARTITION BY p_type, quarter ORDER BY revenue DESC) quartile_rank, length(p_brand) + n % 3 = 8 gap FROM q),
m AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY revenue DESC) r2 FROM k WHERE gap),
f AS (SELECT *, rank() OVER (PARTITION BY p_type, quarter ORDER BY revenue DESC) k2 FROM m)
SELECT p_type, p_brand, revenue, rank::INT rank, quarter, quartile_rank::INT quartile_rank FROM k WHERE NOT gap UNION ALL SELECT p_type, p_brand, revenue, r2::INT, quarter, k2::INT FROM f""")
def brand_ranks_filled(spark, d):
    """Ranks that are missing are filled among the rows that miss them."""
    full = ranking.ranked(_brand_revenue(spark, d), group=["p_type"], value="revenue", tie="p_brand")
    gap = F.length("p_brand") + F.count("*").over(Window.partitionBy("p_type")) % 3 == 8
    holes = full.withColumn("gap", gap).withColumns({"rank": F.when(~F.col("gap"), F.col("rank")), "quartile_rank": F.when(~F.col("gap"), F.col("quartile_rank"))}).drop("gap")
    return ranking.filled(holes, key=["p_type", "p_brand"], group=["p_type"], value="revenue", tie="p_brand")


@query("SELECT year(l_shipdate)::INT AS year, l_returnflag, count(DISTINCT l_suppkey) n, floor(count(DISTINCT l_suppkey) * 0.2)::BIGINT cut FROM lineitem GROUP BY 1, 2")
def top_supplier_counts(spark, d):
    """Distinct suppliers by year and flag, and the cut of the top fifth."""
    return ranking.top_count(table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", "l_suppkey"), group=["year", "l_returnflag"], entity="l_suppkey")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority, year(o_orderdate)::INT AS order_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def citation_context(spark, d):
    """Facts with the context of what they refer to."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("order_year"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def valid_edges(spark, d):
    """Edges of which both ends exist."""
    edges = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    edges = joins.valid_edges(edges, table(spark, d, "customer").where("c_acctbal > 0"), ends=["o_custkey"], node="c_custkey")
    return joins.valid_edges(edges, table(spark, d, "lineitem").where("l_returnflag = 'R'"), ends=["o_orderkey"], node="l_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def missing_backfill(spark, d):
    """Rows that the other side lacks."""
    return joins.dropped_edges(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_totalprice > 300000"), end="c_custkey", node="o_custkey")


@query("""WITH s AS (SELECT s_nationkey k, min(s_name) v FROM supplier GROUP BY 1), c AS (SELECT c_custkey, c_nationkey, c_custkey % 25 AS alt FROM customer)
SELECT c_custkey, c_nationkey, alt, coalesce(a.v, b.v) s_name FROM c LEFT JOIN s a ON c.c_nationkey = a.k LEFT JOIN s b ON c.alt = b.k""")
def fallback_lookup(spark, d):
    """By the first candidate key that finds anything, the least match."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 25).alias("alt"))
    return joins.first_match(c, table(spark, d, "supplier"), key="c_custkey", candidates=["c_nationkey", "alt"], right_key="s_nationkey", pick="s_name")


@query("""WITH p AS (SELECT l_partkey k, year(l_shipdate) y, count(*) n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1, 2), a AS (SELECT DISTINCT l_partkey k, year(l_shipdate) y FROM lineitem WHERE l_returnflag = 'N'),
j AS (SELECT a.k, a.y, p.y py, p.n, row_number() OVER (PARTITION BY a.k, a.y ORDER BY abs(p.y - a.y), p.y) i FROM a LEFT JOIN p ON a.k = p.k AND abs(a.y - p.y) <= 5)
SELECT k::BIGINT part, y::INT AS year, py::INT AS found_year, n::BIGINT n FROM j WHERE i = 1""")
def nearest_year(spark, d):
    """The nearest year within five, the earlier one of two."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year"), "l_returnflag", "l_quantity")
    held = lines.where("l_returnflag = 'R' AND l_quantity > 30").groupBy("part", F.col("year").alias("found_year")).agg(F.count("*").alias("n"))
    return joins.nearest_year(lines.where("l_returnflag = 'N'").select("part", "year").distinct(), held, key=["part"], year="year", right_year="found_year")


@query("""SELECT o_custkey, max(CASE WHEN o_totalprice > 200000 THEN year(o_orderdate) END)::INT last_year, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) last_status FROM orders GROUP BY 1""")
def latest_values(spark, d):
    """The last year with a value, the last status."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_totalprice") > 200000, F.year("o_orderdate"))).alias("last_year"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%' ORDER BY c_name, c_custkey LIMIT 25 OFFSET 25")
def customer_page(spark, d):
    """A page of a search."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").where(search.contains_any(["c_mktsegment", "c_name"], search.query(" build ")))
    return search.page(c, sort="c_name", allowed=["c_name"], tie="c_custkey", number=1, size=25, count=False).items


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'a%' OR len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'b'))) > 0")
def prefix_search(spark, d):
    """columns or array elements that start with a query."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"))
    return p.where(search.starts_any(["p_name"], "a") | search.starts_any([], "b", ["words"])).drop("words")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 OR o_custkey = 7 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 1")
def by_any_id(spark, d):
    """the newest row that any identifier matches."""
    o = table(spark, d, "orders").withColumn("newest", F.struct("o_orderdate", "o_orderkey"))
    return search.by_any_id(o, "7", ["o_orderkey", "o_custkey"], "newest").select("o_orderkey", "o_custkey")


@query("SELECT year(o_orderdate)::INT AS year, count(*) n, count(DISTINCT o_custkey) n_customers, max(o_orderkey) last FROM orders GROUP BY 1")
def per_year(spark, d):
    """A3, A5: counts and lasts of a year."""
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.max("o_orderkey").alias("last"))


@query("SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1")
def priority_histogram(spark, d):
    """A6"""
    return ranking.histogram(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') n_click, count(*) FILTER (event_type = 'view') n_view, count(*) FILTER (event_type = 'purchase') n_purchase FROM events GROUP BY 1""")
def status_counts(spark, d):
    """A16, A20, A28"""
    return ranking.status_counts(table(spark, d, "events"), key=["user_id"], status="event_type", values=["click", "view", "purchase"])


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_seen, arg_max(event_type, (ts, event_id)) last_type FROM events GROUP BY 1")
def last_seen(spark, d):
    """The last row of a key."""
    e = ranking.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), key=["user_id"], order=["ts", "event_id"])
    return e.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.col("event_type").alias("last_type"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, count(*) cited FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cited DESC) i FROM c)
SELECT o_custkey, coalesce(max(CASE WHEN cited >= i THEN i END), 0)::BIGINT h_index, sum(cited)::BIGINT total FROM r GROUP BY 1""")
def customer_h_index(spark, d):
    """H-index and total, over counts made once per order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("cited"))
    cited = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return ranking.h_index(cited, key=["o_custkey"], cited="cited").join(cited.groupBy("o_custkey").agg(F.sum("cited").alias("total")), "o_custkey")


@query("SELECT l_orderkey, l_partkey, count(*) n, min(l_linenumber)::INT kept FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    """A19"""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("kept")).where("n > 1")


@query("SELECT sha256(concat_ws('|', count(*)::VARCHAR, coalesce(max(o_orderkey)::VARCHAR, ''), coalesce(max(o_orderstatus), ''))) fingerprint FROM orders")
def slice_fingerprint(spark, d):
    """A17, P15"""
    return ranking.fingerprint(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")


_PROPS = "arg_max(props, (ts, event_id))"


@query(f"""WITH o AS (SELECT user_id, event_type, {_PROPS} props FROM events WHERE value < 60 GROUP BY 1, 2), n AS (SELECT user_id, event_type, {_PROPS} props FROM events WHERE value > 40 GROUP BY 1, 2)
SELECT coalesce(o.user_id, n.user_id) user_id, coalesce(o.event_type, n.event_type) event_type, CASE WHEN n.user_id IS NULL THEN o.props ELSE n.props END props,
CASE WHEN n.user_id IS NULL THEN 'kept' WHEN o.user_id IS NULL THEN 'imported' WHEN coalesce(o.props, '') = coalesce(n.props, '') THEN 'skipped' ELSE 'updated' END outcome FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def ledger_upsert(spark, d):
    """K1, P9, A21"""
    e = table(spark, d, "events").select("user_id", "event_type", "props", "ts", "event_id")
    last = lambda df: ranking.latest(df, key=["user_id", "event_type"], order=["ts", "event_id"])
    return ledger.upserted(last(e.where("value < 60")), last(e.where("value > 40")), key=["user_id", "event_type"], payload=["props"])


@query("SELECT DISTINCT user_id, event_type, value FROM events WHERE value > 40 AND (user_id, event_type, value) NOT IN (SELECT (user_id, event_type, value) FROM events WHERE value < 60)")
def ledger_insert(spark, d):
    """K2, T4"""
    e = table(spark, d, "events")
    return ledger.inserted(e.where("value < 60"), e.where("value > 40"), key=["user_id"], payload=["event_type", "value"]).select("user_id", "event_type", "value")


@query("""WITH c AS (SELECT l_orderkey o, l_suppkey % 2 s, CASE WHEN l_returnflag <> 'R' THEN l_returnflag ELSE ' ' END m, l_linenumber n, l_partkey % 3 i FROM lineitem),
k AS (SELECT o, s, m, arg_max(i, (n, i)) i FROM c WHERE m <> ' ' GROUP BY ALL), h AS (SELECT o, s, m, CASE WHEN o % 5 = 0 THEN 'old' ELSE o || '|' || s || '|' || m END id, min(i) i FROM c WHERE n % 2 = 1 GROUP BY ALL)
SELECT k.o, k.s, k.m, coalesce(id, k.o || '|' || k.s || '|' || k.m) edge_id, k.i, CASE WHEN id IS NULL THEN 'insert' WHEN h.i = k.i THEN 'none' ELSE 'update' END AS action, coalesce(id = 'old', false) conflict FROM k LEFT JOIN h ON k.o = h.o AND k.s = h.s AND k.m = h.m
UNION ALL SELECT o, s, m, NULL, i, 'reject', false FROM c WHERE m = ' '""")
def edge_upsert(spark, d):
    """Edges asked for, their ids, and what is written of them."""
    made = F.concat_ws("|", "o", "s", "m")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 2).alias("s"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).otherwise(" ").alias("m"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 3).alias("i"))
    stored = c.where("n % 2 = 1").groupBy("o", "s", "m").agg(F.min("i").alias("i")).withColumn("edge_id", F.when(F.col("o") % 5 == 0, "old").otherwise(made))
    return ledger.edges_upserted(stored, c, key=["o", "s", "m"], edge_id="edge_id", made_id=made, lineage=["i"], order="n")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'), s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_suppkey + 1 ELSE l_suppkey END l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT coalesce(x.l_orderkey, s.l_orderkey) l_orderkey, coalesce(x.l_linenumber, s.l_linenumber)::INT l_linenumber, CASE WHEN s.l_orderkey IS NULL THEN 'insert' WHEN x.l_orderkey IS NULL THEN 'delete' WHEN x.l_suppkey = s.l_suppkey THEN 'none' ELSE 'repair' END AS action, x.l_suppkey expected, s.l_suppkey stored
FROM x FULL JOIN s ON x.l_orderkey = s.l_orderkey AND x.l_linenumber = s.l_linenumber""")
def edge_reconcile(spark, d):
    """What makes the stored edges those expected."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    stored = lines.where("l_returnflag <> 'R'").withColumn("l_suppkey", F.when(F.col("l_quantity") > 40, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")))
    return joins.reconciled(lines.where("l_returnflag <> 'A'"), stored, key=["l_orderkey", "l_linenumber"], value="l_suppkey")


@query("SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, l_partkey) names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def names_in_order(spark, d):
    """Names of an array of ids, in its order."""
    lines = table(spark, d, "lineitem")
    o = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).select("l_orderkey", F.col("x.l_partkey").alias("ids"))
    named = joins.names_in_order(o, table(spark, d, "part"), key="l_orderkey", ids="ids", name_id="p_partkey", name="p_name", out="names")
    return named.select("l_orderkey", F.array_join("names", "; ").alias("names"))


@query("""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') x, string_split(p_type, ' ') y FROM part) SELECT p_partkey, (i - 1)::INT pos, x[i] a, y[i] b FROM (SELECT *, unnest(range(1, least(len(x), len(y)) + 1)) i FROM a)""")
def positional_zip(spark, d):
    """Two arrays, position by position, as long as both last."""
    return joins.zipped(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), keep=["p_partkey"], left=F.split("p_name", " "), right=F.split("p_type", " "))


@query("SELECT l_orderkey, p_brand, count(DISTINCT l_partkey) n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def token_overlap(spark, d):
    """Known entities that share tokens with a key, and how many."""
    return joins.overlaps(table(spark, d, "lineitem"), table(spark, d, "part"), key="l_orderkey", token="l_partkey", entity="p_brand", known_token="p_partkey")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT p_partkey k, unnest(['n|' || p_name || '|' || p_size, 'b|' || p_brand || '|' || p_type || '|' || p_size]) t FROM part), n AS MATERIALIZED (SELECT DISTINCT a.k, b.k m FROM e a JOIN (SELECT t, min(k) k FROM e GROUP BY 1) b USING (t)),
g AS MATERIALIZED (SELECT k a, m b FROM n UNION SELECT m, k FROM n), r(k, l) USING KEY (k) AS (SELECT p_partkey, p_partkey FROM part UNION (SELECT g.b, min(r.l) FROM r JOIN g ON g.a = r.k JOIN recurring.r o ON o.k = g.b WHERE r.l < o.l GROUP BY g.b))
SELECT k p_partkey, l AS identity FROM r""")
def identity_resolution(spark, d):
    """Parts of a size that share a name, or brand and type, are one."""
    size = F.col("p_size").cast("string")
    tokens = F.array(F.concat_ws("|", F.lit("n"), "p_name", size), F.concat_ws("|", F.lit("b"), "p_brand", "p_type", size))
    return identity.resolved(table(spark, d, "part").select("p_partkey", F.explode(tokens).alias("token")), key="p_partkey", token="token")


_FACTS = """e AS (SELECT user_id, round(value, 0) v, event_type s, strftime(ts, '%Y-%m-%d') f, strftime(ts, '%Y-%m') r, event_id::VARCHAR w, event_id % 3 k FROM events),
o AS (SELECT *, coalesce(s = 'purchase', false) good, CASE WHEN k > 0 THEN k END ranking, row_number() OVER (PARTITION BY user_id ORDER BY s, f, r, w) i FROM e)"""


def _winner(fills: str, same: str) -> str:
    """Rows of a key one by one: what is held, and the clashes so far."""
    wins = "CASE WHEN h.good <> x.good THEN x.good ELSE (x.r, x.w::BIGINT) > (h.r, h.w::BIGINT) END"
    passed = f"(NOT {fills} AND ((h.f = x.f AND h.r = x.r) OR ({same}) OR coalesce(x.v = 0, true)))"
    takes = f"(NOT {passed} AND ({wins} OR {fills}))"
    kept = ", ".join(f"CASE WHEN {takes} THEN x.{c} ELSE h.{c} END" for c in ("v", "s", "f", "r", "w", "good", "ranking"))
    return f"""WITH RECURSIVE {_FACTS}, t AS (SELECT user_id, v, s, f, r, w, good, ranking, 1::BIGINT i, 0 n FROM o WHERE i = 1 UNION ALL
SELECT h.user_id, {kept}, x.i, h.n + CASE WHEN NOT {passed} AND NOT {fills} AND h.good = x.good THEN 1 ELSE 0 END FROM t h JOIN o x ON x.user_id = h.user_id AND x.i = h.i + 1)
SELECT user_id, v AS value, s AS source, f AS file, r AS version, w AS row"""


def _facts(spark, d):
    k = F.col("event_id") % 3
    return table(spark, d, "events").select("user_id", F.round("value", 0).alias("value"), F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("file"), F.date_format("ts", "yyyy-MM").alias("version"), F.col("event_id").cast("string").alias("row"), F.when(k > 0, k).alias("ranking"))


_LAST = "FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"


@query(f"{_winner('false', 'h.v IS NOT DISTINCT FROM x.v')}, n::INT n_conflicts {_LAST}")
def metric_winner(spark, d):
    """The fact that wins for each user."""
    return folds.winners(_facts(spark, d).drop("ranking"), key=["user_id"], value="value", source="source", file="file", version="version", row="row", preferred=F.col("source") == "purchase")


@query(f"{_winner('(h.ranking IS NULL AND x.ranking IS NOT NULL)', 'h.v IS NOT DISTINCT FROM x.v AND h.ranking IS NOT DISTINCT FROM x.ranking')}, ranking, n::INT n_conflicts {_LAST}")
def category_winner(spark, d):
    """Likewise, where a row with a ranking replaces one without."""
    return folds.winners(_facts(spark, d), key=["user_id"], value="value", source="source", file="file", version="version", row="row", preferred=F.col("source") == "purchase", ranking="ranking")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id % 3 target, ['LINKED', 'LINKED', 'UNMATCHED', 'LINKED', 'CONFLICT', 'SKIPPED'][(event_id * 7 % 6 + 1)::INT] state, event_id % 4 = 0 replay, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events),
t AS (SELECT DISTINCT user_id, 0::BIGINT i, 'UNMATCHED' state, NULL::BIGINT target, 0 n FROM e UNION ALL
SELECT t.user_id, e.i, CASE WHEN t.state IN ('CONFLICT', 'SKIPPED') AND NOT e.replay THEN t.state WHEN t.state = 'LINKED' AND e.state = 'LINKED' AND t.target IS DISTINCT FROM e.target THEN 'CONFLICT' ELSE e.state END,
CASE WHEN (t.state IN ('CONFLICT', 'SKIPPED') AND NOT e.replay) OR (t.state = 'LINKED' AND e.state = 'LINKED' AND t.target IS DISTINCT FROM e.target) THEN t.target WHEN e.state = 'LINKED' THEN e.target END,
t.n + CASE WHEN t.state = 'LINKED' AND e.state = 'LINKED' AND t.target IS DISTINCT FROM e.target THEN 1 ELSE 0 END FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1)
SELECT user_id, state, target, n::INT n_relinks FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def link_states(spark, d):
    """Links that change in every way: a linked target stays, another one is a conflict, which only a replay leaves."""
    k = F.col("event_id")
    states = F.get(F.array(*map(F.lit, ("LINKED", "LINKED", "UNMATCHED", "LINKED", "CONFLICT", "SKIPPED"))), (k * 7 % 6).cast("int"))
    e = table(spark, d, "events").select("user_id", "event_id", (k % 3).alias("target"), states.alias("state"), (k % 4 == 0).alias("replay"))
    return folds.link_states(e, key=["user_id"], order=["event_id"], target="target", state="state", replay="replay")


@query("""WITH m AS (SELECT user_id, event_type, event_id, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) i FROM m) SELECT user_id, event_id, event_type FROM r WHERE i = 1""")
def keep_last(spark, d):
    """Of two batches, the last row of each key."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    both = e.where("value > 40").unionByName(e.where("value <= 40 OR value IS NULL"), allowMissingColumns=True)
    return ranking.latest(both, key=["user_id"], order=["event_id"])


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice S, count(*)::DOUBLE N FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), v AS (SELECT *, round(CASE WHEN N > 3 THEN S / greatest(N, 1) ELSE S * 2 END, 6) score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) i FROM v) SELECT o_custkey, count(*) n, sum(round(score * 1000000)::BIGINT)::DOUBLE / 1000000 total FROM r WHERE i <= 10 GROUP BY 1""")
def formula_top10(spark, d):
    """A user's formula, the ten best of each key, their total."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("N"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("S")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    scored = o.withColumn("score", F.round(formula.compiled("N > 3 ? S / max(N, 1) : S * 2", {"S", "N"}), 6))
    best = ranking.top(scored, group=["o_custkey"], order=[F.desc("score"), F.asc("o_orderkey")], n=10)
    return best.groupBy("o_custkey").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("score") * 1000000).cast("long")).cast("double") / 1000000).alias("total"))


@query("SELECT o_orderkey, y::INT AS year FROM (SELECT o_orderkey, unnest(list_sort(list_distinct(list_concat([1994], range(year(o_orderdate) - 2, year(o_orderdate) + 1))))) y FROM orders)")
def year_ranges(spark, d):
    """Years of a range relative to an item's year."""
    return table(spark, d, "orders").select("o_orderkey", F.explode(years.years("1994,IY-2->IY", F.year("o_orderdate"), 2024)).alias("year"))


@query("""SELECT event_id, upper(trim(event_type)) token, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0)::INT k, substr(sha256(event_type || '|' || user_id::VARCHAR), 1, 24) short, strftime(ts, '%Y')::INT AS year FROM events""")
def event_texts(spark, d):
    """X1, X9, X10, X25"""
    e = table(spark, d, "events")
    return e.select("event_id", F.upper(text.token(F.col("event_type"))).alias("token"), text.json_int(F.col("props"), "k").alias("k"), text.short_hash(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("short"), text.extract_year(F.date_format("ts", "yyyy-MM-dd")).alias("year"))


@query("""SELECT p_partkey, nullif(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), '') norm, nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '') print, split_part(p_type, ' ', 1) first, CASE WHEN p_size <= 12 THEN 'Q1' ELSE 'NOT_FOUND' END AS quarter FROM part""")
def part_texts(spark, d):
    """X2, X7, X20, X23"""
    p = table(spark, d, "part")
    return p.select("p_partkey", text.normalize_text(F.col("p_name")).alias("norm"), text.fingerprint(F.col("p_name")).alias("print"), text.acronym(F.col("p_type")).alias("first"), text.known_quarter(F.when(F.col("p_size") <= 12, "1.0").otherwise("x")).alias("quarter"))


@query("""WITH v AS (SELECT o_custkey, year(o_orderdate) y, round(max(o_totalprice), 2) m FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(y::VARCHAR || '=' || (m * 100)::BIGINT::VARCHAR, ',' ORDER BY y) timeline FROM v GROUP BY 1""")
def year_maps(spark, d):
    """The most of each year, as one map of years for each key."""
    v = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.max("o_totalprice"), 2).alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct("y", F.round(F.col("m") * 100).cast("long").alias("c"))))
    return v.groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["y"].cast("string"), x["c"].cast("string"))), ",").alias("timeline"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT s_nationkey) s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN s ON l_orderkey = o_orderkey WHERE NOT list_has_any(s.s, [c_nationkey])""")
def without_self(spark, d):
    """orders none of whose suppliers is of the customer's nation."""
    nations = table(spark, d, "lineitem").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_set("s_nationkey").alias("theirs"))
    own = table(spark, d, "customer").select("c_custkey", F.array("c_nationkey").alias("own"))
    pairs = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(own, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("o_orderkey") == F.col("l_orderkey"))
    return joins.without_shared(pairs, left="own", right="theirs").select("o_orderkey", "c_custkey")


@query("""WITH l AS (SELECT s_suppkey k, 'L' || s_nationkey id FROM supplier WHERE s_suppkey % 3 = 0), o AS (SELECT 'K' || s_nationkey id, s_suppkey k FROM supplier WHERE s_suppkey % 2 = 0), kk AS (SELECT k, min(id) id FROM o GROUP BY 1),
a AS (SELECT s_suppkey, coalesce(l.id, kk.id, 'saff_' || substr(sha256('scopus|' || s_suppkey), 1, 24)) canonical_id FROM supplier LEFT JOIN l ON l.k = s_suppkey LEFT JOIN kk ON kk.k = s_suppkey)
SELECT s_suppkey, canonical_id, CASE WHEN canonical_id IN (SELECT id FROM o) OR s_suppkey::VARCHAR <> min(s_suppkey::VARCHAR) OVER (PARTITION BY canonical_id) THEN 'updated' ELSE 'imported' END outcome FROM a""")
def canonical_affiliations(spark, d):
    """An id by link, by record, by hash."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    links = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("record"), F.concat(F.lit("L"), F.col("s_nationkey").cast("string")).alias("canonical_id"))
    known = s.where("s_suppkey % 2 = 0").groupBy(F.concat(F.lit("K"), F.col("s_nationkey").cast("string")).alias("canonical_id")).agg(F.collect_set(F.col("s_suppkey").cast("string")).alias("records"))
    own = canonical.affiliation_id(F.col("s_suppkey").cast("string"), F.col("s_name"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return canonical.assigned(s, links, known, record="s_suppkey", fallback=own).select("s_suppkey", "canonical_id", "outcome")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber p, l_partkey::VARCHAR id, CASE WHEN p_size <= 25 THEN 'c' || p_brand ELSE 'sauth_' || substr(sha256('source|scopus|author|' || l_partkey), 1, 24) END c, p_size > 25 pending FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT l_orderkey, c, min((p, id::BIGINT)) p FROM x GROUP BY 1, 2), q AS (SELECT l_orderkey, id, min(p) p FROM x WHERE pending GROUP BY 1, 2), qq AS (SELECT l_orderkey, string_agg(id, ',' ORDER BY p, id::BIGINT) pending FROM q GROUP BY 1)
SELECT l_orderkey, string_agg(c, ',' ORDER BY p) ids, coalesce(any_value(qq.pending), '') pending FROM c LEFT JOIN qq USING (l_orderkey) GROUP BY 1""")
def author_bridge(spark, d):
    """A source's ids as canonical ids, in order; those without a link get an id of their own and stay pending."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).select("l_orderkey", F.transform("x.l_partkey", lambda k: k.cast("string")).alias("ids"), F.lit("Scopus").alias("source"))
    links = table(spark, d, "part").where("p_size <= 25").select(F.lit("SCOPUS").alias("source"), F.col("p_partkey").cast("string").alias("record"), F.concat(F.lit("c"), "p_brand").alias("canonical_id"))
    made = canonical.bridged(o, links, key="l_orderkey", ids="ids", source="source")
    return made.select("l_orderkey", F.array_join("canonical_ids", ",").alias("ids"), F.array_join("pending_ids", ",").alias("pending"))


@query("""WITH p AS (SELECT p_partkey k, 'P' || p_partkey id FROM part WHERE p_size > 10), e AS (SELECT DISTINCT l_partkey::VARCHAR cited_eid, l_suppkey::VARCHAR citing_eid FROM lineitem)
SELECT cited_eid, citing_eid, a.id cited_id, b.id citing_id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'scit_' || substr(sha256(a.id || '|' || b.id), 1, 24) END edge_id,
CASE WHEN a.id IS NULL THEN 'UNRESOLVED_CITED_PUBLICATION' WHEN b.id IS NULL THEN 'UNRESOLVED_CITING_PUBLICATION' END reason FROM e LEFT JOIN p a ON a.k::VARCHAR = cited_eid LEFT JOIN p b ON b.k::VARCHAR = citing_eid""")
def citation_edges(spark, d):
    """Citations between known publications, and which end of the others is unknown."""
    pubs = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("eid"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("cited_eid"), F.col("l_suppkey").cast("string").alias("citing_eid"))
    return canonical.citation_edges(lines, pubs)


@query("""WITH p AS (SELECT 'P' || p_partkey id, 'e' || p_partkey eid, '10.1/' || (p_partkey % 170) doi, CASE WHEN p_size < 25 THEN 'w' || (p_partkey % 150) END own FROM part), i AS (SELECT c_custkey item, CASE WHEN c_custkey % 3 = 0 THEN 'e' || c_custkey END eid, '10.1/' || (c_custkey % 211) doi, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'NON_WOS' ELSE 'w' || (c_custkey % 190) END ext FROM customer),
e AS (SELECT eid, min(id) id FROM p GROUP BY 1), dd AS (SELECT doi, min(id) id, max(id) u FROM p GROUP BY 1), h AS (SELECT own, min(id) a, max(id) b FROM p WHERE own IS NOT NULL GROUP BY 1),
f AS (SELECT i.item, i.ext, coalesce(e.id, CASE WHEN dd.id = dd.u THEN dd.id END) t, e.id IS NULL AND dd.id <> dd.u amb FROM i LEFT JOIN e ON i.eid = e.eid LEFT JOIN dd ON i.doi = dd.doi WHERE ext <> 'NON_WOS'),
r AS (SELECT f.item, f.ext, f.t, CASE WHEN amb THEN 'ambiguous-doi' WHEN t IS NULL THEN 'no-id-eid-doi-match' WHEN p.own <> f.ext THEN 'target-has-other-key' WHEN h.a <> t OR h.b <> t THEN 'key-assigned' END reason FROM f LEFT JOIN p ON p.id = f.t LEFT JOIN h ON h.own = f.ext),
bt AS (SELECT t, arg_min(ext, item) x FROM r WHERE reason IS NULL GROUP BY 1), bk AS (SELECT ext, arg_min(t, item) x FROM r WHERE reason IS NULL GROUP BY 1),
z AS (SELECT r.item, r.t, coalesce(reason, CASE WHEN bt.x <> r.ext THEN 'target-has-other-key' WHEN bk.x <> r.t THEN 'key-assigned' END, 'linked') reason FROM r LEFT JOIN bt ON bt.t = r.t LEFT JOIN bk ON bk.ext = r.ext)
SELECT item, CASE reason WHEN 'linked' THEN 'LINKED' WHEN 'no-id-eid-doi-match' THEN 'UNMATCHED' ELSE 'CONFLICT' END AS state, reason, t target_id FROM z UNION ALL SELECT item, 'SKIPPED', 'non-wos-or-empty', NULL FROM i WHERE ext IS NULL OR ext = 'NON_WOS'""")
def enrichment_links(spark, d):
    """P10: external ids for publications, found by eid or a DOI of their own, and why others are refused."""
    text_of = lambda c: F.col(c).cast("string")
    p = table(spark, d, "part")
    w = F.concat(F.lit("w"), (F.col("p_partkey") % 150).cast("string"))
    pubs = p.select(F.concat(F.lit("P"), text_of("p_partkey")).alias("id"), F.concat(F.lit("e"), text_of("p_partkey")).alias("eid"), F.concat(F.lit("https://doi.org/10.1/"), (F.col("p_partkey") % 170).cast("string")).alias("doi"), F.when(F.col("p_size") < 25, w).alias("wos_id"))
    k = F.col("c_custkey")
    ext = F.when(k % 7 == 1, "NON_WOS").when(k % 7 != 0, F.concat(F.lit("w"), (k % 190).cast("string")))
    incoming = table(spark, d, "customer").select(k.alias("item"), F.lit(None).cast("string").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("e"), text_of("c_custkey"))).alias("eid"), F.concat(F.lit("10.1/"), (k % 211).cast("string")).alias("doi"), ext.alias("wos_id"))
    return canonical.enrichment_links(incoming, pubs, item="item", external="wos_id")


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'eid|e' || p_partkey WHEN p_partkey % 4 = 1 THEN 'doi|10.1/' || p_size ELSE 'title|' || p_name || '|date|' || lower(p_type) || '|creator|' || lower(p_brand) || '|forum|' || lower(p_brand) END x, p_size FROM part), i AS (SELECT *, 'spub_' || substr(sha256(x), 1, 24) canonical_id FROM m)
SELECT p_partkey, canonical_id, CASE WHEN canonical_id IN (SELECT canonical_id FROM i WHERE p_size > 25) THEN 'updated' ELSE 'imported' END outcome FROM i""")
def canonical_backfill(spark, d):
    """Ids of what a publication's row gives, and whether they are known."""
    k, nothing = F.col("p_partkey"), F.lit(None).cast("string")
    eid = F.when(k % 4 == 0, F.concat(F.lit("E"), k.cast("string")))
    rows = table(spark, d, "part").select("p_partkey", "p_size", eid.alias("eid"), nothing.alias("wos_id"), nothing.alias("scholar_id"), F.when(k % 4 == 1, F.concat(F.lit("doi:10.1/"), F.col("p_size").cast("string"))).alias("doi"), F.col("p_name").alias("title"), F.col("p_type").alias("date"), F.col("p_brand").alias("creator"), F.col("p_brand").alias("forum"))
    known = canonical.backfilled(rows.where("p_size > 25"), spark.createDataFrame([], "id string")).select(F.col("canonical_id").alias("id"))
    return canonical.backfilled(rows, known).select("p_partkey", "canonical_id", "outcome")
