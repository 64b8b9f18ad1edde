"""Candidates, refreshed views, synced slices and what users and links bring, on the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import joins
from .plans import canonical, views
from .queries import query, table


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), m AS (SELECT l_orderkey, count(*) m FROM t GROUP BY 1)
SELECT l_orderkey, p_brand, count(*) n FROM t JOIN part ON l_partkey = p_partkey JOIN m USING (l_orderkey) GROUP BY l_orderkey, p_brand, m HAVING count(*) >= ceil(m * 0.5)""")
def token_candidates(spark, d):
    """Known entities that have at least half of a key's tokens, looked up by the rarest ones."""
    return joins.likely(table(spark, d, "lineitem"), table(spark, d, "part"), key="l_orderkey", token="l_partkey", entity="p_brand", known_token="p_partkey", share=0.5)


def _totals(df):
    return df.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, sum(CASE WHEN l_orderkey % 997 = 3 THEN l_quantity + 1 ELSE l_quantity END)::BIGINT total, count(*) n FROM lineitem WHERE NOT (l_orderkey % 1009 = 5 AND l_linenumber = 1) GROUP BY 1""")
def refreshed_totals(spark, d):
    """A view after edits of its source: only slices whose rows differ are built anew."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    changed = F.when(F.col("l_orderkey") % 997 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast(dict(old.dtypes)["l_quantity"])
    new = old.where("NOT (l_orderkey % 1009 = 5 AND l_linenumber = 1)").withColumn("l_quantity", changed)
    return views.refreshed(_totals(old), old, new, _totals, key=["l_orderkey"])


@query("""SELECT * FROM (VALUES (1, 'customer', 'rebuilt'), (1, 'orders', 'rebuilt'), (1, 'part', 'rebuilt'), (2, 'customer', 'skipped'), (2, 'orders', 'rebuilt'), (2, 'part', 'skipped'), (3, 'customer', 'skipped'), (3, 'orders', 'failed'), (4, 'customer', 'skipped'), (4, 'orders', 'rebuilt'), (4, 'part', 'skipped')) v(run, slice, outcome)
WHERE (SELECT count(*) FROM orders) > 0""")
def synced_slices(spark, d):
    """What four runs do to three slices: all are built; then only the one that changed; one that fails ends its run and stays due."""
    orders = table(spark, d, "orders")

    def fail(_):
        raise ValueError("no")

    def run(orders, build):
        slices = {"customer": (table(spark, d, "customer"), ["c_custkey"], lambda df: None), "orders": (orders, ["o_orderkey"], build), "part": (table(spark, d, "part"), ["p_partkey", "p_name"], lambda df: None)}
        return views.synced(spark, slices, state)

    state, less = {}, orders.where("o_orderkey % 2 = 0")
    runs = [run(orders, lambda df: None), run(less, lambda df: None), run(orders, fail), run(orders, lambda df: None)]
    return spark.createDataFrame([(i, name, outcome.split(":")[0]) for i, done in enumerate(runs, 1) for name, outcome in done], "run int, slice string, outcome string")


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN 'u' || c_custkey END record, CASE WHEN c_custkey % 3 = 0 THEN 'e' || c_custkey END eid, CASE WHEN c_custkey % 3 = 1 THEN '10.1/' || (c_custkey % 50) END doi FROM customer),
p AS (SELECT 'p' || p_partkey id, CASE WHEN p_partkey % 5 = 0 THEN 'u' || p_partkey END user_record, CASE WHEN p_partkey % 2 = 0 THEN 'e' || p_partkey END eid, CASE WHEN p_partkey % 7 = 0 AND p_partkey < 500 THEN '10.1/' || (p_partkey % 60) END doi FROM part),
d AS (SELECT doi, min(id) a, max(id) b FROM p WHERE doi IS NOT NULL GROUP BY 1)
SELECT c_custkey, CASE WHEN record IS NOT NULL THEN coalesce(r.id, e.id, CASE WHEN a = b THEN a END) END previous_id,
CASE WHEN record IS NULL THEN 'skipped' WHEN coalesce(r.id, e.id) IS NOT NULL OR a = b THEN 'updated' WHEN a <> b THEN 'conflict' ELSE 'imported' END outcome
FROM f LEFT JOIN p r ON r.user_record = record LEFT JOIN p e ON e.eid = f.eid LEFT JOIN d ON d.doi = f.doi""")
def user_facts(spark, d):
    """Publications that users enter, found by record, then eid, then a DOI that only one has."""
    k, j = F.col("c_custkey"), F.col("p_partkey")
    said = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    facts = table(spark, d, "customer").select("c_custkey", F.when(k % 11 > 0, said("u", k)).alias("record"), F.when(k % 3 == 0, said("e", k)).alias("eid"), F.when(k % 3 == 1, said("10.1/", k % 50)).alias("doi"), F.col("c_name").alias("title"), F.lit("2020").alias("date"), F.col("c_name").alias("creator"), F.lit("f").alias("forum"))
    pubs = table(spark, d, "part").select(said("p", j).alias("id"), F.when(j % 5 == 0, said("u", j)).alias("user_record"), F.when(j % 2 == 0, said("e", j)).alias("eid"), F.when((j % 7 == 0) & (j < 500), said("10.1/", j % 60)).alias("doi"))
    return canonical.user_publications(facts, pubs).select("c_custkey", "previous_id", "outcome")


@query("""WITH n AS (SELECT 'p' || p_partkey id, CASE WHEN p_partkey % 4 > 0 THEN 'w' || (p_partkey % 1300) WHEN p_partkey % 8 > 0 THEN ' ' END record FROM part), g AS (SELECT DISTINCT id, record FROM n WHERE trim(record) <> ''),
e AS (SELECT id, record FROM g UNION ALL SELECT 'p' || s_suppkey, 'w' || (s_suppkey % 200) FROM supplier), b AS (SELECT record, min(id) a, max(id) z FROM e GROUP BY 1)
SELECT g.record, g.id, CASE WHEN a = z THEN 'LINKED' ELSE 'CONFLICT' END state FROM g JOIN b USING (record)""")
def onboarded_links(spark, d):
    """External ids of publications, in conflict where a link or another publication holds them."""
    j, s = F.col("p_partkey"), F.col("s_suppkey")
    said = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    pubs = table(spark, d, "part").select(said("p", j).alias("id"), F.when(j % 4 > 0, said("w", j % 1300)).when(j % 8 > 0, " ").alias("wos_id"))
    links = table(spark, d, "supplier").select(said("w", s % 200).alias("record"), said("p", s).alias("canonical_id"))
    return canonical.collided_links(pubs, links)
