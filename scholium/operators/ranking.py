"""Ranks, quartiles, top rows and best rows within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quartile(position: Column, n: Column) -> Column:
    """Q1 up to the first ceil(n/4) positions, Q2 to ceil(n/2), Q3 to ceil(3n/4), else Q4 (not ntile)."""
    return F.when(4 * position <= n + 3, "Q1").when(2 * position <= n + 1, "Q2").when(4 * position <= 3 * n + 3, "Q3").otherwise("Q4")


def ranked(df: DataFrame, *, group: list[str], value: str, tie: str, source_quarter: str | None = None) -> DataFrame:
    """df with rank (1, 2, 2, 4), quarter by position (ties by tie, or source_quarter where it is
    given) and quartile_rank, the rank inside the quarter. Rows without a value are left out."""
    w = Window.partitionBy(*group)
    best = w.orderBy(F.col(value).desc())
    found = df.where(F.col(value).isNotNull())
    found = found.withColumn("rank", F.rank().over(best)).withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(F.col(value).desc(), F.col(tie))))
    computed = quartile(F.col("_at"), F.col("_n"))
    found = found.withColumn("quarter", F.coalesce(source_quarter and F.col(source_quarter), computed) if source_quarter else computed).drop("_n", "_at")
    return found.withColumn("quartile_rank", F.rank().over(Window.partitionBy(*group, "quarter").orderBy(F.col(value).desc())))


def filled(df: DataFrame, *, key: list[str], group: list[str], value: str, tie: str) -> DataFrame:
    """df with missing rank, quarter and quartile_rank filled: the ranking is among the rows
    that miss any of them and have a value; what is given stays."""
    missing = df.where(F.col("rank").isNull() | F.col("quarter").isNull() | F.col("quartile_rank").isNull())
    made = ranked(missing.withColumnRenamed("quarter", "_given").drop("rank", "quartile_rank"), group=group, value=value, tie=tie, source_quarter="_given")
    made = made.select(*key, F.col("rank").alias("_r"), F.col("quarter").alias("_q"), F.col("quartile_rank").alias("_k"))
    new = {"rank": "_r", "quarter": "_q", "quartile_rank": "_k"}
    return df.join(made, key, "left").withColumns({c: F.coalesce(c, n) for c, n in new.items()}).drop(*new.values())


def top(df: DataFrame, *, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n of each task's rows before it shuffles them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top_titles(df: DataFrame, *, group: list[str], title: str, score: str, tie: str, n: int = 10) -> DataFrame:
    """Each title's first best row, and of those the n best: no title counts twice."""
    order = [F.coalesce(score, F.lit(0.0)).desc(), F.col(tie)]
    return top(top(df, group=[*group, title], order=order, n=1), group=group, order=order, n=n)


def latest(df: DataFrame, *, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order, by a partial aggregate and no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def h_index(df: DataFrame, *, key: list[str], cited: str) -> DataFrame:
    """The most h such that h rows of a key have h or more each. Rows are counted by value
    first, so a key's window holds its distinct values, not its rows."""
    counts = df.where(F.col(cited) > 0).groupBy(*key, F.col(cited).alias("_c")).agg(F.count("*").alias("_k"))
    at_least = F.sum("_k").over(Window.partitionBy(*key).orderBy(F.col("_c").desc()))
    found = counts.withColumn("_h", F.least(at_least, F.col("_c"))).groupBy(*key).agg(F.max("_h").alias("_h"))
    return df.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("_h", F.lit(0)).cast("long").alias("h_index"))


def top_count(df: DataFrame, *, group: list[str], entity: str, share: float = 0.2) -> DataFrame:
    """Distinct entities of each group, and the cut below which a rank is in the top share."""
    return df.groupBy(*group).agg(F.count_distinct(entity).alias("n")).withColumn("cut", F.floor(F.col("n") * share).cast("long"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, *, key: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row that changes when rows or the greatest values do."""
    parts = [F.count("*").cast("string"), *(F.coalesce(F.max(c).cast("string"), F.lit("")) for c in columns)]
    return df.agg(F.concat_ws("|", *parts).alias("_f")).select(F.sha2("_f", 256).alias("fingerprint"))
