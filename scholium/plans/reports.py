"""Indicator, criterion and threshold reports of all researchers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formula
from ..operators.ranking import top, top_titles


def author_scores(scored: DataFrame, expression: str) -> DataFrame:
    """scored (score, n_authors, quarter and whatever the formula names) with author_score: the
    formula where score is above 0, else 0."""
    named = scored.withColumns({"S": F.col("score"), "N": F.col("n_authors").cast("double"), "Q": F.col("quarter")})
    value = formula.compiled(expression, set(named.columns))
    return named.withColumn("author_score", F.when(F.col("score") > 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0)).drop("S", "N", "Q")


def indicator_totals(scored: DataFrame, *, key: list[str], selector: str = "ALL", title: str | None = None) -> DataFrame:
    """key, n and total of author_score; selector TOP_10 takes the ten best (title: each title once)."""
    if selector == "TOP_10":
        order = [F.coalesce("author_score", F.lit(0.0)).desc(), F.asc("item")]
        scored = top_titles(scored, group=key, title=title, score="author_score", tie="item") if title else top(scored, group=key, order=order, n=10)
    return scored.groupBy(*key).agg(F.count("*").alias("n"), F.coalesce(F.sum("author_score"), F.lit(0.0)).alias("total"))


def scores_by_title(scored: DataFrame, *, key: list[str], title: str, order: str) -> DataFrame:
    """Q1: scored as a report keyed by title sees it: each row has the author_score of its title's last row
    with a positive score (by order), or 0; rows of one title then count once each in any total."""
    kept = scored.where(F.coalesce("score", F.lit(0.0)) + F.coalesce("author_score", F.lit(0.0)) > 0)
    by = [*key, title]
    last = kept.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).agg(F.max_by("author_score", order).alias("_last"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return scored.join(last, same, "left").select(*(c for c in scored.columns if c != "author_score"), F.coalesce("_last", F.lit(0.0)).alias("author_score"))


def criteria(totals: DataFrame, config: DataFrame) -> DataFrame:
    """totals (owner, indicator, total) summed by criterion; config: criterion, indicators (array of
    indicator numbers). A number without an indicator is counted in n_missing."""
    members = config.select("criterion", F.explode("indicators").alias("indicator"))
    known = totals.select("indicator").distinct().withColumn("known", F.lit(True))
    missing = members.join(known, "indicator", "left").groupBy("criterion").agg(F.count_if(F.col("known").isNull()).alias("n_missing"))
    sums = totals.join(members, "indicator").groupBy("owner", "criterion").agg(F.sum("total").alias("score"))
    return sums.join(missing, "criterion")


def judged(scores: DataFrame, thresholds: DataFrame, positions: DataFrame) -> DataFrame:
    """scores (owner, criterion, score) with passed: score reaches the threshold of the owner's
    position (the first position by name where the owner's has none)."""
    first = thresholds.groupBy("criterion").agg(F.min_by("threshold", "position").alias("first"))
    own = scores.join(positions, "owner", "left").join(thresholds, ["criterion", "position"], "left").join(first, "criterion", "left")
    limit = F.coalesce("threshold", "first")
    return own.select("owner", "criterion", "score", limit.alias("threshold"), (F.col("score") >= limit).alias("passed"))


def run_status(errors: DataFrame, results: DataFrame, *, owner: str = "owner") -> DataFrame:
    """FAILED without results, PARTIAL with errors, else READY."""
    e, r = errors.groupBy(owner).agg(F.count("*").alias("n_errors")), results.groupBy(owner).agg(F.count("*").alias("n_results"))
    status = F.when(F.col("n_results").isNull(), "FAILED").when(F.col("n_errors") > 0, "PARTIAL").otherwise("READY")
    return r.join(e, owner, "full_outer").select(owner, status.alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"))
