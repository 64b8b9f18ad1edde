"""Event ledgers: idempotent upserts by key and payload hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def upserted(ledger: DataFrame, staged: DataFrame, *, key: list[str], payload: list[str]) -> DataFrame:
    """All keys with the payload that holds after the upsert, and the outcome: imported, updated,
    skipped (same hash) or kept (not staged). Staged keys are expected once (see latest)."""
    new = staged.select(*key, F.struct(*payload).alias("_new"), content_hash(*map(F.col, payload)).alias("_h"))
    old = ledger.select(*key, F.struct(*payload).alias("_old"), content_hash(*map(F.col, payload)).alias("_g"))
    outcome = F.when(F.col("_h").isNull(), "kept").when(F.col("_g").isNull(), "imported").when(F.col("_h") == F.col("_g"), "skipped").otherwise("updated")
    both = old.join(new, key, "full_outer").withColumn("outcome", outcome).withColumn("_row", F.coalesce("_new", "_old"))
    return both.select(*key, *(F.col(f"_row.{c}").alias(c) for c in payload), "outcome")


def inserted(ledger: DataFrame, staged: DataFrame, *, key: list[str], payload: list[str]) -> DataFrame:
    """The staged rows whose key and payload hash the ledger lacks, each once."""
    hashed = lambda df: df.withColumn("payload_hash", content_hash(*map(F.col, payload)))
    return hashed(staged).dropDuplicates([*key, "payload_hash"]).join(hashed(ledger).select(*key, "payload_hash"), [*key, "payload_hash"], "left_anti")


def edges_upserted(stored: DataFrame, commands: DataFrame, *, key: list[str], edge_id: str, made_id: Column, lineage: list[str], order: str) -> DataFrame:
    """Key, edge_id and lineage of the edges that the commands ask for, and what is done: insert, update
    (the lineage differs), none, or reject (a key column is null or blank; a row for each such command).
    Of a key's commands the last in order holds; a stored edge keeps its id, and conflict tells that it
    isn't the one made from the key (made_id, over key columns). Stored edges are expected once."""
    lacking = F.lit(False)
    for c in key:
        lacking = lacking | F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    asked = commands.select(*key, F.col(order).alias("_o"), F.struct(*lineage).alias("_new"), lacking.alias("_bad"))
    last = asked.where("not _bad").groupBy(*key).agg(F.max_by("_new", F.struct("_o", "_new")).alias("_new"))
    both = last.join(stored.select(*key, F.col(edge_id).alias("_id"), F.struct(*lineage).alias("_old"), F.lit(True).alias("_held")), key, "left")
    action = F.when(F.col("_held").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "none").otherwise("update")
    conflict = F.coalesce((F.trim("_id") != "") & (F.col("_id") != made_id), F.lit(False))
    done = both.select(*key, F.coalesce("_id", made_id).alias(edge_id), *(F.col(f"_new.{c}").alias(c) for c in lineage), action.alias("action"), conflict.alias("conflict"))
    none = asked.where("_bad").select(*key, F.lit(None).cast("string").alias(edge_id), *(F.col(f"_new.{c}").alias(c) for c in lineage), F.lit("reject").alias("action"), F.lit(False).alias("conflict"))
    return done.unionByName(none)


def outcomes(df: DataFrame) -> DataFrame:
    return df.groupBy("outcome").agg(F.count("*").alias("n"))
