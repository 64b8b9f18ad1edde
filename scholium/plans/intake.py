"""Events to records, payloads to facts, and the repair of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.folds import STATES
from ..operators.joins import zipped


def parsed(events: DataFrame, *, kind: str, parsers: dict[str, Column], keep: list[str]) -> DataFrame:
    """Keep, record (of the parser for the event's kind) and outcome: parsed; skipped, if no parser
    takes the kind; error, if the parser gives null. Parsers are expressions of one type."""
    record = F.coalesce(*(F.when(F.col(kind) == k, p) for k, p in parsers.items()))
    outcome = F.when(~F.coalesce(F.col(kind).isin(list(parsers)), F.lit(False)), "skipped").when(record.isNull(), "error").otherwise("parsed")
    return events.select(*keep, record.alias("record"), outcome.alias("outcome"))


def _last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key that is not blank, without the order, with its content's hash."""
    fields = [c for c in rows.columns if c not in (key, *order)]
    won = rows.where(F.trim(F.col(key)) != "").groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_f"))
    return won.select(key, *(F.col(f"_f.{c}").alias(c) for c in fields)).withColumn("hash", text.content_hash(*map(F.col, [key, *fields])))


def funding_key(*parts: Column) -> Column:
    """Acronym, number and sponsor; null if all are blank."""
    return F.nullif(text.joined_key(*parts), F.lit("||"))


def facts_of_payloads(events: DataFrame, *, payload: str, order: list[str]) -> dict[str, DataFrame]:
    """P5: publications, forums, authors, affiliations and funding of JSON payloads, each with the hash
    of its own content; of several payloads the last by order holds. Payloads without an eid give nothing."""
    get = lambda f: text.json_text(F.col(payload), f)
    rows = events.where(F.trim(get("eid")) != "")
    publications = rows.select(get("eid").alias("eid"), get("title").alias("title"), get("doi").alias("doi"), get("subtype").alias("subtype"), text.json_int(F.col(payload), "citedby_count").alias("cited_by"), get("source_id").alias("forum_id"), F.coalesce(funding_key(get("fund_acr"), get("fund_no"), get("fund_sponsor")), F.lit("")).alias("funding_id"), text.split_trimmed(get("author_ids"), distinct=True).alias("authors"), *order)
    forums = rows.select(get("source_id").alias("id"), get("publicationName").alias("name"), get("issn").alias("issn"), get("aggregationType").alias("type"), *order)
    pairs = lambda ids, names: zipped(rows.withColumn("_i", text.split_trimmed(get(ids))).withColumn("_n", text.split_trimmed(get(names))), keep=order, left=F.col("_i"), right=F.col("_n")).select(F.col("a").alias("id"), F.col("b").alias("name"), "pos", *order)
    funding = rows.select(funding_key(get("fund_acr"), get("fund_no"), get("fund_sponsor")).alias("id"), get("fund_acr").alias("acronym"), get("fund_no").alias("number"), get("fund_sponsor").alias("sponsor"), *order)
    return {
        "publications": _last(publications, "eid", order), "forums": _last(forums, "id", order), "authors": _last(pairs("author_ids", "author_names"), "id", [*order, "pos"]), "affiliations": _last(pairs("afid", "affilname"), "id", [*order, "pos"]), "funding": _last(funding, "id", order),
    }


def repaired(links: DataFrame, *, source: str = "source", state: str = "state", record: str = "record", target: str = "target") -> DataFrame:
    """Links with their source and state as they should be written, and outcome updated or skipped.
    A state that is none is SKIPPED, a link without a target UNMATCHED; states but those two have no target."""
    own_source, own_target = text.source_name(F.col(source)), text.blank_to_null(F.col(target))
    asked = F.upper(text.jtrim(F.col(state)))
    known = F.when(asked.isin(STATES), asked).otherwise("SKIPPED")
    new_state = F.when((known == "LINKED") & own_target.isNull(), "UNMATCHED").otherwise(known)
    new = {source: F.coalesce(own_source, F.col(source)), state: new_state, record: F.coalesce(text.blank_to_null(F.col(record)), F.col(record)), target: F.when(known.isin("LINKED", "UNMATCHED"), F.col(target))}
    made = links.select("*", *(c.alias(f"_{k}") for k, c in new.items()))
    same = F.lit(True)
    for k in new:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return made.select(*(F.col(f"_{c}").alias(c) if c in new else c for c in links.columns), F.when(same, "skipped").otherwise("updated").alias("outcome"))
