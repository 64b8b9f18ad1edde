"""Source facts to canonical entities: ladders of identifiers, links, merges and edges.

Ladders are one join on exploded identifiers, so null identifiers are never shuffled and any
number of rungs costs the same two shuffles. Batches are judged as a whole where a sequential
run would depend on the order of rows; each function says by which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: What stands for "no identifier" in the citation index, prefixes of canonical ids.
NON_WOS_ID = "NON_WOS"
AFFILIATION, AUTHOR, FORUM, PUBLICATION, CITATION = "saff_", "sauth_", "sforum_", "spub_", "scit_"


def _token(c: Column) -> Column:
    return F.coalesce(text.token(c), F.lit(""))


def _labelled(*parts: tuple[str, Column]) -> Column:
    """label|token|label|token..."""
    return F.array_join(F.array(*(x for label, c in parts for x in (F.lit(label), _token(c)))), "|")


def _first_given(*rungs: tuple[str, Column], otherwise: Column) -> Column:
    return F.coalesce(*(F.when(text.blank_to_null(c).isNotNull(), _labelled((label, c))) for label, c in rungs), otherwise)


def affiliation_id(record: Column, name: Column, city: Column, country: Column) -> Column:
    material = _first_given(("scopus", record), otherwise=_labelled(("name", text.fingerprint(name)), ("city", city), ("country", country)))
    return F.concat(F.lit(AFFILIATION), text.short_hash(material))


def author_id(source: Column, record: Column) -> Column:
    return F.concat(F.lit(AUTHOR), text.short_hash(_labelled(("source", F.coalesce(text.token(source), F.lit("unknown"))), ("author", record))))


def forum_id(issns: Column, name: Column, aggregation: Column) -> Column:
    """Of all ISSN tokens, in order; without any, of the normalised name and aggregation."""
    given = F.array_sort(F.array_distinct(F.filter(issns, lambda t: t.isNotNull())))
    by_name = F.array_join(F.array(F.lit("nameAgg"), _token(name), _token(aggregation)), "|")
    return F.concat(F.lit(FORUM), text.short_hash(F.when(F.size(given) > 0, F.concat(F.lit("issn|"), F.array_join(given, "|"))).otherwise(by_name)))


def publication_id(*, eid: Column, wos_id: Column, scholar_id: Column, user_id: Column, doi: Column, title: Column, date: Column, creator: Column, forum: Column) -> Column:
    """Of the first identifier given; without any, of title, date, creator and forum."""
    rest = _labelled(("title", title), ("date", date), ("creator", creator), ("forum", forum))
    material = _first_given(("eid", eid), ("wos", wos_id), ("gs", scholar_id), ("user", user_id), ("doi", doi), otherwise=rest)
    return F.concat(F.lit(PUBLICATION), text.short_hash(material))


def targets(df: DataFrame, known: DataFrame, *, key: str, target: str, rungs: list[str], unique: list[str] = ()) -> DataFrame:
    """Df with rung, target_id and several: what the first of its rungs (columns of both
    sides, text or arrays of text) that finds any row of known finds. Several rows of known: the
    least target, or null where the rung is in unique. key is expected once. What shares an
    identifier is reduced to its least and greatest target before the join, so no pairs are made."""
    shown = lambda r: F.col(r) if r in arrays else F.array(F.col(r).cast("string"))
    arrays = {c for c, kind in df.dtypes if kind.startswith("array")}

    def exploded(side: DataFrame, column: str) -> DataFrame:
        tagged = lambda i: lambda x: F.struct(F.lit(i).alias("r"), text.blank_to_null(x).alias("v"))
        each = F.concat(*(F.transform(F.coalesce(shown(r), F.array().cast("array<string>")), tagged(i)) for i, r in enumerate(rungs)))
        return side.select(F.col(column).alias("_k"), F.explode(each).alias("_x")).select("_k", "_x.r", "_x.v").where("v is not null")

    held = exploded(known, target).groupBy("r", "v").agg(F.min("_k").alias("t"), F.max("_k").alias("u"))
    at = lambda i, c: F.when(F.col("r") == i, F.col(c))
    found = exploded(df, key).join(held, ["r", "v"]).groupBy("_k").agg(*(x for i in range(len(rungs)) for x in (F.min(at(i, "t")).alias(f"_t{i}"), F.max(at(i, "u")).alias(f"_u{i}"))))
    first = F.coalesce(*(F.when(F.col(f"_t{i}").isNotNull(), F.struct(F.lit(r).alias("rung"), F.col(f"_t{i}").alias("t"), (F.col(f"_t{i}") != F.col(f"_u{i}")).alias("several"))) for i, r in enumerate(rungs)))
    best = found.select("_k", first.alias("_b"))
    several = F.coalesce("_b.several", F.lit(False))
    refused = several & F.coalesce(F.col("_b.rung").isin(*unique), F.lit(False)) if unique else F.lit(False)
    return df.join(best, df[key] == best["_k"], "left").select(*(df[c] for c in df.columns), F.col("_b.rung").alias("rung"), F.when(~refused, F.col("_b.t")).alias("target_id"), several.alias("several"))


def assigned(facts: DataFrame, links: DataFrame, known: DataFrame, *, record: str, fallback: Column) -> DataFrame:
    """Facts (each record once) with canonical_id: that of the record's link (links: record,
    canonical_id), else of the known entity that holds the record (known: canonical_id, records),
    else fallback. outcome: skipped without a record, updated where the entity is known or an
    earlier record of these facts makes it, else imported."""
    given = facts.withColumn("_rec", text.blank_to_null(F.col(record).cast("string")))
    by_link = links.where("canonical_id is not null").groupBy(F.col("record").cast("string").alias("_rec")).agg(F.min("canonical_id").alias("_l"))
    by_record = known.select("canonical_id", F.explode("records").alias("_rec")).where("_rec is not null").groupBy("_rec").agg(F.min("canonical_id").alias("_s"))
    here = given.where("_rec is not null")
    made = here.join(by_link, "_rec", "left").join(by_record, "_rec", "left").withColumn("canonical_id", F.coalesce("_l", "_s", fallback)).drop("_l", "_s")
    first = made.groupBy("canonical_id").agg(F.min("_rec").alias("_first"))
    old = known.select("canonical_id", F.lit(True).alias("_old")).distinct()
    state = F.when(F.col("_old") | (F.col("_rec") != F.col("_first")), "updated").otherwise("imported")
    done = made.join(first, "canonical_id").join(old, "canonical_id", "left").withColumn("outcome", state)
    skipped = given.where("_rec is null").withColumns({"canonical_id": F.lit(None).cast("string"), "outcome": F.lit("skipped")})
    columns = [*facts.columns, "canonical_id", "outcome"]
    return done.select(*columns).unionByName(skipped.select(*columns))


def entities(facts: DataFrame, *, record: str, order: list[str], fields: list[str]) -> DataFrame:
    """Canonical rows of assigned facts: their records in order, and the last fact's fields."""
    held = facts.where("canonical_id is not null")
    agg = held.groupBy("canonical_id").agg(F.array_sort(F.collect_set(F.col(record).cast("string"))).alias("records"), F.max_by(F.struct(*fields), F.struct(*order)).alias("_f"))
    return agg.select("canonical_id", "records", *(F.col(f"_f.{c}").alias(c) for c in fields))


def bridged(df: DataFrame, links: DataFrame, *, key: str, ids: str, source: str) -> DataFrame:
    """Df with canonical_ids for an array of a source's ids, in its order, each once: by link
    (source, record, canonical_id), else an id made of source and id; the latter's source ids are
    pending_ids. Blank ids go; key is expected once."""
    each = df.select(key, F.posexplode(ids).alias("_p", "_raw"), text.source_name(F.col(source)).alias("_src")).withColumn("_id", text.blank_to_null(F.col("_raw"))).where("_id is not null")
    linked = links.where("canonical_id is not null").groupBy(text.source_name(F.col("source")).alias("_src"), F.col("record").alias("_id")).agg(F.min("canonical_id").alias("_c"))
    found = each.join(linked, ["_src", "_id"], "left").withColumn("_canon", F.coalesce("_c", author_id(F.col("_src"), F.col("_id"))))
    row = F.struct("_p", F.col("_canon").alias("c"), F.when(F.col("_c").isNull(), F.col("_id")).alias("pending"))
    made = found.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_all"))
    none = F.array().cast("array<string>")
    pending = F.array_distinct(F.filter(F.col("_all.pending"), lambda x: x.isNotNull()))
    return df.join(made.select(key, F.array_distinct("_all.c").alias("canonical_ids"), pending.alias("pending_ids")), key, "left").withColumns({c: F.coalesce(c, none) for c in ("canonical_ids", "pending_ids")})


def pending_links(df: DataFrame, *, source: str) -> DataFrame:
    """UNMATCHED links of what bridged left pending, each once."""
    each = df.select(text.source_name(F.col(source)).alias("source"), F.explode("pending_ids").alias("record")).distinct()
    return each.select("source", "record", author_id(F.col("source"), F.col("record")).alias("canonical_id"), F.lit("UNMATCHED").alias("state"))


def citation_edges(citations: DataFrame, publications: DataFrame) -> DataFrame:
    """Citations (cited_eid, citing_eid) with both publications' ids, an edge id, and reason where
    an end is unresolved (the cited one first); publications: eid, id. Repeated citations are one.
    Outer joins on the many side's key: AQE splits a cited publication that holds most rows."""
    ids = publications.where("eid is not null").groupBy("eid").agg(F.min("id").alias("id"))
    end = lambda name: ids.select(F.col("eid").alias(f"{name}_eid"), F.col("id").alias(f"{name}_id"))
    both = citations.select("cited_eid", "citing_eid").distinct().join(end("cited"), "cited_eid", "left").join(end("citing"), "citing_eid", "left")
    reason = F.when(F.col("cited_id").isNull(), "UNRESOLVED_CITED_PUBLICATION").when(F.col("citing_id").isNull(), "UNRESOLVED_CITING_PUBLICATION")
    edge = F.when(reason.isNull(), F.concat(F.lit(CITATION), text.short_hash(F.concat_ws("|", "cited_id", "citing_id"))))
    return both.select("cited_eid", "citing_eid", "cited_id", "citing_id", edge.alias("edge_id"), reason.alias("reason"))


def enrichment_links(incoming: DataFrame, publications: DataFrame, *, item: str, external: str) -> DataFrame:
    """P10: item, state, reason and target_id for incoming (item, id, eid, doi and an external id),
    found among publications (id, eid, doi, external id) by id, eid, then a DOI that only one has.
    SKIPPED without an external id; CONFLICT where the DOI is several publications', the target has
    another external id, or another publication has this one; else LINKED. Within the batch a claim
    yields to the claims of lesser items on its target or its external id, granted or not."""
    doi = lambda df: df.withColumn("doi", text.normalize_doi(F.col("doi")))
    value = F.col("_ext")
    asked = doi(incoming).withColumn("_ext", text.blank_to_null(F.col(external)))
    skipped = asked.where(value.isNull() | (value == NON_WOS_ID)).select(item, F.lit("SKIPPED").alias("state"), F.lit("non-wos-or-empty").alias("reason"), F.lit(None).cast("string").alias("target_id"))
    held = doi(publications).select("id", "eid", "doi", text.blank_to_null(F.col(external)).alias("_own"))
    found = targets(asked.where(value.isNotNull() & (value != NON_WOS_ID)), held, key=item, target="id", rungs=["id", "eid", "doi"], unique=["doi"])
    own = held.select(F.col("id").alias("target_id"), "_own")
    holders = held.where("_own is not null").groupBy(F.col("_own").alias("_ext")).agg(F.min("id").alias("_h0"), F.max("id").alias("_h1"))
    with_own = found.join(own, "target_id", "left").join(holders, "_ext", "left")
    other_key = F.col("_own").isNotNull() & (F.col("_own") != value)
    elsewhere = (F.col("_h0") != F.col("target_id")) | (F.col("_h1") != F.col("target_id"))
    reason = (
        F.when(F.col("several") & F.col("target_id").isNull(), "ambiguous-doi").when(F.col("target_id").isNull(), "no-id-eid-doi-match")
        .when(other_key, "target-has-other-key").when(F.coalesce(elsewhere, F.lit(False)), "key-assigned")
    )
    judged = with_own.withColumn("reason", reason)
    claims = judged.where("reason is null")
    by_target = claims.groupBy("target_id").agg(F.min_by("_ext", item).alias("_t"))
    by_key = claims.groupBy("_ext").agg(F.min_by("target_id", item).alias("_k"))
    settled = judged.join(by_target, "target_id", "left").join(by_key, "_ext", "left")
    settled = settled.withColumn("reason", F.coalesce("reason", F.when(F.col("_t") != value, "target-has-other-key").when(F.col("_k") != F.col("target_id"), "key-assigned"), F.lit("linked")))
    state = F.when(F.col("reason") == "linked", "LINKED").when(F.col("reason") == "no-id-eid-doi-match", "UNMATCHED").otherwise("CONFLICT")
    return settled.select(item, state.alias("state"), "reason", "target_id").unionByName(skipped)


def onboarded(journals: DataFrame, forums: DataFrame, scopus: DataFrame, links: DataFrame) -> DataFrame:
    """Journals (id, name, issns; each once, identities resolved, so that no two share an
    ISSN) to canonical forums (id, name, aggregation, issn, eissn, aliases). The target is that of
    the journal's link (links: record, canonical_id) if it exists; else the forum that shares any
    ISSN; for a journal without ISSNs that of its name and type. Several: CONFLICT, else the row of
    the merged forum: values of the single matching Scopus forum (scopus: id, name, aggregation,
    issn, eissn) win over the target's own, and those over the journal's."""
    name_key = lambda n, a: F.concat_ws("|", text.fingerprint(n), text.token(a))
    of = lambda df, *cols: df.withColumn("_issns", F.filter(F.array_distinct(F.concat(*cols)), lambda x: x.isNotNull()))
    two = F.array(text.issn_token(F.col("issn")), text.issn_token(F.col("eissn")))
    none = F.array().cast("array<string>")
    aliases = F.transform(F.coalesce("aliases", none), text.issn_token)
    f = of(forums, two, aliases).withColumn("_named", name_key(F.col("name"), F.col("aggregation")))
    s = of(scopus, two).withColumn("_named", name_key(F.col("name"), F.col("aggregation")))
    j = of(journals.select("id", "name", "issns"), F.transform(F.coalesce("issns", none), text.issn_token)).drop("issns")
    j = j.withColumn("name", F.coalesce(text.blank_to_null(F.col("name")), F.col("id"))).withColumn("_by_name", name_key(F.col("name"), F.lit("Journal")))
    ask = j.withColumn("_named", F.when(F.size("_issns") == 0, F.col("_by_name")))
    found = targets(ask, f, key="id", target="id", rungs=["_issns", "_named"]).withColumnsRenamed({"target_id": "_t", "several": "_nt", "rung": "_rt"}).withColumn("_named", F.col("_by_name"))
    found = targets(found, s, key="id", target="id", rungs=["_issns", "_named"]).withColumnsRenamed({"target_id": "_s", "several": "_ns"}).drop("rung", "_named")
    valid = links.join(forums.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").groupBy(F.col("record").alias("id")).agg(F.min("canonical_id").alias("_l"))
    picked = found.join(valid, "id", "left").withColumns({"_conflict": F.col("_l").isNull() & F.col("_nt"), "_t": F.coalesce("_l", F.when(~F.col("_nt"), F.col("_t"))), "_s": F.when(~F.col("_ns"), F.col("_s"))})
    side = lambda df, key, label, cols: df.select(F.col("id").alias(key), F.struct(*cols).alias(label))
    row = picked.join(side(f, "_t", "f", ["name", "aggregation", "issn", "eissn", "_issns"]), "_t", "left").join(side(s, "_s", "s", ["name", "aggregation", "issn", "eissn"]), "_s", "left")
    given = lambda c: text.blank_to_null(F.col(c))
    issn = F.coalesce(text.issn_token(F.col("s.issn")), text.issn_token(F.col("f.issn")), F.get("_issns", F.lit(0)))
    eissn = F.coalesce(text.issn_token(F.col("s.eissn")), text.issn_token(F.col("f.eissn")), F.get("_issns", F.lit(1)))
    row = row.select("id", "_conflict", "_t", "_s", "_rt", "_issns", F.col("f._issns").alias("_old"), issn.alias("issn"), eissn.alias("eissn"), F.coalesce(given("s.name"), given("f.name"), "name").alias("name"), F.coalesce(given("s.aggregation"), given("f.aggregation"), F.lit("Journal")).alias("aggregation"))
    every = F.concat(F.coalesce("_old", none), F.col("_issns"))
    row = row.withColumn("aliases", F.array_distinct(F.filter(every, lambda x: ~x.eqNullSafe(F.col("issn")) & ~x.eqNullSafe(F.col("eissn")))))
    own = forum_id(F.concat(F.array("issn", "eissn"), F.col("aliases")), text.fingerprint(F.col("name")), F.col("aggregation"))
    ok = lambda c: F.when(~F.col("_conflict"), c)
    reason = F.when(F.col("_rt") == "_issns", "AMBIGUOUS_ISSN").otherwise("AMBIGUOUS_NAME_AGG")
    state = F.when(F.col("_conflict"), "CONFLICT").when(F.col("_t").isNull(), "IMPORTED").otherwise("UPDATED")
    return row.select(F.col("id").alias("journal"), state.alias("state"), F.when(F.col("_conflict"), reason).alias("reason"), ok(F.coalesce("_t", own)).alias("forum_id"), ok(F.col("_s")).alias("scopus_id"), *(ok(F.col(c)).alias(c) for c in ("name", "aggregation", "issn", "eissn", "aliases")))


def collided_links(publications: DataFrame, links: DataFrame) -> DataFrame:
    """Publications (id, wos_id) to LINKED rows, or CONFLICT where links (record, canonical_id)
    give their external id to another publication, or publications share it."""
    named = publications.select("id", text.blank_to_null(F.col("wos_id")).alias("record")).where(f"record is not null and upper(record) <> '{NON_WOS_ID}'").distinct()
    every = links.select(F.col("canonical_id").alias("id"), "record").where("id is not null").unionByName(named)
    bounds = every.groupBy("record").agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    return named.join(bounds, "record").select("record", "id", F.when(F.col("_a") == F.col("_b"), "LINKED").otherwise("CONFLICT").alias("state"))


def user_publications(facts: DataFrame, publications: DataFrame) -> DataFrame:
    """Facts (record once, eid, doi, title, date, creator, forum) with canonical_id and outcome, by
    the user's record, eid, then a DOI that only one of publications (id, user_record, eid, doi) has;
    skipped without a record, CONFLICT for a DOI that several have. A fact keeps the id of its material,
    whatever it is found by, so previous_id says which publication it replaces."""
    doi = lambda df: df.withColumn("_doi", text.normalize_doi(F.col("doi")))
    asked = doi(facts).withColumn("user_record", text.blank_to_null(F.col("record")))
    found = targets(asked, doi(publications), key="record", target="id", rungs=["user_record", "eid", "_doi"], unique=["_doi"])
    nothing = F.lit(None).cast("string")
    own = publication_id(eid=F.col("eid"), wos_id=nothing, scholar_id=nothing, user_id=F.col("user_record"), doi=F.col("_doi"), title=text.normalize_text(F.col("title")), date=F.col("date"), creator=F.col("creator"), forum=F.col("forum"))
    clash = F.col("target_id").isNull() & F.col("several")
    outcome = F.when(F.col("user_record").isNull(), "skipped").when(clash, "conflict").when(F.col("target_id").isNotNull(), "updated").otherwise("imported")
    made = found.withColumn("outcome", outcome)
    return made.select(*facts.columns, F.when(F.col("outcome").isin("updated", "imported"), own).alias("canonical_id"), F.col("target_id").alias("previous_id"), "outcome")


def backfilled(legacy: DataFrame, known: DataFrame) -> DataFrame:
    """Legacy rows (eid, wos_id, scholar_id, doi, title, date, creator, forum) with canonical_id and
    outcome; known: id. Rows of one material get one id, so a second run imports nothing."""
    nothing = F.lit(None).cast("string")
    own = publication_id(eid=F.col("eid"), wos_id=F.col("wos_id"), scholar_id=F.col("scholar_id"), user_id=nothing, doi=text.normalize_doi(F.col("doi")), title=text.normalize_text(F.col("title")), date=F.col("date"), creator=F.col("creator"), forum=F.col("forum"))
    held = known.select(F.col("id").alias("canonical_id"), F.lit(True).alias("_known")).distinct()
    return legacy.withColumn("canonical_id", own).join(held, "canonical_id", "left").select(*legacy.columns, "canonical_id", F.when(F.col("_known"), "updated").otherwise("imported").alias("outcome"))
