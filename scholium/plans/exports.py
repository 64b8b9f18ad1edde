"""Tables that leave the library: institutions' publications, a file for each member, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.joins import names_in_order

FIELDS = ["eid", "doi", "title", "year", "authors", "forum", "citations"]


def _lines(publications: DataFrame, authors: DataFrame, forums: DataFrame) -> DataFrame:
    named = names_in_order(publications, authors, key="id", ids="author_ids", name_id="id", name="name", out="_names")
    names = forums.groupBy(F.col("id").alias("forum_id")).agg(F.min("name").alias("_forum"))
    full = named.join(names, "forum_id", "left")
    return full.select("id", "eid", "doi", "title", text.extract_year(F.col("cover_date")).alias("year"), F.coalesce(F.array_join("_names", ","), F.lit("")).alias("authors"), F.coalesce("_forum", F.lit("")).alias("forum"), F.col("cited_by_count").alias("citations"))


def institution(publications: DataFrame, citations: DataFrame, authors: DataFrame, forums: DataFrame, affiliations: list[str]) -> tuple[DataFrame, DataFrame]:
    """K9: the publications (id, eid, doi, title, cover_date, author_ids, forum_id, cited_by_count,
    affiliation_ids) of an institution's affiliations, and all that cite them (citations: cited, citing)."""
    own = publications.where(F.arrays_overlap("affiliation_ids", F.array(*(F.lit(a) for a in affiliations))))
    pairs = own.select(F.col("id").alias("cited")).join(citations.select("cited", "citing").distinct(), "cited")
    citing = publications.join(pairs.select(F.col("citing").alias("id")).distinct(), "id", "left_semi")
    heads = own.select(F.col("id").alias("cited"), *(F.col(c).alias(f"cited_{c}") for c in ("eid", "doi", "title")))
    lines = _lines(citing, authors, forums).withColumnsRenamed({"id": "citing", "eid": "citing_eid", "doi": "citing_doi", "title": "citing_title"})
    out = pairs.join(heads, "cited").join(lines, "citing")
    columns = [*(f"cited_{c}" for c in ("eid", "doi", "title")), *(f"citing_{c}" for c in ("eid", "doi", "title")), "year", "authors", "forum", "citations"]
    return _lines(own, authors, forums).select(*FIELDS), out.select(*columns)


def by_member(df: DataFrame, path: str, *, last: str, first: str, tag: str = "AB") -> None:
    """CSV in a folder for each member, `file=Last_F_AB`. Rows are spread by member before they are
    written, so a member's rows are one file unless AQE splits a member that holds very many."""
    name = F.concat_ws("_", F.col(last), F.substring(F.col(first), 1, 1), F.lit(tag))
    df.withColumn("file", name).hint("rebalance", "file").write.partitionBy("file").mode("overwrite").csv(path, header=True, escape='"')


def snapshots(df: DataFrame, *, key: list[str], payload: list[str], version: Column) -> DataFrame:
    """Rows of an append-only table: key, refresh_version, payload as JSON (nulls kept), its hash."""
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return df.select(*key, version.cast("int").alias("refresh_version"), body.alias("payload")).withColumn("payload_hash", F.sha2("payload", 256))


def latest_snapshots(runs: DataFrame, *, key: list[str], schema: str) -> DataFrame:
    """The last version of each key, its payload read back."""
    last = runs.groupBy(*key).agg(F.max_by("payload", "refresh_version").alias("_p"), F.max("refresh_version").alias("refresh_version"))
    return last.withColumn("_p", F.from_json("_p", schema)).select(*key, "refresh_version", "_p.*")


#: Headers of the sheets, as they are read elsewhere.
PUBLICATION_SHEET = ["Title", "Authors", "Forum", "Volume", "Year", "Workshop", "Category", "Forum Score", "Author Score"]
CITATION_SHEET = ["Cited Title", "Citing Title", *PUBLICATION_SHEET[1:]]


def _sheet(scored: DataFrame, title: Column) -> list[Column]:
    parts = [title, F.col("authors"), F.col("forum"), F.col("volume"), text.extract_year(F.col("cover_date")).cast("string"), F.lit("No"), F.col("category"), F.col("score"), F.col("author_score")]
    return [p.alias(n) for p, n in zip(parts, PUBLICATION_SHEET, strict=True)]


def publication_sheet(publications: DataFrame, scores: DataFrame, authors: DataFrame, forums: DataFrame) -> DataFrame:
    """K7: owner, id and the cells of a publication sheet: publications (owner, id, title, author_ids, forum_id, volume, cover_date) that have a
    score (owner, id, category, score, author_score) and whose forum is known; names of authors in their order, by `, `."""
    named = names_in_order(publications, authors, key="id", ids="author_ids", name_id="id", name="name", out="_names").withColumn("authors", F.array_join("_names", ", "))
    names = forums.groupBy(F.col("id").alias("forum_id")).agg(F.min("name").alias("forum"))
    full = named.join(scores, ["owner", "id"]).join(names, "forum_id")
    return full.select("owner", "id", *_sheet(full, F.col("title")))


def citation_sheet(publications: DataFrame, citations: DataFrame, scores: DataFrame, authors: DataFrame, forums: DataFrame, *, own_authors: DataFrame | None = None) -> DataFrame:
    """K7: owner, cited, citing and the cells of a citation sheet: what cites (citations: owner, cited, citing) an owner's publications and has a score
    (owner, cited, citing, category, score, author_score) and a known forum. own_authors (owner, author_id): citing works with one of these go."""
    pairs = citations.join(scores, ["owner", "cited", "citing"])
    titles = publications.select(F.col("id").alias("cited"), F.col("title").alias("_cited_title"))
    named = names_in_order(publications, authors, key="id", ids="author_ids", name_id="id", name="name", out="_names").withColumn("authors", F.array_join("_names", ", "))
    names = forums.groupBy(F.col("id").alias("forum_id")).agg(F.min("name").alias("forum"))
    full = pairs.join(titles, "cited").join(named.withColumnRenamed("id", "citing"), "citing").join(names, "forum_id")
    if own_authors is not None:
        selves = full.select("owner", "cited", "citing", F.explode("author_ids").alias("author_id")).join(own_authors, ["owner", "author_id"]).select("owner", "cited", "citing")
        full = full.join(selves, ["owner", "cited", "citing"], "left_anti")
    return full.select("owner", "cited", "citing", F.col("_cited_title").alias(CITATION_SHEET[0]), *(c.alias(CITATION_SHEET[1]) if i == 0 else c for i, c in enumerate(_sheet(full, F.col("title")))))


def workbooks_by_member(df: DataFrame, path: str, *, group: str, last: str, first: str, columns: list[str], sheet: str | None = None, order: list[str] = (), tag: str = "AB") -> None:
    """One ZIP for each group with a workbook for each member, Last_F_AB.xlsx."""
    from ..sources import workbooks

    name = F.concat_ws("_", F.col(last), F.substring(F.col(first), 1, 1), F.lit(tag))
    workbooks.write(df, path, file=name, archive=F.col(group), sheet=F.col(sheet) if sheet else None, order=order, columns=columns)
