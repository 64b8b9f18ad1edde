"""Scoring strategies: each gives every item its best score among its forum's categories and years.

Facts are long: (journal, year, category, metric, value, quarter, rank). They are reduced to the best
of each journal and year, then to the best of each (journal, year, window) that items ask for, and only then joined
to items: so the join has a row per item, and what it joins to is as many rows as there are journals and years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.formula import compiled
from ..functions.years import allowed_years

#: Points of quarters (in and beyond the top cut), of conference and publisher ranks, of events; multipliers of economics.
QUARTER_POINTS = {"Q1": (12.0, 8.0), "Q2": (8.0, 4.0), "Q3": (4.0, 2.0), "Q4": (2.0, 2.0)}
CONFERENCE_POINTS = {"A_STAR": 12.0, "A": 8.0, "B": 4.0, "C": 2.0}
PUBLISHER_POINTS = {"A": 16.0, "B": 8.0, "C": 4.0}
EVENT_POINTS = {1: 3.0, 2: 2.0, 3: 1.0}
SCORE = "struct<score:double,year:int,category:string,quarter:string>"
LAST_YEAR = 2023


def points(c: Column, table: dict, other: float | None = None) -> Column:
    out = F.lit(other).cast("double")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def eligible(category: Column, domain: list[str] | None) -> Column:
    """The category is of the domain (None: any), in an index that counts."""
    index = F.upper(text.category_index(category))
    listed = F.lit(True) if domain is None else text.category_name(category).isin(domain)
    return listed & (index.contains("SCIE") | index.contains("SSCI"))


def judged(facts: DataFrame, domain: list[str] | None) -> DataFrame:
    """The facts of categories that are of the domain, in an index that counts."""
    return facts.where(eligible(F.col("category"), domain))


def best(items: DataFrame, scored: DataFrame, *, window: str, this_year: int, prefer: list[Column] = (), subtypes: tuple[str, ...] = ("ar", "re")) -> DataFrame:
    """items (item, journal, year, subtype) with score, score_year, category and quarter of the best of scored (journal, year,
    category, score, quarter) in their journal and their window's years: the most score to 8 decimals, then prefer, then the lesser
    quarter, the later year, the greater category. Zero never wins; without any, and for other subtypes: 0 and NOT_FOUND.

    The order is total but for equal rows, so the best of a window is the best of its years' best ones."""
    order = F.struct(F.round("score", 8).alias("o"), *prefer, (-F.coalesce(F.regexp_extract("quarter", "[0-9]", 0).try_cast("int"), F.lit(9))).alias("q"), F.col("year"), F.col("category"))
    each = scored.where("score > 0").groupBy("journal", F.col("year").alias("_at")).agg(F.max(F.struct(order.alias("order"), F.struct("score", "year", "category", "quarter").alias("s"))).alias("_b"))
    asked = items.where(F.col("subtype").isin(*subtypes)).select("journal", "year").distinct()
    years = asked.select("journal", "year", F.explode(allowed_years(window, F.col("year"), this_year, LAST_YEAR)).alias("_at"))
    won = years.join(each, ["journal", "_at"]).groupBy("journal", "year").agg(F.max("_b").alias("_b"))
    joined = items.join(won, ["journal", "year"], "left").withColumn("_s", F.when(F.col("subtype").isin(*subtypes), F.col("_b.s")))
    return joined.select(*(items[c] for c in items.columns), F.coalesce("_s.score", F.lit(0.0)).alias("score"), F.col("_s.year").alias("score_year"), F.col("_s.category").alias("category"), F.coalesce("_s.quarter", F.lit("NOT_FOUND")).alias("quarter"))


def metric(items: DataFrame, facts: DataFrame, name: str, *, quarter_of: str | None = None, window: str = "IY", this_year: int = LAST_YEAR, domain: list[str] | None = None) -> DataFrame:
    """A metric's value; its quarter, or that of another metric in the same category and year (null-safe)."""
    found = judged(facts, domain).groupBy("journal", "year", "category").agg(F.max(F.when(F.col("metric") == name, F.col("value"))).alias("score"), F.min(F.when(F.col("metric") == (quarter_of or name), F.col("quarter"))).alias("quarter"))
    return best(items, found, window=window, this_year=this_year)


def journal_points(items: DataFrame, facts: DataFrame, cuts: DataFrame, *, window: str = "IY", this_year: int = LAST_YEAR, domain: list[str] | None = None) -> DataFrame:
    """Points of a quarter, more for ranks under the cut of (category, year); a journal
    with an eid and no points gets 2. items also has eid; cuts: category, year, cut."""
    every = judged(facts.where("metric = 'AIS'"), domain).join(cuts, ["category", "year"], "left")
    inside = F.coalesce(F.col("rank") < F.coalesce("cut", F.lit(0)), F.lit(False))
    scored = every.withColumn("score", F.when(inside, points(F.col("quarter"), {q: p[0] for q, p in QUARTER_POINTS.items()})).otherwise(points(F.col("quarter"), {q: p[1] for q, p in QUARTER_POINTS.items()})))
    out = best(items, scored, window=window, this_year=this_year)
    fallback = (F.col("score") == 0) & F.col("eid").isNotNull() & F.col("subtype").isin("ar", "re")
    return out.withColumns({"score": F.when(fallback, 2.0).otherwise(F.col("score")), "score_year": F.when(fallback, LAST_YEAR).otherwise(F.col("score_year")), "quarter": F.when(fallback, "SCOPUS").otherwise(F.col("quarter"))}).withColumn("points_category", text.points_category(F.col("score")))


def conference_points(items: DataFrame, ranks: DataFrame) -> DataFrame:
    """Items (item, forum_name, year, subtype) with the points of their conference's rank in the
    nearest year (ranks: acronym, name, year, rank); of several conferences of an acronym, those
    whose name is in the forum's. Lecture notes have 2 whatever the rank; nothing found: 1."""
    from .joins import nearest_year

    keyed = items.withColumn("acronym", text.acronym(F.col("forum_name")))
    names = ranks.select("acronym", "name").distinct()
    many = names.groupBy("acronym").agg(F.count("*").alias("n"))
    pairs = keyed.join(names, "acronym").join(many, "acronym").where((F.col("n") == 1) | F.lower("forum_name").contains(F.lower("name"))).select("item", "name", "year")
    near = nearest_year(pairs, ranks.select("name", F.col("year").alias("rank_year"), "rank"), key=["name"], year="year", right_year="rank_year")
    most = near.where("rank is not null").groupBy("item").agg(F.max(points(F.col("rank"), CONFERENCE_POINTS, 1.0)).alias("p"))
    paper = F.col("subtype") == "cp"
    notes = paper & F.lower("forum_name").contains("lecture notes in ")
    return items.join(most, "item", "left").withColumn("score", F.when(notes, 2.0).when(paper & F.col("p").isNotNull(), F.col("p")).otherwise(1.0)).drop("p")


def publisher_points(items: DataFrame, publishers: DataFrame, *, table: dict = PUBLISHER_POINTS, other: float = 1.0, listed_only: bool = False) -> DataFrame:
    """Items (item, publisher, subtype) with their publisher's points, halved for chapters;
    listed_only: 1 if it is listed at all. Of publishers of one name (any case) the best rank by letter counts."""
    known = publishers.groupBy(F.lower("name").alias("_p")).agg(F.min("ranking").alias("_r"))
    joined = items.join(known, F.lower(items["publisher"]) == known["_p"], "left")
    whole = F.when(F.col("_p").isNotNull(), 1.0).otherwise(0.0) if listed_only else points(F.col("_r"), table, other)
    score = F.when(F.col("subtype") == "bk", whole).when(F.col("subtype") == "ch", whole / 2).otherwise(0.0)
    return joined.withColumn("score", score).drop("_p", "_r")


def economics(items: DataFrame, facts: DataFrame, *, core: list[str], informatics: list[str], window: str = "IY", this_year: int = LAST_YEAR) -> DataFrame:
    """AIS, and of equal ones that with the larger multiplier, which is given as m."""
    every = judged(facts.where("metric = 'AIS'"), None)
    name = text.category_name(F.col("category"))
    every = every.withColumn("m", F.when(name.isin(core), 10).when(name.isin(informatics), 8).otherwise(6)).withColumn("score", F.col("value"))
    out = best(items, every, window=window, this_year=this_year, prefer=[F.col("m")])
    return out.withColumn("m", F.when(F.col("category").isNotNull(), F.when(name.isin(core), 10).when(name.isin(informatics), 8).otherwise(6)))


def classification(items: DataFrame, facts: DataFrame, *, compat: bool = False) -> DataFrame:
    """Flags of each item by quarter and index. items: item, journal, year, subtype, forum_name, indexed (in the citation index).
    compat (Q7): only a journal's first category, by name, is judged in the item's year, all others in the last year."""
    index = F.upper(text.first_dash_index(F.col("category")))
    article, paper, chapter = F.col("subtype").isin("ar", "re"), F.col("subtype") == "cp", F.col("subtype").isin("ch", "bk")
    flagged = {
        **{q.lower(): F.col("quarter").eqNullSafe(q) & (index.contains("SCIE") | index.contains("SSCI")) for q in QUARTER_POINTS},
        "esci": index.contains("ESCI"), "ahci": index.contains("AHCI"), "erih": ~index.contains("ESCI") & ~index.contains("AHCI"),
    }
    ais, due = facts.where("metric = 'AIS'"), F.least("year", F.lit(LAST_YEAR))
    if compat:
        first = ais.groupBy("journal").agg(F.min("category").alias("_first"))
        each = ais.join(first, "journal").groupBy("journal", F.col("year").alias("_at"), (F.col("category") == F.col("_first")).alias("_is_first")).agg(*(F.bool_or(f).alias(k) for k, f in flagged.items()))
        asked = items.where(article).select("journal", due.alias("_due")).distinct().withColumn("_at", F.explode(F.array_distinct(F.array("_due", F.lit(LAST_YEAR)))))
        met = asked.join(each, ["journal", "_at"]).where(F.col("_at") == F.when(F.col("_is_first"), F.col("_due")).otherwise(LAST_YEAR))
        found = met.groupBy("journal", "_due").agg(*(F.bool_or(k).alias(k) for k in flagged))
    else:
        found = ais.groupBy("journal", F.col("year").alias("_due")).agg(*(F.bool_or(f).alias(k) for k, f in flagged.items()))
    flags = ["q1", "q2", "q3", "q4", "esci", "ahci", "erih"]
    name = F.upper(F.coalesce("forum_name", F.lit("")))
    joined = items.withColumn("_due", due).join(found, ["journal", "_due"], "left").select(*(items[c] for c in items.columns), *flags)
    return joined.withColumns({f: F.coalesce(F.col(f) & article, F.lit(False)) for f in flags}).withColumns(
        {"ieee": paper & name.contains("IEEE"), "isi_proceedings": paper & ~name.contains("IEEE") & F.coalesce("indexed", F.lit(False)), "lecture_notes": (chapter | paper) & name.contains("LECTURE NOTES")}
    )


def computer_science(items: DataFrame, facts: DataFrame, cuts: DataFrame, ranks: DataFrame, **options) -> DataFrame:
    """Articles and reviews by their journal (R4), papers by their conference (R5), all else 0."""
    journal = journal_points(items, facts, cuts, **options).select("item", F.col("score").alias("_journal"))
    paper = conference_points(items.where("subtype = 'cp'"), ranks).select("item", F.col("score").alias("_paper"))
    both = items.join(journal, "item", "left").join(paper, "item", "left")
    kind = F.col("subtype")
    return both.withColumn("score", F.coalesce(F.when(kind.isin("ar", "re"), F.col("_journal")).when(kind == "cp", F.col("_paper")), F.lit(0.0))).drop("_journal", "_paper")


def university(items: DataFrame, ranks: DataFrame, *, window: str = "IY", this_year: int = LAST_YEAR) -> DataFrame:
    """Items (item, university, year) with the best rank of its years in order, where a
    missing year starts anew (Q6); ranks: university, year, rank. At most as many rows an item as the window has years."""
    from .folds import best_since_gap

    asked = items.select("item", "university", F.explode(allowed_years(window, F.col("year"), this_year, LAST_YEAR)).alias("year"))
    held = ranks.groupBy("university", "year").agg(F.min("rank").cast("double").alias("rank"))
    found = asked.join(held, ["university", "year"], "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("year", "rank"))).alias("_r"))
    return items.join(found.select("item", best_since_gap(F.col("_r.rank")).alias("score")), "item", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def activities(df: DataFrame, expression: str, fields: list[str], *, values: str = "fields") -> DataFrame:
    """Df with score, a user's formula over the named entries of a map of texts; an entry that is no number counts as 0."""
    named = df.select(F.struct(*df.columns).alias("_row"), *(F.coalesce(text.locale_double(F.col(values)[f]), F.lit(0.0)).alias(f) for f in fields))
    return named.withColumn("score", F.coalesce(compiled(expression, set(fields)), F.lit(0.0))).select("_row.*", "score")


def best_quarter(facts: DataFrame) -> DataFrame:
    """Each journal's best quarter over all years of AIS and IF; NOT_FOUND without any."""
    known = F.when(F.col("quarter").rlike("^Q[1-4]$"), F.col("quarter"))
    return facts.where(F.col("metric").isin("AIS", "IF")).groupBy("journal").agg(F.coalesce(F.min(known), F.lit("NOT_FOUND")).alias("quarter"))


CLASSES = ["q1", "q2", "q3", "q4", "esci", "ahci", "erih", "isi_proceedings", "ieee", "lecture_notes"]


def export_class(df: DataFrame) -> DataFrame:
    """K8: the first flag that holds, as one column; rows without doi and index id go."""
    return df.where(F.coalesce(text.blank_to_null(F.col("doi")), text.blank_to_null(F.col("wos_id"))).isNotNull()).withColumn("class", F.coalesce(*(F.when(F.col(c), c) for c in CLASSES)))
