"""Paged searches: normalised queries, filters that reach the scan, pages in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_year, like_escaped, or_dash, partial_date

MAX_QUERY, MAX_PAGE = 100, 100


def query(q: str | None) -> str | None:
    """Trimmed; None if blank; an error beyond MAX_QUERY characters."""
    q = (q or "").strip()
    if len(q) > MAX_QUERY:
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    return q or None


def contains_any(columns: list[str], q: str) -> Column:
    """Any column contains q, whatever the case; % and _ are plain characters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{like_escaped(q)}%"), F.lit(False))
    return out


def starts_any(columns: list[str], q: str, arrays: list[str] = ()) -> Column:
    """Any column, or any element of an array column, starts with q."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).startswith(q), F.lit(False))
    for c in arrays:
        out = out | F.coalesce(F.exists(c, lambda x: x.startswith(q)), F.lit(False))
    return out


@dataclass
class Page:
    items: DataFrame
    total: int
    page: int
    size: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)


def page(df: DataFrame, *, sort: str, allowed: list[str], tie: str, direction: str = "asc", number: int = 0, size: int = 25, clamp: bool = False, count: bool = True) -> Page:
    """A page by a column of the allowed ones, ties by tie in the same direction. Nulls come
    last in ascending and first in descending order. clamp: a page past the end is the last."""
    if sort not in allowed or direction not in ("asc", "desc"):
        raise ValueError(f"can't sort by {sort} {direction}")
    if number < 0 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"no such page: {number} of {size}")
    total = df.count() if count or clamp else -1
    if clamp:
        number = min(number, max(0, -(-total // size) - 1))
    columns = [F.col(sort), F.col(tie)]
    order = [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first() for c in columns]
    return Page(df.orderBy(*order).offset(number * size).limit(size), total, number, size)


def by_any_id(df: DataFrame, key: str, columns: list[str], newest: str) -> DataFrame:
    """The newest row of which any identifier is key."""
    match = F.lit(False)
    for c in columns:
        match = match | F.coalesce(F.col(c).cast("string") == key, F.lit(False))
    return df.where(match).orderBy(F.col(newest).desc_nulls_last()).limit(1)


def by_first_id(df: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """The row that matches by the first identifier of columns that matches at all."""
    priority = F.coalesce(*(F.when(F.col(c).cast("string") == key, i) for i, c in enumerate(columns)))
    return df.withColumn("_p", priority).where("_p is not null").orderBy("_p", tie).limit(1).drop("_p")


def holding(array: str, value) -> Column:
    """the array holds the value."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def matching(column: str, q: str) -> Column:
    """the column contains q, whatever the case; % and _ of q are wildcards."""
    return F.coalesce(F.col(column).ilike(f"%{q}%"), F.lit(False))


def present(column: str, allowed: list | None = None) -> Column:
    """neither null nor blank and, if asked, one of the allowed values."""
    there = F.coalesce(F.trim(F.col(column).cast("string")) != "", F.lit(False))
    return there if allowed is None else there & F.col(column).isin(allowed)


def facets(*, equal: dict | None = None, contains: dict | None = None, between: tuple | None = None) -> Column:
    """all facets that are given hold: values equal, texts contained (whatever the case, as plain
    characters), a time within (column, from, to), where None is open. Facets of None or blank texts are left out."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        if v is not None and str(v).strip():
            out = out & F.coalesce(F.col(c) == v, F.lit(False))
    for c, q in (contains or {}).items():
        if q and q.strip():
            out = out & contains_any([c], q.strip())
    if between:
        column, low, high = between
        out = out & F.coalesce(F.col(column) >= F.lit(low or "1970-01-01").cast("timestamp"), F.lit(False)) & F.coalesce(F.col(column) <= F.lit(high or "9999-12-31").cast("timestamp"), F.lit(False))
    return out


def by_role(authors: str, mine: Column, role: str) -> Column:
    """MAIN: the first author is one of mine; CO: it is not; anything else: all rows."""
    main = F.coalesce(F.array_contains(mine, F.get(authors, F.lit(0))), F.lit(False))
    return {"MAIN": main, "CO": ~main}.get(role, F.lit(True))


def in_years(date: str, start: int | None = None, end: int | None = None) -> Column:
    """F16: the year that a date's text begins with is within start and end, where given; without a year: not."""
    year = extract_year(F.col(date))
    out = year.isNotNull()
    out = out & (year >= start) if start is not None else out
    return out & (year <= end) if end is not None else out


def index_status(kind: str, found: Column) -> Column:
    """indexed or not_indexed for journals, not_applicable for all other forums."""
    return F.when(F.lower(F.coalesce(F.col(kind), F.lit(""))) != "journal", "not_applicable").when(F.coalesce(found, F.lit(False)), "indexed").otherwise("not_indexed")


def allowed_source(metric: Column, source: Column, official: str) -> Column:
    """impact factors count from the official extract alone, other metrics from any source."""
    return F.coalesce(metric != "IF", F.lit(True)) | F.coalesce(source == official, F.lit(False))


def category_label(category: str, edition: str) -> Column:
    """F24"""
    return F.concat_ws(" - ", category, edition)


def snapshot(df: DataFrame, *, key: list[str], year: str, fixed: int | None = None) -> DataFrame:
    """each key's row of its latest year, or of a fixed one."""
    if fixed is not None:
        return df.where(F.col(year) == fixed)
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(year, *(c for c in rest if c != year))).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def publication_order(date: str, title: str, key: str) -> list[Column]:
    """The newest first and dates that can't be read last, then titles whatever their case, then ids."""
    return [partial_date(F.col(date)).desc_nulls_last(), F.lower(F.coalesce(title, F.lit(""))).asc(), F.coalesce(F.col(key).cast("string"), F.lit("")).asc()]


def name_order(name: str, key: str) -> list[Column]:
    """Names whatever their case, a dash for none, then ids."""
    return [F.lower(or_dash(F.col(name))).asc(), F.col(key).asc()]


def replay_order(*columns: str) -> list[Column]:
    """Events as they are replayed: every column, numbers too, as text."""
    return [F.col(c).cast("string").asc_nulls_first() for c in columns]


def after_key(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """The n rows that follow the last key read."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(n)


def drained(df: DataFrame, *, oldest: str, tie: str, n: int = 1000) -> DataFrame:
    """The n oldest rows, which a queue hands out at once."""
    return df.orderBy(F.col(oldest).asc_nulls_first(), tie).limit(n)


def patched(base: DataFrame, patches: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """Base with what patches (one row a key) say instead, where they say anything."""
    over = patches.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(over, F.col(key) == F.col("_k"), "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in base.columns))
