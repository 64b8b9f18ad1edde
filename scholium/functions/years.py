"""Year ranges like `*`, `IY`, `IY-2->IY` or `2019,2021->2023`, where IY is an item's year."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR = 1990


def _bound(token: str, year: Column) -> Column:
    m = re.fullmatch(r"(?:IY\s*([+-]\s*\d+)?|(\d{4}))", token.strip())
    if not m:
        raise ValueError(f"not a year: {token!r}")
    return F.lit(int(m[2])) if m[2] else year + int((m[1] or "0").replace(" ", ""))


def years(text: str, year: Column, this_year: int) -> Column:
    """The years of a range for each row's year: sorted, each once; null for a null year that is needed."""
    parts = []
    for part in text.split(","):
        if part.strip() == "*":
            parts.append(F.sequence(F.lit(FIRST_YEAR), F.lit(this_year)))
        else:
            low, _, high = part.partition("->")
            a, b = _bound(low, year), _bound(high or low, year)
            parts.append(F.when(a.isNull() | b.isNull(), F.lit(None)).when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def allowed_years(text: str, year: Column, this_year: int, last: int = 2023) -> Column:
    """As years, with the last year that has data appended if none is left or all lie after it."""
    out = years(text, year, this_year)
    return F.when((F.size(out) == 0) | (F.array_min(out) > last), F.array_append(out, F.lit(last))).otherwise(out)
