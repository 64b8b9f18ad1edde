"""Normalisers and parsers of text columns, as Spark expressions. Null in gives null out unless a function says otherwise."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get what they run by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EM_DASH = "—"
#: The smallest metric value that counts as given, points of ranks and their categories.
NO_VALUE = -999.0
CATEGORY_OF_POINTS = {12.0: "A*", 8.0: "A", 4.0: "B", 2.0: "C", 1.0: "D"}
EDITIONS = ["SSCI", "SCIE", "AHCI", "ESCI"]


def jtrim(c: Column) -> Column:
    """Without characters up to U+0020 at either end (trim() strips spaces only)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(jtrim(c), F.lit(""))


def token(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def extract_year(c: Column) -> Column:
    """The first four characters (or fewer) as a year, if all are digits."""
    head = F.substring(jtrim(c), 1, 4)
    return F.when(head.rlike("^[0-9]+$"), head.cast("int"))


def normalize_text(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(jtrim(c)), r"\s+", " "), F.lit(""))


def issn_norm(c: Column) -> Column:
    return F.regexp_replace(F.upper(jtrim(c)), "[- ]", "")


def issn_token(c: Column) -> Column:
    """An ISSN of seven digits and a digit or X, else null."""
    return F.when(issn_norm(c).rlike("^[0-9]{7}[0-9X]$"), issn_norm(c))


def issn_display(c: Column) -> Column:
    x = jtrim(c)
    return F.when((F.length(x) == 8) & ~x.contains("-"), F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 5, 4))).otherwise(x)


def issn_candidates(*columns: Column) -> Column:
    """All ISSNs within some texts, in order, each once."""
    found = F.regexp_extract_all(F.upper(F.concat_ws(" ", *columns)), F.lit(r"(?<![0-9A-Z])([0-9]{4}-?[0-9]{3}[0-9X])(?![0-9A-Z])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "-", "")))


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")))


def fingerprint(c: Column) -> Column:
    """Lower-cased, without accents, all but ASCII letters and digits as single spaces. Texts
    of ASCII alone never leave the JVM."""
    low = F.lower(c)
    plain = F.when(low.rlike(r"[^\x00-\x7F]"), _decomposed(F.when(low.rlike(r"[^\x00-\x7F]"), low))).otherwise(low)
    return F.nullif(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), F.lit(""))


def normalize_doi(c: Column) -> Column:
    return F.nullif(F.lower(jtrim(F.regexp_replace(jtrim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))), F.lit(""))


def short_hash(c: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def canonical_id(prefix: str, *materials: Column) -> Column:
    """A stable id from the first material that is not blank."""
    return F.concat(F.lit(prefix), short_hash(F.coalesce(*(blank_to_null(m) for m in materials))))


def identity_key(tokens: Column, title: Column) -> Column:
    """One key for a set of ISSN tokens; without any, for the title."""
    given = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull())))
    return F.when(F.size(given) > 0, F.sha2(F.concat(F.lit("issn:"), F.array_join(given, "|")), 256)).otherwise(F.sha2(F.concat(F.lit("title:"), F.coalesce(title, F.lit(""))), 256))


def edition_candidates(c: Column) -> Column:
    """The citation indexes that a text names; OTHER if none, UNKNOWN if blank."""
    x = F.upper(jtrim(c))
    rest = F.regexp_replace(x, "SOCIAL SCIENCES?", " ")
    marks = {
        "SSCI": x.rlike("SSCI|SOCIAL SCIENCE"), "SCIE": rest.rlike("SCIE"), "AHCI": x.rlike("AHCI|ARTS"), "ESCI": x.rlike("ESCI|EMERGING"),
    }
    found = F.filter(F.array(*(F.when(marks[e], e) for e in EDITIONS)), lambda e: e.isNotNull())
    return F.when(F.coalesce(x, F.lit("")) == "", F.array(F.lit("UNKNOWN"))).when(F.size(found) > 0, found).otherwise(F.array(F.lit("OTHER")))


def category_name(c: Column) -> Column:
    """What stands before the last '-'; all without one; '' for blank."""
    return F.when(c.contains("-"), jtrim(F.regexp_extract(c, r"(?s)^(.*)-[^-]*$", 1))).otherwise(F.coalesce(jtrim(c), F.lit("")))


def category_index(c: Column) -> Column:
    return F.when(c.contains("-"), jtrim(F.substring_index(c, "-", -1))).otherwise(F.lit(""))


def first_dash_index(c: Column) -> Column:
    """What follows the first '-', else all."""
    return F.when(c.contains("-"), jtrim(F.regexp_extract(c, r"(?s)^[^-]*-(.*)$", 1))).otherwise(jtrim(c))


def metric_value(c: Column) -> Column:
    x = F.regexp_replace(jtrim(c), ",", ".").try_cast("double")
    return F.when(x > NO_VALUE, x)


def lenient_int(c: Column) -> Column:
    return F.coalesce(jtrim(c).try_cast("int"), jtrim(c).try_cast("double").cast("int"))


def quarter(c: Column) -> Column:
    """1, 1.0 and Q1 alike as Q1; anything else upper-cased."""
    x = F.upper(jtrim(c))
    n = F.regexp_extract(x, r"^Q?([1-4])(\.0+)?$", 1)
    return F.when(n != "", F.concat(F.lit("Q"), n)).otherwise(F.nullif(x, F.lit("")))


def known_quarter(c: Column) -> Column:
    return F.when(quarter(c).isin("Q1", "Q2", "Q3", "Q4"), quarter(c)).otherwise("NOT_FOUND")


def conference_rank(c: Column) -> Column:
    x = F.upper(jtrim(c))
    return F.when(x.contains("NATIONAL"), "D").when(x == "A*", "A_STAR").when(x.isin("A", "B", "C", "D"), x).otherwise("NON_RANK")


def points_category(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for points, name in CATEGORY_OF_POINTS.items():
        out = F.when(c == points, name).otherwise(out)
    return out


def acronym(c: Column) -> Column:
    """The first word after the last ', '."""
    return F.split(F.element_at(F.split(c, ", "), -1), " ")[0]


def split_trimmed(c: Column, mark: str = ";", distinct: bool = False) -> Column:
    """Parts without blanks around; trailing empty parts go, or all blanks and repeats if distinct."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{mark}\\s]+$", ""), mark), jtrim)
    return F.array_distinct(F.filter(parts, lambda x: x != "")) if distinct else F.when(F.coalesce(jtrim(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def json_text(c: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(c, f"$.{field}"), F.lit(""))


def json_int(c: Column, field: str) -> Column:
    return F.coalesce(lenient_int(F.get_json_object(c, f"$.{field}")), F.lit(0))


def json_bool(c: Column, field: str) -> Column:
    return F.coalesce(F.lower(F.get_json_object(c, f"$.{field}")).isin("1", "true", "yes"), F.lit(False))


def partial_date(c: Column) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd as a date; the first day where parts are missing."""
    x = jtrim(c)
    whole = F.when(x.rlike("^[0-9]{4}$"), F.concat(x, F.lit("-01-01"))).when(x.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(x, F.lit("-01"))).when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), x)
    return whole.try_cast("date")


def locale_double(c: Column) -> Column:
    """1.234,56 and 1,234.56 alike: the last mark is the decimal one."""
    x = F.regexp_replace(jtrim(c), r"\s", "")
    comma_last = F.instr(F.reverse(x), ",") < F.when(F.instr(F.reverse(x), ".") == 0, 1 << 30).otherwise(F.instr(F.reverse(x), "."))
    european = F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")
    return F.when(x.contains(",") & comma_last, european).otherwise(F.regexp_replace(x, ",", "")).try_cast("double")


def joined_key(*columns: Column) -> Column:
    return F.lower(F.array_join(F.array(*(F.coalesce(jtrim(c), F.lit("")) for c in columns)), "|"))


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), "|"), 256)


def forum_type(c: Column) -> Column:
    x = F.lower(F.coalesce(jtrim(c), F.lit("")))
    return F.when(x.contains("journal"), "JOURNAL").when(x.contains("conference") | x.contains("proceeding"), "CONFERENCE").when(x.contains("book"), "BOOK").otherwise("OTHER")


def source_name(c: Column) -> Column:
    x = F.upper(jtrim(c))
    return F.when(x.startswith("SCOPUS"), "SCOPUS").when(x.startswith("WOS") | x.startswith("WEB OF SCIENCE"), "WOS").when(x.isin("GSCHOLAR", "GOOGLE_SCHOLAR", "SCHOLAR"), "GSCHOLAR").when(x.startswith("USER"), "USER_DEFINED").otherwise(x)


def or_dash(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(EM_DASH))


def subtype(first: Column, second: Column) -> Column:
    return F.coalesce(token(first), token(second))


def like_escaped(q: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in q)


#: Beginnings of an academic position and its code, in the order in which they are tried.
POSITIONS = [
    ("Asist. Cerc.", "ASIST_C"), ("Asist.", "ASIST_UNIV"), ("Lect.", "LECT_UNIV"), ("Conf.", "CONF_UNIV"), ("Prof.", "PROF_UNIV"), ("CS I", "CS_I"),
]


def position(c: Column) -> Column:
    """The code of an academic position. CS II and CS III begin with CS I and get its code."""
    return F.coalesce(*(F.when(c.startswith(start), code) for start, code in POSITIONS), F.when(c.isNotNull(), "OTHER"))
