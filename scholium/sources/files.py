"""Delimited and JSON files as ledger events and typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ranking import top


def year_of(path: Column) -> Column:
    """The year in a file's name, or null."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def metric_events(cells: DataFrame) -> DataFrame:
    """Ledger events of workbook rows (path, row_item, cells) whose file is AIS_yyyy or RIS_yyyy:
    the payload is JSON of metricType, year and cells c0, c1, ..."""
    name = F.element_at(F.split("path", "/"), -1)
    named = F.map_from_entries(F.transform("cells", lambda x, i: F.struct(F.concat(F.lit("c"), i.cast("string")), F.coalesce(x, F.lit("")))))
    payload = F.to_json(F.struct(F.regexp_extract(name, "^(AIS|RIS)_", 1).alias("metricType"), year_of(F.col("path")).alias("year"), named.alias("cells")))
    good = cells.where("error is null").where(name.rlike("^(AIS|RIS)_[0-9]{4}"))
    return good.select(F.lit("GOV").alias("source_type"), name.alias("source_file"), F.concat(F.lit("v"), year_of(F.col("path")).cast("string")).alias("source_version"), F.col("row_item").cast("string").alias("source_row_item"), payload.alias("payload")).withColumn("checksum", F.sha2("payload", 256))


#: The cells that hold ISSNs, by metric and years.
ISSN_CELLS = [("AIS", 2020, 2023, [1, 2]), ("AIS", 2014, 2017, [2]), ("AIS", 0, 9999, [1]), ("RIS", 2020, 9999, [1, 2]), ("RIS", 0, 9999, [1])]


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def with_valid_issns(cells: DataFrame) -> DataFrame:
    """workbook rows (path, row_item, cells) without those whose ISSN cells are filled but none of
    them valid; in the others, invalid ones are blank. Rows without any, and files of no known metric, stay."""
    name = F.element_at(F.split("path", "/"), -1)
    kind, year = F.regexp_extract(name, "^(AIS|RIS)_", 1), year_of(F.col("path"))
    places = F.array().cast("array<int>")
    for metric, first, last, held in reversed(ISSN_CELLS):
        places = F.when((kind == metric) & year.between(first, last), F.array(*map(F.lit, held))).otherwise(places)
    at = cells.withColumn("_at", places)
    wrong = lambda x: _filled(x) & text.issn_token(x).isNull()
    numbers = F.transform("_at", lambda i: F.get("cells", i))
    good = at.where(~F.exists(numbers, _filled) | F.exists(numbers, lambda x: text.issn_token(x).isNotNull()) | F.col("cells").isNull())
    blank = F.transform("cells", lambda x, i: F.when(F.array_contains("_at", i) & wrong(x), "").otherwise(x))
    return good.withColumn("cells", blank).drop("_at")


def with_valid_identity(items: DataFrame, payload: str = "payload") -> DataFrame:
    """F22 for JSON objects with issn and eissn (or eIssn): likewise; invalid ones are null, as are both
    spellings of the second. What is no object stays as it is."""
    read = items.withColumn("_m", F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "map<string,variant>"))
    said = lambda k: F.get_json_object(payload, f"$.{k}")
    print_, online = said("issn"), F.when(_filled(said("eissn")), said("eissn")).otherwise(said("eIssn"))
    bad = {"issn": text.issn_token(print_).isNull(), "eissn": text.issn_token(online).isNull(), "eIssn": text.issn_token(online).isNull()}
    any_, valid = _filled(print_) | _filled(online), ~bad["issn"] | ~bad["eissn"]
    out = F.transform_values("_m", lambda k, v: F.when(((k == "issn") & bad["issn"]) | (k.isin("eissn", "eIssn") & bad["eissn"]), F.lit(None)).otherwise(v))
    return read.where(F.col("_m").isNull() | ~any_ | valid).withColumn(payload, F.when(F.col("_m").isNull(), F.col(payload)).otherwise(F.to_json(out))).drop("_m")


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_item, payload) of files that are JSON arrays; a file that is none has one row with a null payload."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    items = F.variant_get(F.try_parse_json("value"), "$", "array<variant>")
    return files.select("path", F.posexplode_outer(items).alias("row_item", "item")).select("path", "row_item", F.to_json("item").alias("payload"))


def columnar(df: DataFrame, json: str, fields: list[str]) -> DataFrame:
    """Rows of `{field: {index: value}}`: index and a column for each field, null where it lacks the index."""
    maps = F.from_json(F.col(json), ", ".join(f"`{f}` map<string,string>" for f in fields))
    named = df.select(maps.alias("m"))
    keys = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.map_keys(F.col(f"m.{f}")), F.array().cast("array<string>")) for f in fields))))
    return named.select("m", F.explode(keys).alias("index")).select(F.col("index"), *(F.col(f"m.{f}")[F.col("index")].alias(f) for f in fields))


#: Levels of artistic events.
EVENT_RANKS = {"1": "INTERNATIONAL_TOP", "2": "INTERNATIONAL", "3": "NATIONAL"}


def artistic_events(spark: SparkSession, path: str, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (domain, name, rank) of files `{"events": [...]}`, and the domains that domains (name)
    lacks. Events of unknown level go, their domains stay."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "events array<struct<domain:string,name:string,level:string>>").alias("x"))
    events = whole.select(F.inline("x.events"))
    levels = F.create_map(*(F.lit(v) for pair in EVENT_RANKS.items() for v in pair))
    ranked = events.withColumn("rank", levels[F.col("level")]).where("rank is not null").drop("level")
    new = events.select(F.col("domain").alias("name")).where("name is not null").distinct().join(domains.select("name"), "name", "left_anti")
    return ranked, new


def citing_articles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columnar files `{"eid": {i: eid}, "citing articles": {i: [article, ...]}}` as events of citing
    publications (record, payload), of citations (record, cited_eid, citing_eid), and the articles
    without an eid (cited_eid, payload). A number in place of a list is no citations; each record once."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "eid map<string,string>, `citing articles` map<string,string>").alias("x"))
    rows = whole.select("x.eid", F.explode("x.citing articles").alias("i", "list"))
    each = rows.select(text.blank_to_null(F.col("eid")[F.col("i")]).alias("cited_eid"), F.explode(F.from_json("list", "array<string>")).alias("payload")).where("cited_eid is not null")
    named = each.withColumn("citing_eid", text.blank_to_null(F.get_json_object("payload", "$.eid")))
    good = named.where("citing_eid is not null")
    publications = good.groupBy(F.col("citing_eid").alias("record")).agg(F.min("payload").alias("payload"))
    citations = good.select(F.concat("cited_eid", F.lit("->"), "citing_eid").alias("record"), "cited_eid", "citing_eid").distinct()
    return publications, citations, named.where("citing_eid is null").select("cited_eid", "payload")


def with_layout(df: DataFrame, layouts: DataFrame, *, cells: str, keys: list[str]) -> DataFrame:
    """Typed fields of positional cells. layouts: keys, year_from, year_to, field, position; a row of
    df (with keys and year) takes the layout of its keys and year. Up to 10,000 layout rows are
    broadcast, more are joined by their keys; no ladder of conditions."""
    few = layouts.limit(10_001).count() <= 10_000
    maps = layouts.groupBy(*keys, "year_from", "year_to").agg(F.map_from_entries(F.collect_list(F.struct("field", "position"))).alias("_layout"))
    on = [df[k] == maps[k] for k in keys] + [df["year"] >= maps["year_from"], df["year"] <= maps["year_to"]]
    joined = df.join(F.broadcast(maps) if few else maps, on)
    values = F.transform_values("_layout", lambda _, p: F.get(F.col(cells), p))
    return joined.select(*(df[c] for c in df.columns), values.alias("fields"))


def delimited(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones as text: bad rows never end a run."""
    df = spark.read.schema(f"{schema}, _bad string").csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=False).withColumn("source_file", F.col("_metadata.file_name"))
    return df.where("_bad is null").drop("_bad"), df.where("_bad is not null").select("source_file", "_bad")


EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def roster(spark: SparkSession, path: str, required: int = 5) -> DataFrame:
    """group, email, last_name, first_name, position, ids of a member list; all or nothing: any bad row is an error that names the first few."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, 'group,')").select(F.split("value", ",", -1).alias("c"), "value")
    col = lambda i: text.jtrim(F.get("c", F.lit(i)))
    problem = F.when(F.size("c") < required, "too few columns").when(F.exists(F.slice("c", 1, required), lambda x: text.jtrim(x) == ""), "a required field is blank").when(~col(1).rlike(EMAIL), "not an e-mail address")
    bad = lines.withColumn("problem", problem).where("problem is not null").select("value", "problem").take(5)
    if bad:
        raise ValueError("; ".join(f"{r.problem}: {r.value}" for r in bad))
    return lines.select(*(col(i).alias(n) for i, n in enumerate(["group", "email", "last_name", "first_name", "position"])), text.split_trimmed(F.get("c", F.lit(5)), ";", distinct=True).alias("ids"))


def exported(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with all fields quoted where they must be; arrays joined by '; '. As many files as partitions."""
    kinds = dict(df.dtypes)
    df.select(*(F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns)).write.mode("overwrite").csv(path, header=True, escape='"')


def preview(rows: DataFrame, *, file: str, row: str, error: str, samples: int = 20) -> DataFrame:
    """For each file how many rows an import plans, how many it can't read, and the first samples; nothing is written."""
    first = top(rows.select(file, row), group=[file], order=[F.asc(row)], n=samples)
    shown = first.groupBy(file).agg(F.array_sort(F.collect_list(row)).alias("samples"))
    return rows.groupBy(file).agg(F.count("*").alias("planned"), F.count(error).alias("errors")).join(shown, file)
