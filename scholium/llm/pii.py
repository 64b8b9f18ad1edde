"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Generators with high recall propose spans, which may overlap: the four base patterns,
looser forms of e-mail addresses and telephone numbers, and secrets: long runs that mix letters and digits. Base spans (a base pattern's match
that passes its check) are always selected. They also stand in for what no check decides:
features are masked (an address counts as if written plainly, a telephone number without
its plus and its number of digits, a secret without its digits and what stands next to it), so a checked span looks like a loose one in the same
place. Right are base spans and candidates that overlap one of their kind, and secrets of many different
characters to which a name like token or password is given; wrong are candidates that
fail their kind's check or are part of a base span of another kind; all others, which are
those that may be added, teach nothing and are judged by the trees. Each kind has a
threshold: the least score at which the labelled candidates of that kind in the other half
of the documents, chosen by hash, are right as often as ``precision`` asks; without
any right ones there, the kind adds nothing. All work on texts is SQL expressions, row by row,
without a shuffle; what is learned from is a table of at most 3,240 counted cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._boost import BoostedTrees
from ._store import narrowed, written

KINDS = ["email", "ip", "card", "phone", "secret"]
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns. Quantifiers are possessive where nothing after them could match what they
#: give back, and a match starts where a run of its first characters does (or the last match
#: ended): the same matches, in linear time and constant stack.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: spelt-out or spaced e-mail addresses, numbers in groups without a country code.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}{{1,64}}+\x20?(?:@|\(at\)|\[at\])\x20?{_LABEL}{{1,63}}+(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\])\x20?){_LABEL}{{1,63}}+){{1,8}}+",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,4}+(?![0-9])",
}
#: A run of 16 to 256 characters of the usual encodings, with a letter and a digit.
_CODE = "[A-Za-z0-9+/_-]"
LOOSE["secret"] = rf"(?<![A-Za-z0-9+/_=-])(?={_CODE}{{16}})(?={_CODE}*?[0-9])(?={_CODE}*?[A-Za-z]){_CODE}{{16,256}}+={{0,2}}+(?![A-Za-z0-9+/_=-])"
#: What is said before a secret: its name, and a sign that it is given.
_NAMED = r"""(?i)(?:(?:token|secret|passw(?:or)?d|passphrase|pwd|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credentials?|authorization)["'\x20]{0,2}(?:[:=]|is\x20)[\x20\x09:="']{0,4}(?:(?:bearer|basic)\x20)?|bearer\x20)$"""
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CUES = r"(?i)(?:mail|contact|reach|write|call|phone|tel|fax|mobile|card|visa|account|pay|ip|host|server|address)\W{0,3}(?:\w+\W{1,2})?$"
_FEATURES = ["kind", "digits", "gaps", "before", "cue", "length"]
_DATE = r"^(?:(?:19|20)[0-9]{2}([\x20.-])(?:0[1-9]|1[0-2])\1|(?:0[1-9]|[12][0-9]|3[01])([\x20.-])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})"
_BLOCK, _CHUNK = 64, 4096


def _indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body (or a lambda in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element, merge over all before it (0 at first), by way of blocks of 64."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: merge(a, x))

    def within(v: Column) -> Column:
        blocks = F.transform(_indexes(F.ceil(F.size(v) / _BLOCK).cast("int")), lambda k: fold(F.slice(v, k * _BLOCK + 1, _BLOCK)))
        bases = _let(blocks, lambda b: F.transform(_indexes(F.size(b)), lambda k: fold(F.slice(b, F.lit(1), k))))
        return _let(bases, lambda base: F.transform(_indexes(F.size(v)), lambda i: merge(F.get(base, F.floor(i / _BLOCK).cast("int")), fold(F.slice(v, i - i % _BLOCK + 1, i % _BLOCK)))))

    return _let(values, within)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _passes(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), F.call_function("luhn_check", _digits(hit))).otherwise(False)
    return n.between(10, 15)


def _fails(kind: str, hit: Column) -> Column:
    """Whether a match of a loose form can't be of its kind: what no telephone number has for digits,
    or a date; an address whose last label isn't letters; a secret that is short or of few different characters (one without a name can't be told from an id, so it fails too)."""
    if kind == "secret":
        return (F.length(hit) < 20) | ~_varied(hit)
    if kind == "email":
        return ~_plain(kind, hit).rlike(r"\.[A-Za-z]{2,24}$")
    return ~F.length(_digits(hit)).between(10, 15) | hit.rlike(_DATE)


def _varied(hit: Column) -> Column:
    """Whether a run has as many different characters as a random one of its length has at least."""
    return F.size(F.array_distinct(F.split(hit, ""))) >= F.least(F.length(hit) / 3, F.lit(10))


def _plain(kind: str, hit: Column) -> Column:
    """The match as a checked one would look without its mark."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", "."), r"\x20", "")
    return F.regexp_replace(hit, r"^\+", "") if kind == "phone" else hit


def _bin(x: Column, *tops: int) -> Column:
    out = F.lit(len(tops))
    for i, top in reversed(list(enumerate(tops))):
        out = F.when(x <= top, i).otherwise(out)
    return out


def _found(text: Column, kind: str, pattern: str, base: bool, gate: Column) -> Column:
    """All matches of a pattern: leftmost, not overlapping, with their bins. Starts come
    from the lengths of what lies between matches, so they count code points."""
    whole = rf"(?s)\G(.*?)({pattern})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("hit"))
    number = KINDS.index(kind)

    def span(p: Column, before: Column) -> Column:
        gap, hit = p["gap"], p["hit"]
        start = before + F.length(gap)
        last, plain = F.right(gap, F.lit(1)), _plain(kind, hit)
        bins = {
            "kind": F.lit(number), "digits": F.lit(0) if kind in ("phone", "secret") else _bin(F.length(_digits(plain)), 0, 6, 9, 13, 16), "gaps": F.lit(0) if kind == "secret" else _bin(F.length(F.regexp_replace(plain, r"[^\x20().-]", "")), 0, 2),
            "before": F.lit(0) if kind == "secret" else F.when(F.length(last) == 0, 0).when(last.rlike(r"[\s]"), 0).when(last.rlike("[A-Za-z0-9]"), 1).otherwise(2),
            "cue": F.when(F.right(gap, F.lit(32)).rlike(_NAMED if kind == "secret" else _CUES), 1).otherwise(0), "length": _bin(F.length(plain), 12, 20),
        }
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(hit)).alias("end"), (_passes(kind, hit) if base else F.lit(False)).alias("base"), (~_passes(kind, hit) if base else _fails(kind, hit) | (bins["cue"] == F.lit(0)) if kind == "secret" else _fails(kind, hit)).alias("wrong"), F.struct(*(bins[f].alias(f) for f in _FEATURES)).alias("bins"))

    def placed(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("long"))
        return F.zip_with(ps, _prefix(lengths, lambda a, b: a + b), span)

    spans = _let(pairs, placed)
    return F.when(gate, spans).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean,wrong:boolean,bins:struct<kind:int,digits:int,gaps:int,before:int,cue:int,length:int>>>"))


def _kept_apart(s: Column, apart: bool) -> tuple[Column, Column]:
    """A span's ends; if apart, spans of different kinds lie nowhere near each other."""
    shift = s["kind"].cast("long") * (1 << 40) if apart else F.lit(0).cast("long")
    return s["start"] + shift, s["end"] + shift


def _overlapping(more: str, base: str, apart: bool = False) -> Column:
    """For each span of more, whether it overlaps one of base (of its kind, if apart): with the spans
    of both in order, the furthest end before it or the nearest start after it tells."""
    far = 1 << 50

    def marked(a: str, is_base: bool) -> Column:
        return F.transform(a, lambda s, i: F.struct(_kept_apart(s, apart)[0].alias("start"), F.lit(is_base).alias("base"), i.alias("i"), _kept_apart(s, apart)[1].alias("end")))

    def told(every: Column) -> Column:
        past = _prefix(F.transform(every, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(_prefix(F.transform(F.reverse(every), lambda s: F.when(s["base"], far - s["start"]).otherwise(0)), F.greatest))
        near = F.zip_with(F.arrays_zip(every.alias("s"), past.alias("past")), ahead, lambda x, after: F.struct(x["s"]["i"].alias("i"), x["s"]["base"].alias("base"), ((x["past"] > x["s"]["start"]) | (far - after < x["s"]["end"])).alias("hit")))
        return F.transform(F.array_sort(F.filter(near, lambda x: ~x["base"])), lambda x: x["hit"])

    every = _let(F.array_sort(F.concat(marked(more, False), marked(base, True))), told)
    return F.when((F.size(more) > 0) & (F.size(base) > 0), every).otherwise(F.array_repeat(F.lit(False), F.size(more)))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_base (spans that pass) and pii_more (all others that were proposed), by start."""
    t = F.col(text)
    number, at = t.rlike("[0-9]"), t.contains("@")
    gates = {"email": at, "ip": number, "card": number, "phone": number & t.contains("+")}
    every = [_found(t, k, p, True, gates[k]) for k, p in BASE.items()]
    code = t.rlike(LOOSE["secret"])
    every += [_found(t, "secret", LOOSE["secret"], False, code), _found(t, "email", LOOSE["email"], False, at | t.contains("(at)") | t.contains("[at]")), _found(t, "phone", LOOSE["phone"], False, number)]
    out = docs.withColumn("pii_all", F.concat(*every))
    base = F.array_sort(F.filter("pii_all", lambda s: s["base"]))
    more = F.array_sort(F.filter("pii_all", lambda s: ~s["base"]))
    return out.withColumn("pii_base", base).withColumn("pii_more", more).drop("pii_all")


def fitted(found: DataFrame, key: Column, precision: float) -> tuple[BoostedTrees, list[float]]:
    """Trees from the counted cells of found, and a threshold for each kind. Candidates that no
    base span and no check decides aren't counted: they are what is judged."""

    def label(s: Column, same: Column, any_base: Column) -> Column:
        secret = s["kind"] == KINDS.index("secret")
        return F.when(same, True).when(any_base | (s["wrong"] & ~secret), False).when(secret & ~s["wrong"], True)

    stands = F.transform("pii_base", lambda s: F.struct(s["bins"].alias("bins"), F.lit(True).alias("right")))
    flags = F.arrays_zip(_overlapping("pii_more", "pii_base", apart=True).alias("same"), F.col("pii_overlaps").alias("any"))
    near = F.filter(F.zip_with("pii_more", flags, lambda s, f: F.struct(s["bins"].alias("bins"), label(s, f["same"], f["any"]).alias("right"))), lambda s: s["right"].isNotNull())
    rows = found.where(F.size("pii_base") + F.size("pii_more") > 0).select(F.pmod(F.xxhash64(key), F.lit(2)).alias("half"), F.explode(F.concat(stands, near)).alias("s"))
    cells = rows.groupBy("half", "s.bins").agg(F.sum(F.col("s.right").cast("long")).alias("right"), F.count("*").alias("n")).collect()
    x = np.array([[r["bins"][f] for f in _FEATURES] for r in cells], int).reshape(-1, len(_FEATURES))
    right, n, half = (np.array([r[c] for r in cells], float) for c in ("right", "n", "half"))
    trees = BoostedTrees(_FEATURES).fit(x[half == 0], right[half == 0], n[half == 0])
    score, thresholds = trees.score(x), []
    for kind in range(len(KINDS)):
        test, threshold = (half == 1) & (x[:, 0] == kind), 2.0
        for s in np.unique(score[test])[::-1]:
            held = test & (score >= s)
            if right[held].sum() >= precision * n[held].sum():
                threshold = float(s) - 1e-12
        thresholds.append(threshold)
    return trees, thresholds


def spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", precision: float = 0.99, keep_text: bool = True) -> DataFrame:
    """docs with pii_base and pii_spans: arrays of (start, kind, end), sorted; kind counts in KINDS,
    offsets are code points, ends exclusive. pii_spans holds pii_base and what the trees add
    (candidates that overlap no base span and don't fail their kind's check). docs with their candidates are written once,
    without the texts if keep_text is false.

    Null and empty texts have none; rows that repeat are judged one by one; an empty table
    gives an empty one; columns of these names are replaced, all others are kept. A very long text is one row
    of one task; its spans cost their number times 64 and a 4,096th of its square."""
    found = candidates(docs.drop("pii_base", "pii_more", "pii_all", "pii_spans", "pii_overlaps"), text)
    found = found.withColumn("pii_overlaps", _overlapping("pii_more", "pii_base"))
    found = written(found if keep_text else found.drop(text), "pii-candidates")
    trees, thresholds = fitted(found, F.col(doc_id), precision)
    least = F.array(*map(F.lit, thresholds))
    free = F.filter(F.zip_with("pii_more", "pii_overlaps", lambda s, near: F.when(~near & ~s["wrong"], s)), lambda s: s.isNotNull())
    chosen = F.filter(free, lambda s: trees.column(s["bins"]) >= F.get(least, s["kind"]))

    def bare(a: Column) -> Column:
        return F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    added = F.when(F.size("pii_more") > 0, bare(chosen)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    out = found.withColumn("pii_spans", F.array_sort(F.array_distinct(F.concat(bare(F.col("pii_base")), added))))
    return out.withColumn("pii_base", bare(F.col("pii_base"))).drop("pii_more", "pii_overlaps")


def redacted(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with every span of personal data replaced by its kind, like [EMAIL]; spans that
    overlap are one. The columns are those of docs; nothing else of a text changes."""
    t = F.col(text)
    narrow, restored = narrowed(docs, doc_id, text)
    marked = spans(narrow, text=text, doc_id=doc_id, **options)
    chunks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    some = marked.withColumn("pii_chunks", F.when(F.size("pii_spans") > 0, chunks)).withColumn("pii_ends", F.transform("pii_spans", lambda s: s["end"])).withColumn("pii_past", _prefix(F.col("pii_ends"), F.greatest))

    def cut(a: Column, b: Column) -> Column:
        """Code points a to b of the text, by way of chunks: a cut costs its length and two chunks."""
        i, j = F.floor(a / _CHUNK).cast("int"), F.floor(b / _CHUNK).cast("int")
        first, last = F.coalesce(F.get("pii_chunks", i), F.lit("")), F.coalesce(F.get("pii_chunks", j), F.lit(""))
        apart = F.concat(F.substring(first, (a % _CHUNK + 1).cast("int"), F.lit(_CHUNK)), F.array_join(F.slice("pii_chunks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), (b % _CHUNK).cast("int")))
        return F.when(i == j, F.substring(first, (a % _CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(apart)

    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    parts = F.zip_with("pii_spans", "pii_past", lambda s, past: F.when(s["start"] >= past, F.concat(cut(past, s["start"]), F.get(tags, s["kind"]))).otherwise(""))
    clean = F.concat(F.array_join(parts, ""), cut(F.array_max("pii_ends"), F.length(t).cast("long")))
    return restored(some.withColumn(text, F.when(F.size("pii_spans") > 0, clean).otherwise(t)))


def _listed(a: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: the personal data in every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs)


def digest(docs: DataFrame, **options) -> DataFrame:
    found = spans(docs, keep_text=False, **options)

    def number(k: int) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long")

    counts = [number(KINDS.index(kind)).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed("pii_base"), 256).alias("base_sha256"), _listed("pii_spans").alias("spans"))
