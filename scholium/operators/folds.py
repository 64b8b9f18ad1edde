"""Ordered folds per key: winners among conflicting facts, states of links, ranks over years.

A key of up to SEGMENT rows is folded as one array. A longer key is cut, in order, into segments of at most so many
rows, which lie in many tasks, and no task ever holds more of its rows than one segment. Link states have transitions that compose:
each segment is reduced to one function of the state before it, and the functions are applied in order.
Winners don't compose, so segments are folded from guessed states, all at once, and those whose guess
proves wrong again, until every segment began with what the one before it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import removed, written

STATES = ["LINKED", "UNMATCHED", "CONFLICT", "SKIPPED"]
SEGMENT = 4096


def _in_order(df: DataFrame, key: list[str], row: Column) -> DataFrame:
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("_rows"))


def _divided(df: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of up to limit rows, and those of longer keys, if there are any. Keys are one column, _k."""
    keyed = df.withColumn("_k", F.struct(*key))
    long = written(keyed.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_k"), "long-keys")
    if long.isEmpty():
        return keyed, None
    return keyed.join(long, "_k", "left_anti"), keyed.join(long, "_k", "left_semi")


def _segments(df: DataFrame, row: Column, limit: int) -> DataFrame:
    """(_k, _seg, _rows): each key's rows in order, in segments of at most limit rows, numbered in order.

    Rows are dealt by ranges of key and row, so a key's segments lie in as many tasks as it fills."""
    dealt = df.select("_k", row.alias("_x")).repartitionByRange("_k", "_x").sortWithinPartitions("_k", "_x")
    numbered = dealt.withColumn("_seg", F.expr(f"monotonically_increasing_id() div {limit}"))
    return numbered.groupBy("_k", "_seg").agg(F.sort_array(F.collect_list("_x")).alias("_rows"))


def _from_first(rows: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold of rows from the first of them on; step takes struct(held, n) and a row."""
    start = F.struct(F.get(rows, F.lit(0)).alias("held"), F.lit(0).alias("n"))
    return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), start, step)


def _chained(long: DataFrame, row: Column, step: Callable[[Column, Column], Column], limit: int) -> DataFrame:
    """(_k, _a) of long keys, _a as _from_first gives it.

    known: what a segment makes of some states before it; at first, of its own first row. Each round walks a key's segments: where
    the state at hand is known, it goes on with what the segment makes of it; else it notes what is to be found out, and
    goes on with the guess that the segment's own winner meets that state. The walk is right up to the first
    unknown state, so each round settles one segment at least, and nearly all if guesses are good."""
    segments = written(_segments(long, row, limit), "fold-segments")
    made = lambda own: [F.col("_out.held").alias("_held"), F.col("_out.n").alias("_dn"), F.lit(own).alias("_own")]
    known = written(segments.select("_k", "_seg", F.get("_rows", F.lit(0)).alias("_in"), _from_first(F.col("_rows"), step).alias("_out")).select("_k", "_seg", "_in", *made(True)), "fold-known")

    def walk(a: Column, s: Column) -> Column:
        hit = F.get(F.filter(s["entries"], lambda e: F.when(a["begun"], e["in"].eqNullSafe(a["held"])).otherwise(e["own"])), F.lit(0))
        local = F.get(F.filter(s["entries"], lambda e: e["own"]), F.lit(0))["held"]
        guess = step(F.struct(a["held"].alias("held"), F.lit(0).alias("n")), local)["held"]
        asked = F.when(hit.isNull(), F.array(F.struct(s["seg"].alias("seg"), a["held"].alias("held")))).otherwise(F.slice(a["asked"], 1, 0))
        return F.struct(F.when(hit.isNull(), guess).otherwise(hit["held"]).alias("held"), (a["n"] + F.coalesce(hit["dn"], F.lit(0))).alias("n"), F.lit(True).alias("begun"), F.concat(a["asked"], asked).alias("asked"))

    while True:
        entry = F.struct(F.col("_in").alias("in"), F.col("_held").alias("held"), F.col("_dn").alias("dn"), F.col("_own").alias("own"))
        segs = known.groupBy("_k", "_seg").agg(F.collect_list(entry).alias("entries"))
        keys = segs.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct(F.col("_seg").alias("seg"), "entries"))).alias("_s"))
        any_row = F.get(F.get("_s", F.lit(0))["entries"], F.lit(0))["in"]
        nothing = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("seg"), any_row.alias("held"))), 1, 0)
        start = F.struct(any_row.alias("held"), F.lit(0).alias("n"), F.lit(False).alias("begun"), nothing.alias("asked"))
        walked = written(keys.select("_k", F.aggregate("_s", start, walk).alias("_a")), "fold-walks")
        asked = walked.select("_k", F.explode("_a.asked").alias("_q")).select("_k", F.col("_q.seg").alias("_seg"), F.col("_q.held").alias("_in"))
        if asked.isEmpty():
            return walked.select("_k", F.struct("_a.held", "_a.n").alias("_a"))
        found = segments.join(asked, ["_k", "_seg"]).select("_k", "_seg", "_in", F.aggregate("_rows", F.struct(F.col("_in").alias("held"), F.lit(0).alias("n")), step).alias("_out"))
        before, known = known, written(known.unionByName(found.select("_k", "_seg", "_in", *made(False))), "fold-known")
        removed(before)
        removed(walked)


def winners(df: DataFrame, *, key: list[str], value: str, source: str, file: str, version: str, row: str, preferred: Column, ranking: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """The fact that wins for each key, and n_conflicts. In order of source, file, version and row
    (as text): the same file's first row stays; equal values and incoming zeros are passed
    over; a preferred source beats any other; else the later version and row (as a number) wins, and that is a conflict.
    With a ranking (P4) a row that has one replaces a held row that lacks it, whatever else holds, and only rows that are equal in it too are passed over."""
    facts = df.withColumn("_v", F.col(value).cast("double")).withColumn("_good", F.coalesce(preferred, F.lit(False)))
    names = [source, file, version, row, *(c for c in ["_v", "_good", *([ranking] if ranking else [])] if c not in (source, file, version, row))]
    item = F.struct(*names)
    later = lambda x: F.struct(x[version], F.coalesce(x[row].try_cast("long"), F.lit(0)))

    def step(a: Column, x: Column) -> Column:
        held, n = a["held"], a["n"]
        same_file = held[file].eqNullSafe(x[file]) & held[version].eqNullSafe(x[version])
        same = held["_v"].eqNullSafe(x["_v"]) & (held[ranking].eqNullSafe(x[ranking]) if ranking else F.lit(True))
        fills = held[ranking].isNull() & x[ranking].isNotNull() if ranking else F.lit(False)
        passed = ~fills & (same_file | same | F.coalesce(x["_v"] == 0, F.lit(True)))
        wins = F.when(held["_good"] != x["_good"], x["_good"]).otherwise(later(x) > later(held))
        clash = ~fills & (held["_good"] == x["_good"])
        return F.struct(F.when(passed | ~(wins | fills), held).otherwise(x).alias("held"), (n + F.when(~passed & clash, 1).otherwise(0)).alias("n"))

    short, long = _divided(facts, key, segment)
    out = _in_order(short, ["_k"], item).select("_k", _from_first(F.col("_rows"), step).alias("_a"))
    if long is not None:
        out = out.unionByName(_chained(long, item, step, segment))
    return out.select("_k.*", F.col("_a.held._v").alias(value), F.col(f"_a.held.{source}").alias(source), F.col(f"_a.held.{file}").alias(file), F.col(f"_a.held.{version}").alias(version), F.col(f"_a.held.{row}").alias(row), *([F.col(f"_a.held.{ranking}").alias(ranking)] if ranking else []), F.col("_a.n").alias("n_conflicts"))


class _Links:
    """A link's changes as functions of its state. A state is struct(state, target, n).

    From UNMATCHED a segment of changes leads to ``free``; from CONFLICT or SKIPPED to ``freed``, if a replay is among them, else
    nowhere; from LINKED to ``same`` if the target is that of the first change (or that is no link), else to ``other``, whose
    target is the one before (``own``) until a replay."""

    def __init__(self, kind: str):
        self.kind = kind

    def state(self, state: Column, target: Column, n: Column) -> Column:
        return F.struct(state.alias("state"), target.cast(self.kind).alias("target"), n.cast("int").alias("n"))

    def after(self, a: Column, x: Column) -> Column:
        """The state after one change x of a state."""
        locked = a["state"].isin("CONFLICT", "SKIPPED") & ~x["replay"]
        relink = (a["state"] == "LINKED") & (x["state"] == "LINKED") & ~a["target"].eqNullSafe(x["target"])
        target = F.when(locked | relink, a["target"]).when(x["state"] == "LINKED", x["target"])
        return self.state(F.when(locked, a["state"]).when(relink, "CONFLICT").otherwise(x["state"]), target, a["n"] + F.when(~locked & relink, 1).otherwise(0))

    def set_to(self, x: Column) -> Column:
        return self.state(x["state"], F.when(x["state"] == "LINKED", x["target"]), F.lit(0))

    def start(self) -> Column:
        none = F.lit(None).cast(self.kind)
        empty = self.state(F.lit("UNMATCHED"), none, F.lit(0))
        return F.struct(F.lit(False).alias("begun"), empty.alias("free"), F.lit(False).alias("replayed"), empty.alias("freed"), F.lit(False).alias("linked"), none.alias("pivot"), empty.alias("same"), F.lit(False).alias("own"), empty.alias("other"))

    def composed(self, f: Column, x: Column) -> Column:
        """The function f, then the change x."""
        links = x["state"] == "LINKED"
        other = F.when(~f["begun"], F.when(links, self.state(F.lit("CONFLICT"), F.lit(None), F.lit(1))).otherwise(self.set_to(x))).otherwise(self.after(f["other"], x))
        return F.struct(
            F.lit(True).alias("begun"), self.after(f["free"], x).alias("free"), (f["replayed"] | x["replay"]).alias("replayed"),
            F.when(f["replayed"], self.after(f["freed"], x)).when(x["replay"], self.set_to(x)).otherwise(f["freed"]).alias("freed"),
            F.when(f["begun"], f["linked"]).otherwise(links).alias("linked"), F.when(f["begun"], f["pivot"]).otherwise(x["target"]).alias("pivot"),
            F.when(f["begun"], self.after(f["same"], x)).otherwise(self.set_to(x)).alias("same"),
            F.when(f["begun"], f["own"] & ~x["replay"]).otherwise(links).alias("own"), other.alias("other"),
        )

    def applied(self, a: Column, f: Column) -> Column:
        """The state after a whole segment."""
        plus = lambda s, target=None: self.state(s["state"], s["target"] if target is None else target, a["n"] + s["n"])
        same = ~f["linked"] | a["target"].eqNullSafe(f["pivot"])
        linked = F.when(same, plus(f["same"])).otherwise(plus(f["other"], F.when(f["own"], a["target"]).otherwise(f["other"]["target"])))
        return F.when(a["state"].isin("CONFLICT", "SKIPPED"), F.when(f["replayed"], plus(f["freed"])).otherwise(a)).when(a["state"] == "LINKED", linked).otherwise(plus(f["free"]))


def link_states(df: DataFrame, *, key: list[str], order: list[str], target: str, state: str, replay: str, segment: int = SEGMENT) -> DataFrame:
    """Each link's state and target after all its changes, and n_relinks. A linked target never
    changes: another one is counted and makes a CONFLICT; CONFLICT and SKIPPED are left only on replay."""
    links = _Links(dict(df.dtypes)[target])
    change = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(target).alias("target"), F.col(state).alias("state"), F.coalesce(F.col(replay), F.lit(False)).alias("replay"))
    begin = links.state(F.lit("UNMATCHED"), F.lit(None), F.lit(0))
    short, long = _divided(df, key, segment)
    out = _in_order(short, ["_k"], change).select("_k", F.aggregate("_rows", begin, links.after).alias("_a"))
    if long is not None:
        reduced = _segments(long, change, segment).select("_k", F.struct("_seg", F.aggregate("_rows", links.start(), links.composed).alias("f")).alias("_x"))
        out = out.unionByName(_in_order(reduced, ["_k"], F.col("_x")).select("_k", F.aggregate("_rows", begin, lambda a, x: links.applied(a, x["f"])).alias("_a")))
    return out.select("_k.*", F.col("_a.state").alias("state"), F.col("_a.target").alias("target"), F.col("_a.n").alias("n_relinks"))


def best_since_gap(values: Column) -> Column:
    """The least value since the last null of an array in order of years; 0 if that is nothing."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: F.when(x.isNull() | (x == 0), 0.0).when((a == 0) | (x < a), x.cast("double")).otherwise(a))
