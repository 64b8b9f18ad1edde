"""Entities that share identifiers, directly or through others: connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import removed, written


def _rank(node: Column, number: int) -> Column:
    """An order of nodes that is another in each round, so no order of keys makes long paths."""
    return F.struct(F.xxhash64(F.lit(number), node).alias("h"), node.alias("x"))


def contracted(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """One round on edges(a, b): (a, to) of every node that has one, and the edges left between what nodes went to.

    Each node goes to the least of itself and its neighbours, and on to where that goes. About two thirds of a path's nodes and more
    vanish; nodes without edges are settled and come up no more."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(_rank(F.col("b"), number)).alias("m"))
    step = written(near.select("a", F.least(_rank(F.col("a"), number), F.col("m"))["x"].alias("to")), "identity-steps")
    ahead = step.select(F.col("a").alias("to"), F.col("to").alias("further"))
    gone = written(step.join(ahead, "to").select("a", F.col("further").alias("to")), "identity-moves")
    removed(step)
    end = lambda c: gone.select(F.col("a").alias(c), F.col("to").alias(f"_{c}"))
    moved = edges.join(end("a"), "a").join(end("b"), "b").where("_a <> _b")
    return gone, written(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "identity-edges")


def resolved(df: DataFrame, *, key: str, token: str) -> DataFrame:
    """(key, identity): the least key that a key reaches through shared tokens; null tokens join nothing.

    A token joins each of its keys to the least of them, so a token of many keys makes no pairs. Rounds contract the graph until no edge is
    left, each on what the one before it left over: on a path of 100,000 keys about ten."""
    keyed = df.select(F.col(key).alias("k"), F.col(token).alias("t"))
    least = keyed.where("t is not null").groupBy("t").agg(F.min("k").alias("m"))
    edges = written(keyed.join(least, "t").where("k <> m").select(F.col("m").alias("a"), F.col("k").alias("b")).distinct(), "identity-edges")
    moves = []
    while not edges.isEmpty():
        gone, left = contracted(edges, len(moves))
        removed(edges)
        moves.append(gone)
        edges = left
    every = df.select(F.col(key).alias("k")).distinct()
    if not moves:
        return every.select(F.col("k").alias(key), F.col("k").alias("identity"))
    roots = moves[-1]
    for earlier in moves[-2::-1]:  # each as large as its round was
        later = roots.select(F.col("a").alias("to"), F.col("to").alias("root"))
        roots = earlier.join(later, "to", "left").select("a", F.coalesce("root", "to").alias("to"))
    roots = written(roots, "identity-roots")
    for gone in moves:
        removed(gone)
    first = roots.groupBy("to").agg(F.min("a").alias("identity"))
    found = roots.join(first, "to").select(F.col("a").alias("k"), "identity")
    return every.join(found, "k", "left").select(F.col("k").alias(key), F.coalesce("identity", "k").alias("identity"))
