"""SimHash near-copies: fingerprints within a Hamming distance, found by pigeonring filtering.

A 64-bit fingerprint is a ring of eight 8-bit segments. If two fingerprints differ in
at most 3 bits, some segment starts a chain in which every l consecutive segments
differ in at most floor(3 l / 8) bits together: the first two not at all, and the next
three in at most one bit, so two of those three are equal as well. Such chains make
exact keys: 8 starts times 3 choices, each of 32 bits. Fingerprints that share a key are
candidates; the rest of the chain is checked against its budgets, and the whole ring is
the last link of that chain, so what passes is within the distance.

Copies are one fingerprint from the start, and what a key's fingerprints have in common
is given on as a spanning forest of their links, so large groups never become pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import removed, written
from ._text import LOWER, NOT_SPACE, Words, buffer_of, mixed, with_columns
from ._xxh64 import xxh64

SHINGLE, DISTANCE = 3, 3
SEGMENTS, BITS = 8, 8
_BUDGET = [DISTANCE * (k + 1) // SEGMENTS for k in range(SEGMENTS)]
#: Which two of a chain's segments 2, 3 and 4 are equal.
_CHOICES = ((2, 3), (2, 4), (3, 4))
#: The bits that each chain's key fixes.
_FIXED = np.array([sum(0xFF << (BITS * ((start + k) % SEGMENTS)) for k in (0, 1, *choice)) for start in range(SEGMENTS) for choice in _CHOICES], np.uint64)
#: Groups of a key up to the first size are compared all with all; larger ones give a forest. Beyond the
#: second, fingerprints get further keys, which fix more bits. The budgets are the same in all.
_PAIRS, _SCAN = 16, 4096
#: So few free bits make no more than _SCAN fingerprints.
_FEW_BITS = 12


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    buf, offsets = buffer_of(texts)
    w = Words(LOWER[buf], offsets, NOT_SPACE)
    out = np.zeros(len(texts), np.uint64)
    if not len(w):
        return out
    # One space after each word: runs of words are then runs of bytes.
    low, keep = w.buf.copy(), NOT_SPACE[w.buf]
    gaps = w.end[w.end < len(low)]
    gaps = gaps[~NOT_SPACE[low[gaps]]]
    low[gaps], keep[gaps] = 0x20, True
    place = np.cumsum(keep) - 1
    start, end, low = place[w.start], place[w.end - 1] + 1, low[keep]
    counts = w.counts
    width = np.minimum(shingle, counts)
    each = np.repeat(width, counts)
    at = np.flatnonzero(np.repeat(w.first[1:], counts) - np.arange(len(w)) >= each)
    h = xxh64(low, start[at], end[at + each[at] - 1])
    full = np.flatnonzero(counts)
    n = counts[full] - width[full] + 1
    heads = np.concatenate([[0], np.cumsum(n)[:-1]])
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _segments(fp: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(-1, SEGMENTS)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's 24 keys: (key, row). A key holds its start and choice, so keys
    of different chains never meet."""
    seg = _segments(fp).astype(np.int64)
    keys = []
    for start in range(SEGMENTS):
        s = [seg[:, (start + k) % SEGMENTS] for k in range(5)]
        for choice, (a, b) in enumerate(_CHOICES):
            keys.append(((start * 3 + choice) << 56) | (s[0] << 24) | (s[1] << 16) | (s[a] << 8) | s[b])
    return np.concatenate(keys), np.tile(np.arange(len(fp)), len(keys))


def viable(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment start keeps every budget, up to the whole ring."""
    ones = np.bitwise_count(_segments(x ^ y)).astype(np.int64)
    ring = (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS
    return (np.cumsum(np.take_along_axis(ones, ring, axis=1), axis=1) <= np.array(_BUDGET)).all(axis=1)


def _forest(fp: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join the same fingerprints of one key as all viable chains from start do."""
    a, b, rest = [], [], fp
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            close = np.flatnonzero(np.bitwise_count(rest ^ front[0]) <= DISTANCE)
            near = np.zeros(len(rest), bool)
            near[close] = viable(rest[close], np.full(len(close), front[0]), np.full(len(close), start))
            found = rest[near]
            a.append(np.full(len(found), front[0]))
            b.append(found)
            front, rest = np.concatenate([front[1:], found]), rest[~near]
    return a, b


def links_of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal key whose chains are viable: all in small groups, a forest in large ones."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp = key[fresh], fp[fresh]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(key)]]))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for d in range(1, _PAIRS):
        i = np.flatnonzero((size[:-d] <= _PAIRS) & (key[d:] == key[:-d])) if len(key) > d else np.zeros(0, int)
        good = viable(fp[i], fp[i + d], (key[i] >> 56) // 3)
        a.append(fp[i[good]])
        b.append(fp[i[good] + d])
    for h, n in zip(heads[sizes > _PAIRS], sizes[sizes > _PAIRS], strict=True):
        more = _forest(fp[h : h + n], int(key[h] >> 56) // 3)
        a += more[0]
        b += more[1]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def further_keys(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, mask, fp) with four keys for each, which fix a quarter more of the free bits (mask has the fixed ones).
    Two fingerprints differ in at most three bits, so they share one of the four. A key
    holds its chain, how many bits it fixes, and a hash: keys that coincide only make more candidates."""
    keys = []
    for fixed in np.unique(mask):
        at = np.flatnonzero(mask == fixed)
        free = [k for k in range(64) if not int(fixed) >> k & 1]
        for part in range(DISTANCE + 1):
            more = fixed | np.uint64(sum(1 << k for k in free[part :: DISTANCE + 1]))
            hashed = mixed((fp[at] & more) ^ mixed(np.array([more]))) & np.uint64((1 << 50) - 1)
            keys.append((at, (key[at] >> 56 << 56) | (int(more).bit_count() << 50) | hashed.astype(np.int64), more))
    rows = np.concatenate([np.zeros(0, np.int64), *(at for at, _, _ in keys)])
    masks = np.concatenate([np.zeros(0, np.uint64), *(np.full(len(at), more) for at, _, more in keys)])
    return np.concatenate([np.zeros(0, np.int64), *(k for _, k, _ in keys)]), masks, fp[rows]


def links(fps: DataFrame, *, scan: int = _SCAN) -> DataFrame:
    """Links (a, b) among the distinct values of fps(fp): their components are those of all
    pairs within the distance.

    Spark sorts the keys of a partition, spilling as it must, and they are compared as they stream by. No group is
    held whole: the rows of a key that has more than scan fingerprints go on, written, to a
    further round under further keys. Each fixes more bits, so rounds end."""

    def keyed(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, row = chain_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_FIXED[key >> 56].view(np.int64)), pa.array(fp[row].view(np.int64))], ["key", "mask", "fp"])

    def rekeyed(batches):
        for batch in batches:
            key, mask, fp = (c.to_numpy() for c in batch.columns)
            key, mask, fp = further_keys(key, mask.view(np.uint64), fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mask.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "mask", "fp"])

    def met(batches):
        """Links as (null, null, a, b), and rows that need further keys as (key, mask, fp, null)."""
        rest, large = [np.zeros(0, np.int64)] * 3, None  # the last key's rows so far; the last key that was found large

        def out(key, mask, fp):
            nonlocal large
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(key)]]))
            many = np.repeat(sizes > scan, sizes)
            if large is not None:
                many |= key == large
            many &= np.bitwise_count(~mask.view(np.uint64)) > _FEW_BITS
            if many.any():
                large = key[many][-1]
            a, b = (x.view(np.int64) for x in links_of(key[~many], fp[~many].view(np.uint64)))
            none, nothing = pa.nulls(len(a), pa.int64()), pa.nulls(int(many.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], ["key", "mask", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(mask[many]), pa.array(fp[many]), nothing], ["key", "mask", "a", "b"])

        for batch in batches:
            rows = [np.concatenate([old, c.to_numpy()]) for old, c in zip(rest, batch.columns, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if len(rows[0]) - last > scan and int(~rows[1].view(np.uint64)[-1]).bit_count() > _FEW_BITS or last < len(rows[0]) and rows[0][-1] == large:
                last = len(rows[0])  # it is large already: its rows needn't wait
            if last:
                yield from out(*(c[:last] for c in rows))
            rest = [c[last:] for c in rows]
        if len(rest[0]):
            yield from out(*rest)

    keys, found = fps.select("fp").mapInArrow(keyed, "key long, mask long, fp long"), []
    while True:
        rows = keys.repartition("key").sortWithinPartitions("key").mapInArrow(met, "key long, mask long, a long, b long")
        found.append(written(rows, "key-links"))
        crowded = found[-1].where("key is not null").select("key", "mask", F.col("a").alias("fp"))
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [x.where("key is null").select("a", "b") for x in found])
        keys = crowded.mapInArrow(rekeyed, "key long, mask long, fp long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges(a, b): root is the least node of its component.

    Large-star and small-star rounds until the links stay the same, which takes about the
    logarithm of the nodes; each is written in the shared folder, and the one before it
    removed. A round joins on nodes, whose hot ones Spark splits."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select("v", "m").union(low.select("u", "m")).toDF("u", "v").distinct()
        last, edges = edges, written(small, "links")
        removed(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def clustered(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", uid: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) and component_id (the least id that links reach);
    with uid, a column that tells rows apart, also uid and root (the component's least fingerprint:
    unlike its id, no other component has it).

    Words are split at spaces and 0x09-0x0D after lower-casing A-Z; shingles of three,
    repeats included; a shorter text is one shingle; a null or wordless text has
    fingerprint zero and links like any other. A null id is kept and is never a
    component's least id unless there is no other (then null); rows that repeat
    get a row each; an empty table gives an empty one. A very long text is hashed whole, in memory of some
    100 times its bytes."""
    own = [] if uid is None else ["uid", "root"]
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(uid).alias("uid") for _ in own[:1]))
    made = with_columns(named, "text", [T.StructField("fp", T.LongType())], lambda batch: [pa.array(fingerprints(batch.column(batch.schema.get_field_index("text"))).view(np.int64))])
    marked = written(made.select("doc_id", "fp", *own[:1]), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    near = links(fps)
    roots = components(near).withColumnRenamed("node", "fp")
    removed(near)
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(rooted.join(named, "root").select("fp", "component_id", *own[1:]), "components")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id", *own)


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its own columns: of the rows with its least id, the first in the table's
    order. No text is shuffled.
    Rows are told apart by a key of their own, so ids may be null (they come last) or repeat: an
    id that is least in several components keeps a row of each."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")), "keyed-documents")
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    found = clustered(keyed.select("uid", place[doc_id].alias("doc_id"), place[text].alias("text")), uid="uid")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("uid").alias("uid"))
    return keyed.join(kept, "uid", "left_semi").select(*(x.alias(c) for c, x in place.items()))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints and components of all documents."""
    found = clustered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
