"""Hashed n-gram indicators of texts, and bounded samples of labelled texts as such."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import ALNUM, LOWER, NOT_SPACE, RollingHash, Words, buffer_of, mixed, pieces, with_columns

BITS = 20
_SHAPES = np.arange(256).astype(np.uint8)
_SHAPES[65:91], _SHAPES[97:123], _SHAPES[48:58], _SHAPES[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")
_KEPT: dict[int, RollingHash] = {}


def _hasher(seed: int) -> RollingHash:
    return _KEPT.setdefault(seed, RollingHash(seed))


class Indicators:
    """Which of 2**BITS hashed features each text has: (text, feature), each pair once."""

    def __init__(self, n: int, text: np.ndarray, feature: np.ndarray):
        pairs = np.unique((text.astype(np.int64) << BITS) | feature.astype(np.int64))
        self.n, self.text, self.feature = n, pairs >> BITS, pairs & ((1 << BITS) - 1)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights[self.feature], minlength=self.n)


def _bucket(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def word_indicators(texts: pa.Array) -> Indicators:
    """Lower-cased words of letters and digits, and the stems of longer ones: their first 4, 5 and 6 bytes."""
    buf, offsets = buffer_of(texts)
    w = Words(LOWER[buf], offsets, ALNUM)
    of, hasher = w.text_of_word(), _hasher(6)
    values = hasher.bytes[w.buf]
    found = [(of, hasher.runs(values, w.start, w.end))]
    for k in (4, 5, 6):
        on = np.flatnonzero(w.end - w.start > k)
        found.append((of[on], hasher.runs(values, w.start[on], w.start[on] + k) + np.uint64(k << 44)))
    return Indicators(len(texts), np.concatenate([t for t, _ in found]), np.concatenate([_bucket(h) for _, h in found]))


def _pairs(h: np.ndarray, w: Words, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all n-grams within texts."""
    at = w.windows(n)
    return at, _hasher(seed).runs(h, at, at + n)


def quality_indicators(texts: pa.Array) -> Indicators:
    """Words and their shapes, single and in pairs, and how much of a text repeats.

    A shape has one character for each run of letters of a case, digits, or one mark. Two more
    indicators tell the length (by powers of two) and the share of word trigrams that
    occur before in the text (by tenths)."""
    buf, offsets = buffer_of(texts)
    w = Words(buf, offsets, NOT_SPACE)
    of, n = w.text_of_word(), len(texts)
    words = _hasher(7).runs(_hasher(7).bytes[LOWER[buf]], w.start, w.end)
    shape = _SHAPES[buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = _hasher(8).runs(_hasher(8).bytes[shape[keep]], place[w.start], place[w.end])
    found = [(of, words), (of, shapes + np.uint64(1))]
    for h, seed in ((words, 9), (shapes, 10)):
        at, pair = _pairs(h, w, 2, seed)
        found.append((of[at], pair))
    at, three = _pairs(words, w, 3, 11)
    order = np.lexsort((three, of[at]))
    again = np.zeros(len(at), np.int64)
    if len(at):
        a, b = order[1:], order[:-1]
        again[a] = (three[a] == three[b]) & (of[at][a] == of[at][b])
    share = np.bincount(of[at], again, minlength=n) / np.maximum(np.bincount(of[at], minlength=n), 1)
    every = np.arange(n)
    found.append((every, mixed(np.ceil(share * 10).astype(np.uint64) + np.uint64(1 << 40))))
    found.append((every, mixed(np.log2(w.counts + 1).astype(np.uint64) + np.uint64(1 << 41))))
    return Indicators(n, np.concatenate([t for t, _ in found]), np.concatenate([_bucket(h) for _, h in found]))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that rest; a null id is always held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(True))


def drawn(labelled: DataFrame, text: str, bounds: dict[int, tuple[int, int]]) -> DataFrame:
    """labelled(of, y, text), or of each class y that has bounds (rows, bytes of text) about so many
    at most, chosen by a hash of the id and the row: rows that repeat, or share an id, are drawn one by one."""
    sizes = {r.y: (r.n, r.size) for r in labelled.groupBy("y").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).collect()}
    shares = {y: min(1.0, rows / max(1, sizes[y][0]), size / max(1, sizes[y][1])) for y, (rows, size) in bounds.items() if y in sizes}
    shares = {y: int(x * (1 << 30)) for y, x in shares.items() if x < 1}
    if not shares:
        return labelled
    place, most = F.pmod(F.xxhash64("of", F.monotonically_increasing_id(), F.lit("drawn")), F.lit(1 << 30)), F.lit(1 << 30)
    for y, share in shares.items():
        most = F.when(F.col("y") == y, share).otherwise(most)
    return labelled.withColumn("drawn_at", place).where(F.col("drawn_at") < most).drop("drawn_at")


def of_ids(known: DataFrame, at_most: int) -> DataFrame:
    """known(of, y), or about at_most of its ids, chosen by a hash: a bound for a broadcast."""
    n = known.count()
    return known if n <= at_most else known.where(F.pmod(F.xxhash64("of", F.lit("id")), F.lit(1 << 30)) < int(at_most / n * (1 << 30)))


class Sample:
    """Texts as indicators, on the driver: labels, and columns of text i in column[at[i]:at[i + 1]].

    names: the features that the columns stand for."""

    def __init__(self, names: np.ndarray, label: np.ndarray, at: np.ndarray, column: np.ndarray):
        self.names, self.label, self.at, self.column = names, label, at, column

    def __len__(self) -> int:
        return len(self.label)

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.at))

    def support(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the texts that rows marks each column's feature occurs."""
        return np.bincount(self.column[rows[self.text()]], minlength=len(self.names))

    def rows(self, chosen: np.ndarray) -> "Sample":
        lengths = np.diff(self.at)
        at = np.concatenate([[0], np.cumsum(lengths[chosen])]).astype(np.int64)
        return Sample(self.names, self.label[chosen], at, self.column[np.repeat(chosen, lengths)])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.text(), weights[self.column], minlength=len(self))

    def full(self, weights: np.ndarray) -> np.ndarray:
        """Weights of all features from those of the columns."""
        out = np.zeros(1 << BITS)
        out[self.names] = weights
        return out


def supports(labelled: DataFrame, text: str, label: str, indicators: Callable[[pa.Array], Indicators], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each class there are, and in how many each feature occurs; summed in tasks first."""

    def run(batches):
        counts = np.zeros((classes, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                y, x = piece.column(0).to_numpy(), indicators(piece.column(1))
                for c in range(classes):
                    counts[c, :-1] += np.bincount(x.feature[(y == c)[x.text]], minlength=1 << BITS)
                    counts[c, -1] += (y == c).sum()
        c, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(counts[c, f])], ["label", "feature", "n"])

    rows = labelled.select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"))
    table = rows.mapInArrow(run, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((classes, (1 << BITS) + 1), np.int64)
    out[table.column("label").to_numpy(), table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return out[:, -1], out[:, :-1]


def gathered(labelled: DataFrame, text: str, label: str, indicators: Callable[[pa.Array], Indicators], names: np.ndarray) -> Sample:
    """The rows of labelled as a Sample of the named features: tasks make the indicators, the driver gets those alone."""
    column = np.full(1 << BITS, -1, np.int32)
    column[names] = np.arange(len(names))
    held = labelled.sparkSession.sparkContext.broadcast(column)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x = indicators(piece.column(1))
                own = held.value[x.feature]
                ends = np.searchsorted(x.text[own >= 0], np.arange(x.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(own[own >= 0]))], ["label", "columns"])

    table = labelled.select(F.col(label).cast("int").alias("label"), F.col(text).alias("text")).mapInArrow(run, "label int, columns array<int>").toArrow()
    lists = table.column("columns").chunks
    lengths = np.concatenate([np.zeros(0, np.int32), *(np.diff(c.offsets.to_numpy()) for c in lists)])
    values = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in lists)])
    return Sample(names, table.column("label").to_numpy(), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), values)


def scored(docs: DataFrame, text: str, indicators: Callable[[pa.Array], Indicators], weights: np.ndarray, bias: float) -> DataFrame:
    """docs with a column score: the logistic function of the indicators' weights."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS numbers: 4 MB

    def make(batch: pa.RecordBatch) -> list:
        margin = indicators(batch.column(batch.schema.get_field_index(text))).sums(held.value) + bias
        return [1 / (1 + np.exp(-np.clip(margin, -500, 500)))]

    return with_columns(docs, text, [T.StructField("score", T.DoubleType())], make)


def cut(margin: np.ndarray, right: np.ndarray, share: float = 0.5) -> float:
    """The middle of the widest gap between margins that errs least, the right ones counting by share."""
    if not len(margin) or right.all() or not right.any():
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, r = margin[order], right[order]
    wrong = share * np.concatenate([[0], np.cumsum(r)]) / r.sum() + (1 - share) * ((~r).sum() - np.concatenate([[0], np.cumsum(~r)])) / (~r).sum()
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    gaps = np.diff(edges)
    gaps[wrong > wrong.min() + 1e-12] = -1
    k = int(np.argmax(gaps))
    return float((edges[k] + edges[k + 1]) / 2)
