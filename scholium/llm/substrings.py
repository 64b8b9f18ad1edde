"""Repeated passages by recompression: runs and pairs of tokens are named, round by round.

A symbol stands for a passage; at first each word is one. A round names short runs of one
symbol, then splits all names into left and right ones by a bit of the name and joins each
left one with a right one that follows it. A name is a hash of what it names, so equal
pairs get equal names in every task, and whether symbols are joined depends on little around
them: each symbol carries the range of words that decide it, and wherever those words
occur the same symbol does.

A window of 35 words is known by one symbol that the window's own words decide, of the
highest round that has one in it. Round one counts these symbols over all blocks of
documents: a window whose symbol is nowhere else has no copy. Round two counts the windows
whose symbol is shared, by 128 bits of hash: two sums, with powers of two bases, over the
35 words' own hashes of different seeds (no hash sees more than 35 values in a row, so
none of the long runs that collide under every base can occur). Both
rounds ask about each distinct key once per block, so copies don't pile up anywhere. What a
block notes for itself between rounds is by the place of a window in the block, whose rows are
always in the order of their keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import QUESTIONS, Exchange, grouped, pack, pack_sorted, questions_table
from ._text import NOT_SPACE, RollingHash, Words, mixed, words_of

WINDOW, ROUNDS, LONGEST = 35, 6, 12
_FAR = np.int64(1 << 60)
_KEPT: dict[int, RollingHash] = {}


def _hasher(seed: int) -> RollingHash:
    return _KEPT.setdefault(seed, RollingHash(seed))


class Symbols:
    """Symbols in order: names, word ranges, the ranges of words that decide them, and their texts."""

    def __init__(self, name, start, end, low, high, text):
        self.name, self.start, self.end, self.low, self.high, self.text = name, start, end, low, high, text

    @classmethod
    def of(cls, names: np.ndarray, text: np.ndarray) -> "Symbols":
        i = np.arange(len(names))
        return cls(names, i, i + 1, i, i + 1, text)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words that decide the symbol before and the one after; past a text's end, all that may follow."""
        same = self.text[1:] == self.text[:-1]
        before = np.concatenate([[-_FAR], np.where(same, self.low[:-1], -_FAR)])
        after = np.concatenate([np.where(same, self.high[1:], _FAR), [_FAR]])
        return same, before, after

    def _take(self, name, first, last, low, high) -> "Symbols":
        return Symbols(name, self.start[first], self.end[last], low, high, self.text[first])

    def with_runs(self, turn: int) -> "Symbols":
        """Runs of one name are one symbol if they have at most LONGEST words."""
        if not len(self.name):
            return self
        same, before, after = self._neighbours()
        heads = np.flatnonzero(np.concatenate([[True], ~(same & (self.name[1:] == self.name[:-1]))]))
        count = np.diff(np.concatenate([heads, [len(self.name)]]))
        tails = heads + count - 1
        short = (count > 1) & (self.end[tails] - self.start[heads] <= LONGEST)
        # A long run stays as it is; what shows that is so many of its symbols to either side,
        # or its end with what follows it, so the same words always show it the same way.
        low, high = self.low.copy(), self.high.copy()
        run = np.repeat(np.arange(len(heads)), count)
        long = np.flatnonzero((count > 1)[run] & ~short[run])
        need, head, tail = LONGEST // (self.end - self.start)[long], heads[run[long]], tails[run[long]]
        a, b = long - need, long + need
        low[long] = np.minimum(self.low[long], np.where(a >= head, self.low[np.maximum(a, head)], np.minimum(self.low[head], before[head])))
        high[long] = np.maximum(self.high[long], np.where(b <= tail, self.high[np.minimum(b, tail)], np.maximum(self.high[tail], after[tail])))
        joined = short[run]
        keep = ~joined
        keep[heads[short]] = True
        name = self.name.copy()
        name[heads[short]] = mixed(self.name[heads[short]] * np.uint64(0x9E3779B97F4A7C15) + count[short].astype(np.uint64) + np.uint64(turn << 50))
        last = np.arange(len(name))
        last[heads[short]] = tails[short]
        low[heads[short]] = np.minimum(before[heads[short]], np.minimum.reduceat(self.low, heads)[short])
        high[heads[short]] = np.maximum(after[tails[short]], np.maximum.reduceat(self.high, heads)[short])
        # A symbol that is no run is one because its neighbours differ.
        lone = np.flatnonzero((count == 1)[run])
        low[lone], high[lone] = np.minimum(low[lone], before[lone]), np.maximum(high[lone], after[lone])
        at = np.flatnonzero(keep)
        return self._take(name[at], at, last[at], low[at], high[at])

    def with_pairs(self, turn: int) -> "Symbols":
        """A left name and the right name after it are one symbol if they have at most LONGEST words."""
        if not len(self.name):
            return self
        same, before, after = self._neighbours()
        right = (mixed(self.name + np.uint64(turn)) & np.uint64(1)).astype(bool)
        join = np.zeros(len(self.name), bool)
        join[:-1] = same & ~right[:-1] & right[1:] & (self.end[1:] - self.start[:-1] <= LONGEST)
        second = np.concatenate([[False], join[:-1]])
        i = np.flatnonzero(join)
        name, last = self.name.copy(), np.arange(len(self.name))
        name[i] = mixed(self.name[i] * np.uint64(0xBF58476D1CE4E5B9) + mixed(self.name[i + 1]) + np.uint64(turn << 51))
        last[i] = i + 1
        low, high = np.where(right, np.minimum(self.low, before), self.low), np.where(right, self.high, np.maximum(self.high, after))
        low[i], high[i] = np.minimum(self.low[i], self.low[i + 1]), np.maximum(self.high[i], self.high[i + 1])
        at = np.flatnonzero(~second)
        return self._take(name[at], at, last[at], low[at], high[at])


def levels(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """The symbols of each round, words first."""
    symbols = Symbols.of(names, text)
    yield symbols
    for turn in range(1, rounds + 1):
        symbols = symbols.with_runs(turn).with_pairs(turn)
        yield symbols


def representatives(h: np.ndarray, text: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the name of the symbol it is known by, and that symbol's place.

    Of the highest round with a symbol that the window's words decide, the one decided first."""
    name, place = np.zeros(len(at), np.uint64), np.full(len(at), -1, np.int64)
    for turn, s in reversed(list(enumerate(levels(h, text)))):
        usable = np.flatnonzero((s.low >= 0) & (s.high <= len(h)) & (s.high - s.low <= window))
        best = np.full(len(h) + 1, _FAR)
        np.minimum.at(best, s.low[usable], s.high[usable] * (len(h) + 1) + usable)
        best = np.minimum.accumulate(best[::-1])[::-1]
        found = best[at]
        new = np.flatnonzero((place < 0) & (found < _FAR) & (found // (len(h) + 1) <= at + window))
        k = found[new] % (len(h) + 1)
        name[new] = mixed(s.name[k] ^ np.uint64(turn << 55))
        place[new] = s.start[k] * (ROUNDS + 1) + turn
    return name, place


def _shared(n: np.ndarray) -> bytes:
    """The bits of the keys that are counted more than once."""
    return np.packbits(n > 1).tobytes()


def _counts(bits: bytes, n: int) -> np.ndarray:
    """1 or 2 for each of n keys."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(np.uint64) + np.uint64(1)


class _Block:
    """A block's words and windows, the same whenever they are made."""

    def __init__(self, texts: pa.Array, window: int):
        self.words: Words = words_of(texts, NOT_SPACE)
        self.at = self.words.windows(window)

    def symbols(self, window: int):
        """Distinct symbol names, which windows have which, and the names that two places of the block share."""
        name, place = representatives(self.words.hashes(21), self.words.text_of_word(), self.at, window)
        keys, of = np.unique(name, return_inverse=True)
        once = np.unique(np.stack([of, place], axis=1), axis=0)[:, 0] if len(of) else of
        return keys, of, np.bincount(once, minlength=len(keys)) > 1

    def windows(self, chosen: np.ndarray, window: int):
        """Distinct hashes of the chosen windows (two halves), which window has which, and those that the block repeats."""
        at = self.at[chosen]
        one = _hasher(22).runs(self.words.hashes(21), at, at + window)
        two = _hasher(23).runs(self.words.hashes(24), at, at + window)
        first, of = grouped(one, two)
        return one[first], two[first], of, np.bincount(of, minlength=len(first)) > 1


def _bits(answers: dict[int, bytes], counts: np.ndarray) -> np.ndarray:
    """The bits of all keys of a block, in order; counts: how many keys each part was asked about."""
    parts = sorted(p for p in answers if p >= 0)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(answers[p], np.uint8), count=c).astype(bool) for p, c in zip(parts, counts.tolist(), strict=True))])


class _Note:
    """What a block tells itself for the next round: keys by part and each window's key.
    Neighbouring windows mostly have one key, so only changes are kept."""

    def __init__(self, counts: np.ndarray, of: np.ndarray, twice: np.ndarray):
        self.counts, self.of, self.twice = counts, of, twice

    def packed(self) -> bytes:
        heads = np.diff(self.of, prepend=-1) != 0
        sizes = np.array([len(self.counts), len(self.of), len(self.twice)], "<i4")
        return b"".join([sizes.tobytes(), self.counts.astype("<i4").tobytes(), self.of[heads].astype("<i4").tobytes(), np.packbits(heads).tobytes(), np.packbits(self.twice).tobytes()])

    @classmethod
    def of_packed(cls, data: bytes) -> "_Note":
        n_parts, n, n_keys = np.frombuffer(data, "<i4", 3).tolist()
        ends = len(data) - np.cumsum([0, *(-(-k // 8) for k in (n_keys, n))])
        twice, heads = (np.unpackbits(np.frombuffer(data[b:a], np.uint8), count=k).astype(bool) for a, b, k in zip(ends[:-1], ends[1:], (n_keys, n), strict=True))
        numbers = np.frombuffer(data[12 : ends[-1]], "<i4")
        return cls(numbers[:n_parts], numbers[n_parts:][np.cumsum(heads) - 1] if n else numbers[:0], twice)


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **sizes_of_blocks) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by one space) of every document.

    Removed are the words of every window that also starts elsewhere, in the same or another
    document, judged on the input. Words lie between spaces and 0x09-0x0D. Null and empty
    texts, and those shorter than a window, lose nothing (null: no words, empty kept_text);
    rows that repeat are copies of each other; an empty table gives an empty one. A very long text is
    worked on whole, with its block: memory of some 40 times its bytes. Only the two columns are read."""
    ex = Exchange(docs, doc_id, text, **sizes_of_blocks)

    def sizes(keys: np.ndarray) -> np.ndarray:
        return np.array([s.stop - s.start for _, s in ex.split(keys)], int)

    def ask(block: int, texts: pa.Array) -> pa.Table:
        b = _Block(texts, window)
        if not len(b.at):
            return questions_table([])
        keys, of, twice = b.symbols(window)
        note = (-1 - block, block, _Note(sizes(keys), of, twice).packed(), b"", b"")
        return questions_table([note, *((p, block, pack_sorted(keys[s]), b"", b"") for p, s in ex.split(keys))])

    def verify(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        if -1 - block not in answers:
            return questions_table([])
        known = _Note.of_packed(answers[-1 - block])
        chosen = (known.twice | _bits(answers, known.counts))[known.of]
        if not chosen.any():
            return questions_table([])
        one, two, _, _ = _Block(rows.column("text").combine_chunks(), window).windows(np.flatnonzero(chosen), window)
        note = (-1 - block, block, np.packbits(chosen).tobytes(), b"", b"")
        return questions_table([note, *((p, block, pack_sorted(one[s]), pack(two[s]), b"") for p, s in ex.split(one))])

    def settle(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        b = _Block(rows.column("text").combine_chunks(), window)
        gone = np.zeros(len(b.words) + 1, np.int64)
        if -1 - block in answers:
            chosen = np.flatnonzero(np.unpackbits(np.frombuffer(answers[-1 - block], np.uint8), count=len(b.at)))
            one, _, of, twice = b.windows(chosen, window)
            repeated = b.at[chosen[(twice | _bits(answers, sizes(one)))[of]]]
            gone[repeated] += 1
            gone[repeated + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(b.words.counts, pa.int64()), "n_removed": pa.array(np.bincount(b.words.text_of_word(), gone, minlength=rows.num_rows).astype(np.int64)), "kept_text": pa.array(_kept(b.words, gone), pa.string())})

    verified = ex.met(ex.answers(ex.asked(ask), _shared, _counts), verify, QUESTIONS)
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    return ex.met(ex.answers(verified, _shared, _counts), settle, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def _kept(w: Words, gone: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one space."""
    start, end, low = w.start[~gone], w.end[~gone], w.buf.copy()
    edge = np.zeros(len(low) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1  # where words touch (two texts), the two cancel
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    gaps = end[end < len(low)]
    gaps = gaps[~NOT_SPACE[low[gaps]]]
    low[gaps], keep[gaps] = 0x20, True
    at = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    data = low[keep].tobytes()
    return [data[a:b].rstrip(b" ").decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document without its repeated passages."""
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) i FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) n FROM x) WHERE n > 1),
g AS (SELECT doc_id, list(DISTINCT j) js FROM (SELECT doc_id, unnest(range(i, i + 35)) j FROM r) GROUP BY 1),
t AS (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM d),
m AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(js) j FROM g)),
kept AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY i) s FROM t LEFT JOIN m ON m.doc_id = t.doc_id AND m.j = t.i WHERE m.j IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT n_words, coalesce(len(js), 0)::BIGINT n_removed, sha256(coalesce(s, '')) kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
