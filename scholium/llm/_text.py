"""Words of whole Arrow columns at once, as byte offsets, and hashes of them.

A batch's texts lie end to end in one UTF-8 buffer. Every word class used here
is decided by single bytes (all bytes above 0x7F count as word bytes), so words
are found by table lookups over that buffer, and the hash of any run of bytes or
words comes from prefix sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._xxh64 import xxh64

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18

_BYTES = np.arange(256)
#: Everything but space and 0x09-0x0D.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: ASCII digits and letters, and all that is not ASCII.
ALNUM = (_BYTES >= 0x80) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(x: Column) -> Column:
    """A string column with A-Z lower-cased and nothing else; ASCII strings take the short way."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWERED))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """Hashes of all runs of a sequence by prefix sums of v[i] * base**i modulo 2**64.

    Good for short runs of values that are spread themselves, like word hashes; of long runs of two
    values some collide under every base, so words are hashed by word_hashes."""

    def __init__(self, seed: int):
        self.base = int(mixed(np.array([seed * 2 + 1], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self._up[:n], self._down[:n]

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end], with equal runs hashing alike wherever they lie."""
        up, down = self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each byte range: of up to 8 bytes those bytes themselves, spread; of up to 16 their
    first and last eight; of longer ones XXH64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded, n = np.concatenate([buf, np.zeros(8, np.uint8)]), end - start
    u64 = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    head = u64[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.minimum(n, 8)).astype(np.uint64))
    tail = np.where(n > 8, u64[np.maximum(end - 8, start)], np.uint64(0))
    out = mixed(mixed(head + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) ^ (tail * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64)))
    if len(long := np.flatnonzero(n > 16)):
        out[long] = xxh64(buf, start[long], end[long], seed)
    return out


class Words:
    """The words of some texts: byte ranges in buf, and each text's range of words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = is_word[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        begins[heads] = inside[heads]  # texts touch in the buffer, words don't
        ends = np.zeros(n, bool)
        if n:
            ends[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
            ends[-1] = inside[-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int) -> np.ndarray:
        return word_hashes(self.buf, self.start, self.end, seed)

    def windows(self, length: int) -> np.ndarray:
        """First words of all windows of so many words of one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(left >= length)

    def joined(self, i: int, j: int) -> bytes:
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each text's offsets in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    buf, offsets = buffer_of(texts)
    return Words(LOWER[buf] if lower else buf, offsets, is_word)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of text each, one row at least."""
    sizes = np.diff(buffer_of(batch.column(batch.schema.get_field_index(text)))[1])
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with columns computed from whole batches; a column of the same name is replaced.

    No shuffle; memory follows one Arrow batch and one piece of it."""
    from pyspark.sql.pandas.types import to_arrow_type

    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names, types = [f.name for f in kept], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                made = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(make(piece), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *made], [*names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))
