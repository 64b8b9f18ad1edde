"""Questions of blocks of documents to partitions of a key space, and the answers.

Documents are dealt, by a key of the row, into blocks of about BLOCK_BYTES of text, so rows that
repeat spread. A block asks about its distinct 64-bit keys (or pairs of two), once each; a part of
the key space sees what all blocks ask of it and tells each how often its keys were counted; block
and answers meet in a cogroup. Keys travel packed: in order, as differences, byte by byte. The
documents' shuffle is used by all cogroups of a query, and a block's rows are always in the
order of their keys, whatever order the shuffle brings them in.

A key that is everywhere is asked once per block. So that no part sees too many blocks, at
most ``fan`` of them ask a part at once: with more, groups of ``fan`` blocks merge their
questions first, and the merged ones, of finer parts, are asked likewise. No task holds more
than ``fan`` questions of one key, and rows are at most ``fan`` parts for each block and level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, PART_BYTES, FAN = 2 << 20, 4 << 20, 8192
QUESTIONS = "part long, block long, keys binary, second binary, n binary"
ANSWERS = "block long, part long, answer binary"


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def grouped(one: np.ndarray, two: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For distinct keys (one, or one and two) in order: where each first is, and which key every element is."""
    order = np.argsort(one, kind="stable") if two is None else np.lexsort((two, one))
    a = one[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if two is not None:
        b = two[order]
        new[1:] |= b[1:] != b[:-1]
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


class _Merged:
    """The questions of some blocks to one part: distinct keys, their counts, and what each row asked."""

    def __init__(self, table: pa.Table):
        keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        one = np.concatenate(keys)
        two = np.concatenate([unpack(x) for x in table.column("second").to_pylist()])
        n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()])
        at, self.of = grouped(one, two if len(two) else None)
        self.one, self.two = one[at], two[at] if len(two) else two
        self.n = np.bincount(self.of, n if len(n) else None, minlength=len(at)).astype(np.uint64)
        self.ends = np.cumsum([len(k) for k in keys])[:-1]

    def told(self, table: pa.Table, n: np.ndarray, encode: Callable) -> pa.Table:
        """Each row's answer from the counts of the distinct keys."""
        out = [encode(x) for x in np.split(n[self.of], self.ends)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "answer": pa.array(out, pa.binary())})


class Exchange:
    """The blocks of docs (doc_id, text), and the bits of a key that tell its part."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, *, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, fan: int = FAN):
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
        self.size_up(size, max(1, -(-size // block_bytes)), part_bytes, fan)
        named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("uid"))
        self.blocks = named.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(self.n_blocks)))

    def size_up(self, size: int, n_blocks: int, part_bytes: int, fan: int) -> None:
        self.n_blocks, self.fan = n_blocks, fan
        self.fine = max(4, (size // part_bytes).bit_length())
        #: Bits at the first level: with groups of blocks, no more parts than blocks in a group.
        self.bits = self.fine if self.n_blocks <= fan else min(self.fine, max(1, fan.bit_length() - 1))

    def __getstate__(self) -> dict:
        """Tasks get the numbers alone."""
        return {"bits": self.bits, "fine": self.fine, "fan": self.fan, "n_blocks": self.n_blocks}

    def split(self, keys: np.ndarray, bits: int | None = None) -> Iterator[tuple[int, slice]]:
        """The parts of sorted keys."""
        part = keys >> np.uint64(64 - (bits or self.bits))
        heads = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63)))
        for a, b in zip(heads, [*heads[1:], len(keys)] if len(keys) else [], strict=True):
            yield int(part[a]), slice(a, b)

    def asked(self, ask: Callable[[int, pa.Array], pa.Table]) -> DataFrame:
        return self.blocks.groupBy("block").applyInArrow(lambda key, table: ask(key[0].as_py(), table.sort_by("uid").column("text").combine_chunks()), QUESTIONS)

    def answers(self, questions: DataFrame, encode: Callable[[np.ndarray], bytes], decode: Callable[[bytes, int], np.ndarray]) -> DataFrame:
        """What the parts tell each block: encode gets the counts of its keys, over all blocks. A
        negative part's questions are notes of a block to itself and come back as they are."""
        return self._level(questions, self.n_blocks, self.bits, encode, decode)

    def _level(self, questions: DataFrame, n: int, bits: int, encode: Callable, decode: Callable) -> DataFrame:
        def notes(table: pa.Table) -> pa.Table:
            return pa.table({"block": table.column("block"), "part": table.column("part"), "answer": table.column("keys")})

        def settled(table: pa.Table) -> pa.Table:
            if table.column("part")[0].as_py() < 0:
                return notes(table)
            m = _Merged(table)
            return m.told(table, m.n, encode)

        if n <= self.fan:
            return questions.groupBy("part").applyInArrow(settled, ANSWERS)

        groups, finer = -(-n // self.fan), self.fine if -(-n // self.fan) <= self.fan else min(self.fine, bits + max(1, self.fan.bit_length() - 1))
        dealt = questions.withColumn("asker", F.when(F.col("part") < 0, F.lit(-1)).otherwise(F.floor(F.pmod("block", F.lit(n)) / self.fan) + F.col("part") * groups))

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            if key[0].as_py() < 0:
                return questions_table([])
            m = _Merged(table)
            return questions_table([(p, key[0].as_py(), pack_sorted(m.one[s]), pack(m.two[s]) if len(m.two) else b"", pack(m.n[s])) for p, s in self.split(m.one, finer)])

        def down(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
            if not table.num_rows or table.column("part")[0].as_py() < 0:
                return notes(table)
            m, known = _Merged(table), dict(zip(right.column("part").to_pylist(), right.column("answer").to_pylist(), strict=True))
            return m.told(table, np.concatenate([decode(known[p], s.stop - s.start) for p, s in self.split(m.one, finer)]), encode)

        # Notes stay with their block; other questions go by group and part.
        dealt = dealt.withColumn("own", F.when(F.col("part") < 0, F.col("block")).otherwise(F.lit(-1).cast("long")))
        above = self._level(dealt.groupBy("asker", "own").applyInArrow(merge, QUESTIONS), groups, finer, encode, decode)
        told = above.select(F.col("block").alias("asker"), F.lit(-1).cast("long").alias("own"), "part", "answer")
        return dealt.groupBy("asker", "own").cogroup(told.groupBy("asker", "own")).applyInArrow(down, ANSWERS)

    def met(self, answers: DataFrame, settle: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
        """settle: gets a block, its rows and the answers by part."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return settle(key[0].as_py(), left.sort_by("uid") if "uid" in left.column_names else left, dict(zip(right.column("part").to_pylist(), right.column("answer").to_pylist(), strict=True)))

        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def questions_table(rows: list[tuple[int, int, bytes, bytes, bytes]]) -> pa.Table:
    part, block, *packed = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    names = ("keys", "second", "n")
    return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array(block, pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in zip(names, packed, strict=True)})
