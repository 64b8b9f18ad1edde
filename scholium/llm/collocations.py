"""Phrases whose words stand together more often than their parts foretell.

Texts are cut into pieces at punctuation and equal pieces of a language are kept once, with their
multiplicity, packed in blocks. Blocks of pieces ask the parts of a hashed key space how often their words and pairs
occur, then how often those longer phrases do of which every pair is frequent; answers are one bit
a key. So blocks know which phrases can be frequent, and send those alone, as text with their weights, to hash
buckets, where duckdb sums them, on disk if need be. These sums are exact; hashes only ever let too
much through. Candidates look up the counts of their parts, and of longer phrases, by shuffled joins.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._exchange import BLOCK_BYTES, FAN, PART_BYTES, Exchange, grouped, pack, pack_sorted, questions_table, unpack
from ._store import removed, written
from ._text import RollingHash, Words, buffer_of, lowered, mixed, word_hashes
from ._text import pieces as slices

LONGEST, LEAST, COVER, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Of duckdb in a task, before it works on disk.
MEMORY_MB, MOST_BUCKETS = 192, 8192
BATCH = 500_000
_WORD = ~np.isin(np.arange(256), [0x20, 0x09])
_KEPT: list[RollingHash] = []


def pieces(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, times): every distinct piece of a language and how often it occurs. Its words are
    joined by one space. Pieces without words are left out."""
    tongue = F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))
    cut = docs.select(tongue.alias("lang"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[.,;:!?\x0A-\x0D]+")).alias("piece"))
    piece = lowered(F.btrim("piece", F.lit(" \t")))
    wide = F.col("piece").contains("\t") | F.col("piece").contains("  ")
    one = F.when(wide, F.regexp_replace("piece", "[ \\t]+", " ")).otherwise(F.col("piece"))
    return cut.select("lang", piece.alias("piece")).where("piece <> ''").select("lang", one.alias("piece")).groupBy("lang", "piece").agg(F.count("*").alias("times"))


PACKED = "block long, size long, langs array<string>, ends array<int>, pieces binary, sizes binary, times binary"


def packed(pieces: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """pieces(lang, piece, times), as a row for about every block_bytes of text: languages in order, up to which
    piece each goes, the texts end to end, their sizes and multiplicities."""

    def row(parts: list[pa.Table]) -> dict:
        table = pa.concat_tables(parts).combine_chunks().sort_by("lang")
        buf, offsets = buffer_of(table.column("piece"))
        langs = table.column("lang").to_pylist()
        heads = [i for i, x in enumerate(langs) if not i or x != langs[i - 1]]
        return {"size": len(buf), "langs": [langs[i] for i in heads], "ends": [*heads[1:], len(langs)], "pieces": buf.tobytes(), "sizes": np.diff(offsets).astype("<u4").tobytes(), "times": pack(table.column("times").to_numpy().astype(np.uint64))}

    kind = pa.schema([("size", pa.int64()), ("langs", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("pieces", "sizes", "times"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for batch in batches:
            for piece in slices(batch, "piece", block_bytes):
                parts.append(pa.Table.from_batches([piece]))
                total += parts[-1].column("piece").nbytes
                if total >= block_bytes:
                    yield pa.RecordBatch.from_pylist([row(parts)], kind)
                    parts, total = [], 0
        if parts:
            yield pa.RecordBatch.from_pylist([row(parts)], kind)

    made = pieces.select("lang", "piece", "times").mapInArrow(run, PACKED.split(", ", 1)[1])
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


class _Phrases:
    """The pieces of a block: of each length the first words and hashes of all phrases, and the pieces' weights."""

    def __init__(self, table: pa.Table):
        row = {c: table.column(c)[0] for c in table.column_names}
        if not _KEPT:
            _KEPT.append(RollingHash(12))
        self.times = unpack(row["times"].as_py())
        self.langs = row["langs"].as_py()
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"].as_py(), "<u4"), dtype=np.int64)])
        self.words = w = Words(np.frombuffer(row["pieces"].as_py(), np.uint8), offsets, _WORD)
        self.of = w.text_of_word()
        #: Each piece's language, by its place among the block's.
        self.tongue = np.repeat(np.arange(len(self.langs)), np.diff(row["ends"].as_py(), prepend=0))
        names, at = buffer_of(pa.array(self.langs, pa.string()))
        self.h = mixed(w.hashes(12) ^ mixed(word_hashes(names, at[:-1], at[1:], 13))[self.tongue[self.of]])

    def of_length(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the phrases of k words."""
        if k == 1:
            return np.arange(len(self.words)), self.h
        at = self.words.windows(k)
        return at, _KEPT[0].runs(self.h, at, at + k)

    def questions(self, block: int, at: np.ndarray, hashes: np.ndarray, ex: Exchange) -> list[tuple]:
        first, of = grouped(hashes, None)
        n = np.zeros(len(first), np.uint64)
        np.add.at(n, of, self.times[self.of[at]])
        keys = hashes[first]
        return [(p, block, pack_sorted(keys[s]), b"", pack(n[s])) for p, s in ex.split(keys)]


def _told(hashes: np.ndarray, answers: dict[int, bytes], ex: Exchange) -> np.ndarray:
    """Which of the phrases are frequent, from the parts' answers about their distinct hashes."""
    first, of = grouped(hashes, None)
    bits = [_bits(answers[p], s.stop - s.start) for p, s in ex.split(hashes[first])]
    return np.concatenate([np.zeros(0, bool), *bits])[of]


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _chained(good: np.ndarray, at: np.ndarray, pair_at: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of phrases of k words that begin at ``at``: those whose pairs are all good."""
    pair = np.zeros(n + 1, bool)
    pair[pair_at] = good
    out = np.ones(len(at), bool)
    for i in range(k - 1):
        out &= pair[at + i]
    return out


class Blocks(Exchange):
    """Blocks that are packed already."""

    def __init__(self, blocks: DataFrame, *, part_bytes: int = PART_BYTES, fan: int = FAN):
        size, n = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        self.size_up(size, max(1, n), part_bytes, fan)
        self.blocks = blocks


def counts(blocks: DataFrame, *, least: int = LEAST, longest: int = LONGEST, memory_mb: int = MEMORY_MB, **sizes) -> DataFrame:
    """(lang, phrase, words, n) of every phrase of up to ``longest`` words that occurs at least so often in the blocks of packed().

    Counts are exact 64-bit sums; an empty table gives an empty one; a very long piece is worked
    on whole, with its block. Memory follows a block and duckdb's bound."""
    ex = Blocks(blocks, **sizes)
    buckets = min(1 << ex.fine, MOST_BUCKETS)

    def frequent(n: np.ndarray) -> bytes:
        return np.packbits(n >= least).tobytes()

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        p = _Phrases(table)
        (a, h), (b, g) = p.of_length(1), p.of_length(2)
        return questions_table(p.questions(key[0].as_py(), np.concatenate([a, b]), np.concatenate([h, g]), ex))

    def longer(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        p = _Phrases(rows)
        (a, h), (b, g) = p.of_length(1), p.of_length(2)
        good = _told(np.concatenate([h, g]), answers, ex)
        found = []
        for k in range(3, longest + 1):
            at, hashes = p.of_length(k)
            on = _chained(good[len(a) :], at, b, len(p.words), k)
            found.append((at[on], hashes[on]))
        note = (-1 - block, block, np.packbits(good).tobytes(), b"", b"")
        if not found:
            return questions_table([note])
        return questions_table([note, *p.questions(block, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), ex)])

    def sent(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        p = _Phrases(rows)
        (a, h), (b, g) = p.of_length(1), p.of_length(2)
        good = _bits(answers.pop(-1 - block), len(a) + len(b))
        chosen, hashes = [(a[good[: len(a)]], 1), (b[good[len(a) :]], 2)], []
        for k in range(3, longest + 1):
            at, x = p.of_length(k)
            on = _chained(good[len(a) :], at, b, len(p.words), k)
            chosen.append((at[on], k))
            hashes.append(x[on])
        if hashes:
            told = np.split(_told(np.concatenate(hashes), answers, ex), np.cumsum([len(x) for x in hashes])[:-1])
            chosen[2:] = [(at[t], k) for (at, k), t in zip(chosen[2:], told, strict=True)]
        return _spelt(p, chosen, buckets)

    def level(questions: DataFrame) -> DataFrame:
        return ex.answers(questions, frequent, lambda data, n: _bits(data, n).astype(np.uint64) * np.uint64(least))

    pairs = level(ex.blocks.groupBy("block").applyInArrow(asked, "part long, block long, keys binary, second binary, n binary"))
    every = level(ex.met(pairs, longer, "part long, block long, keys binary, second binary, n binary"))
    texts = ex.met(every, sent, "bucket int, lang string, phrases binary, sizes binary, n binary")
    return texts.repartition(buckets, "bucket").mapInArrow(lambda batches: _summed(batches, least, memory_mb), "lang string, phrase string, words int, n long")


def _spelt(p: _Phrases, chosen: list[tuple[np.ndarray, int]], buckets: int) -> pa.Table:
    """The distinct phrases chosen, as text in order with their weights; a row for each bucket and language."""
    heads, tails, sums, keys = [], [], [], []
    for at, k in chosen:
        every, hashes = p.of_length(k)
        own = hashes[np.searchsorted(every, at)]
        first, of = grouped(own, None)
        n = np.zeros(len(first), np.uint64)
        np.add.at(n, of, p.times[p.of[at]])
        for out, x in ((heads, at[first]), (tails, at[first] + k - 1), (sums, n), (keys, own[first])):
            out.append(x)
    head, tail, n, key = (np.concatenate(x) for x in (heads, tails, sums, keys))
    begin, size = p.words.start[head], p.words.end[tail] - p.words.start[head]
    ends = np.cumsum(size)
    data = p.words.buf[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    phrases = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i8")), pa.py_buffer(data)])
    tongues = p.langs
    group = (key % np.uint64(buckets)).astype(np.int64) * len(tongues) + p.tongue[p.of[head]]
    order = pa.compute.sort_indices(pa.table({"group": group, "phrase": phrases}), [("group", "ascending"), ("phrase", "ascending")]).to_numpy()
    told, size, n, group = phrases.take(pa.array(order)), size[order].astype("<u4"), n[order], group[order]
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    raw = memoryview(told.buffers()[2]) if len(told) else b""
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    rows = [(int(group[a]) // len(tongues), tongues[group[a] % len(tongues)], bytes(raw[at[a] : at[b]]), size[a:b].tobytes(), pack(n[a:b])) for a, b in zip(cuts, [*cuts[1:], len(group)] if len(cuts) else [], strict=True)]
    names, kinds = ("bucket", "lang", "phrases", "sizes", "n"), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})


def _phrases_of(batches) -> Iterator[pa.Table]:
    """(lang, phrase, n) from rows of _spelt, in tables of BATCH phrases or more."""
    parts, total = [], 0
    for batch in batches:
        for lang, phrases, sizes, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrases", "sizes", "n")), strict=True):
            at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)])
            said = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(phrases)])
            parts.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(said)), "phrase": said, "n": pa.array(unpack(n))}))
            total += len(said)
            if total >= BATCH:
                yield pa.concat_tables(parts)
                parts, total = [], 0
    if parts:
        yield pa.concat_tables(parts)


def _summed(batches, least: int, memory_mb: int) -> Iterator[pa.RecordBatch]:
    """Sums of all phrases that come to this task, in duckdb, which works in the task's own folder beyond its memory."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder, duckdb.connect(os.path.join(folder, "phrases"), config={"memory_limit": f"{memory_mb}MB", "threads": 1, "temp_directory": os.path.join(folder, "spill"), "preserve_insertion_order": "false"}) as db:
        db.execute("CREATE TABLE t (lang VARCHAR, phrase VARCHAR, n UBIGINT)")
        for rows in _phrases_of(batches):  # noqa: B007  (duckdb finds rows by its name)
            db.execute("INSERT INTO t SELECT * FROM rows")
        found = db.sql(f"SELECT lang, phrase, (len(phrase) - len(replace(phrase, ' ', '')) + 1)::INTEGER words, sum(n)::BIGINT n FROM t GROUP BY lang, phrase HAVING sum(n) >= {least}").to_arrow_reader(100_000)
        for batch in found:
            yield batch.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]))


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(20,0)")


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of two words or more of counts(), by its lowest-scoring cut:
    ties go to the shortest first part. Each cut asks for its parts' counts at their hash."""
    long = counted.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("of"))
    cuts = long.select("lang", "phrase", "words", "a", "of", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    asks = cuts.select("lang", "phrase", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.concat_ws(" ", F.slice("of", F.lit(1), F.col("k"))).alias("part")),
        F.struct(F.lit(1).alias("side"), F.concat_ws(" ", F.slice("of", F.col("k") + 1, F.col("words") - F.col("k"))).alias("part")))).alias("ask"))
    asks = asks.select("lang", "phrase", "words", "a", "k", "ask.side", "ask.part")
    told = asks.join(counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    both = told.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(least).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, *, cover: int = COVER) -> DataFrame:
    """The candidates that no longer one holds whose count is at least cover % of theirs."""
    inside = candidates.where("words > 2").select("lang", "a", "words", F.split("phrase", " ").alias("of"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inside = inside.select("lang", "a", "of", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("i"))
    most = inside.groupBy("lang", F.concat_ws(" ", F.slice("of", F.col("i"), F.col("k"))).alias("phrase")).agg(F.max("a").alias("most"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (_exact("most") * 100 < _exact("a") * cover)).drop("most")


def _sizes(blocks: DataFrame) -> DataFrame:
    """(lang, n): how many words each language has."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p = _Phrases(pa.Table.from_batches([batch.slice(i, 1)]))
                n = np.zeros(len(p.langs), np.uint64)
                np.add.at(n, p.tongue, p.times * p.words.counts.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(p.langs, pa.string()), pa.array(n.astype(np.int64))], ["lang", "n"])

    return blocks.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def mined(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a (its count), l and r (its parts' counts), n (all words of the
    language) and score, floor(2000000 a / (l + r)) of its lowest cut.

    A null language is ``und``; a null or wordless text has no pieces; rows that repeat count each; ties of score
    and count go by the phrase's bytes; an empty table gives an empty one. Very long texts are cut in Spark; a very long
    piece is one row. Only the two columns are read."""
    blocks = written(packed(pieces(docs, text=text, lang=lang), block_bytes), "phrase-blocks", compression="zstd")
    sizes = written(_sizes(blocks), "phrase-sizes")
    counted = written(counts(blocks, least=least, longest=longest, **options), "phrase-counts")
    removed(blocks)
    best = uncovered(scored(counted), cover=cover)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within 64 shares of a language, so no task gets all of it.
    share = Window.partitionBy("lang", "share").orderBy(*order)
    few = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Contract query: the first 2,000 collocations of each language of all documents."""
    return mined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws FROM p),
z AS (SELECT lang, sum(len(ws))::BIGINT n FROM w GROUP BY 1),
i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) i FROM w, (SELECT unnest([1, 2, 3, 4]) k) WHERE len(ws) >= k),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase FROM i),
f AS (SELECT lang, k, phrase, count(*) n FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k words, n a, string_split(phrase, ' ') ws FROM f WHERE k > 1),
u AS (SELECT lang, phrase, words, a, k, array_to_string(ws[1:k], ' ') one, array_to_string(ws[k + 1:], ' ') two FROM c, (SELECT unnest([1, 2, 3]) k) WHERE k < words),
s AS (SELECT u.lang, u.phrase, u.words, a, x.n l, y.n r, u.k, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = one JOIN f y ON y.lang = u.lang AND y.phrase = two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') phrase, max(a) most FROM c, (SELECT unnest([2, 3]) k), (SELECT unnest([1, 2, 3]) i) WHERE k < words AND i + k - 1 <= words GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, z.n, score FROM o JOIN z USING (lang) QUALIFY rank <= 2000
"""
