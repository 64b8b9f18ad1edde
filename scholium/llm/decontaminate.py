"""Benchmark decontamination: windows of normalised words, looked up in a broadcast set.

The benchmark's windows of 13 words form a hash set that every task holds; texts
are scanned once, and each hash hit is verified against the window's words, without a
shuffle. The set is broadcast only for a benchmark of at most ``block_bytes`` of text. A larger
one stays a table, of which a bitmap of 2**``bitmap_bits`` bits (32 MB) is broadcast: the scan
passes on the windows that the bitmap knows, they are joined with the table by hash, and
matches are verified in the texts. So there is one scan and one broadcast of a fixed size, however
large the benchmark; as the bitmap fills, more windows are shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Carried, narrowed, written
from ._text import ALNUM, RollingHash, pieces, with_columns, words_of

WINDOW = 13
#: Of benchmark text in a broadcast set; its hash table takes about 20 times as much.
BLOCK_BYTES, BITMAP_BITS = 4 << 20, 28
_SEEN_BITS = 20

_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_runs", _RUNS), T.StructField("hit_items", T.ArrayType(T.StringType()))]


class WindowSet:
    """Windows of items: by length, the hashes; by words, the items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        hasher, found = RollingHash(5), defaultdict(list)
        for name, text in items:
            w = words_of(pa.array([text], pa.string()), ALNUM, lower=True)
            length = min(window, len(w))
            if length:
                at = w.windows(length)
                found[length].append(hasher.runs(w.hashes(5), at, at + length))
                for i in at:
                    self.items[w.joined(i, i + length)].add(name)
        self.hashes = {k: np.unique(np.concatenate(v)) for k, v in found.items()}
        self.seen = {k: np.zeros(1 << _SEEN_BITS, bool) for k in found}
        for k, h in self.hashes.items():
            self.seen[k][h >> np.uint64(64 - _SEEN_BITS)] = True

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, set[str]]]]:
        """Word counts, and (text, first word, end, items) of every occurring window."""
        hasher = _hasher()
        w = words_of(texts, ALNUM, lower=True)
        h, at_text, hits = w.hashes(5), w.text_of_word(), []
        for length, known in self.hashes.items():
            at = w.windows(length)
            runs = hasher.runs(h, at, at + length)
            near = self.seen[length][runs >> np.uint64(64 - _SEEN_BITS)]
            at, runs = at[near], runs[near]
            at = at[known[np.minimum(np.searchsorted(known, runs), len(known) - 1)] == runs]
            for i in at.tolist():
                if names := self.items.get(w.joined(i, i + length)):
                    k = int(at_text[i])
                    begin = i - int(w.first[k])
                    hits.append((k, begin, begin + length, names))
        return w.counts, hits


_HASHER: list[RollingHash] = []


def _hasher() -> RollingHash:
    """One for all calls in a process: it keeps its powers."""
    if not _HASHER:
        _HASHER.append(RollingHash(5))
    return _HASHER[0]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """docs with n_words, hit_runs (ranges of words inside occurring windows, ends exclusive,
    disjoint and in order) and hit_items (ids as strings, distinct, sorted).

    Words: lower-cased ASCII letters, digits and all non-ASCII characters. An item
    shorter than a window, but not empty, is one window. Null or wordless texts have
    no words and no hits; an empty benchmark hits nothing; a null item id reads as
    the empty string; repeated rows are judged one by one; columns of the three names
    are replaced, all others are kept. A very long text is scanned whole, in memory of some 20 times its bytes."""
    docs = docs.drop(*(f.name for f in _FIELDS))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > block_bytes:
        return _joined(docs, items, text, window, bitmap_bits)
    held = docs.sparkSession.sparkContext.broadcast(Carried(WindowSet([(r.item, r.text) for r in items.collect()], window)))

    def make(batch: pa.RecordBatch) -> list:
        return _found(*held.value.scan(batch.column(batch.schema.get_field_index(text))))

    return with_columns(docs, text, _FIELDS, make)


def _found(counts: np.ndarray, hits: list[tuple[int, int, int, set[str]]]) -> list:
    """The columns of _FIELDS from word counts and (text, first word, end, items) of every hit."""
    runs: list[list] = [[] for _ in counts]
    names: list[set] = [set() for _ in counts]
    for i, s, e, ids in hits:
        runs[i].append((s, e))
        names[i] |= ids
    return [pa.array(counts, pa.int64()), [[{"start": s, "end": e} for s, e in merged(x)] for x in runs], [sorted(x) for x in names]]


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(length, h, words, items) of every distinct window of items(item, text)."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words_of(pa.array([text.as_py()], pa.string()), ALNUM, lower=True)
                if length := min(window, len(w)):
                    at = w.windows(length)
                    h = _hasher().runs(w.hashes(5), at, at + length).view(np.int64)
                    out += [(length, x, w.joined(i, i + length), name) for i, x in zip(at.tolist(), h.tolist(), strict=True)]
            length, h, words, name = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(h, pa.int64()), pa.array(words, pa.binary()), pa.array(name, pa.string())], ["length", "h", "words", "item"])

    return items.mapInArrow(run, "length int, h long, words binary, item string").groupBy("length", "h", "words").agg(F.collect_set("item").alias("items"))


def _joined(docs: DataFrame, items: DataFrame, text: str, window: int, bits: int) -> DataFrame:
    """find() for a benchmark of any size. docs are written once, with a key for each row."""
    spark, rest = docs.sparkSession, [c for c in docs.columns if c != text]
    keyed = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"), F.struct(F.lit(True).alias("c"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("rest")), "decontamination-documents")
    known = written(_item_windows(items, window), "benchmark-windows")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most as many as a window has words
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    found = known.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    bitmap = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for bucket, data in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bitmap[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(data, np.uint8)
    held = spark.sparkContext.broadcast(bitmap)

    def near(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = words_of(piece.column(1), ALNUM, lower=True)
                h, of, uid = w.hashes(5), w.text_of_word(), piece.column(0).to_numpy()
                for length in lengths:
                    at = w.windows(length)
                    runs = _hasher().runs(h, at, at + length)
                    p = (runs >> np.uint64(64 - bits)).astype(np.int64)
                    on = (held.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
                    at, runs = at[on], runs[on]
                    yield pa.RecordBatch.from_arrays([pa.array(uid[of[at]]), pa.array((at - w.first[of[at]]).astype(np.int64)), pa.array(np.full(len(at), length, np.int32)), pa.array(runs.view(np.int64))], ["uid", "first", "length", "h"])

    hits = keyed.select("uid", "text").mapInArrow(near, "uid long, first long, length int, h long").join(known, ["length", "h"])
    by_row = hits.groupBy("uid").agg(F.collect_list(F.struct("first", "length", "words", "items")).alias("hits"))

    def verified(batch: pa.RecordBatch) -> list:
        w = words_of(batch.column(batch.schema.get_field_index("text")), ALNUM, lower=True)
        out = []
        for i, row in enumerate(batch.column(batch.schema.get_field_index("hits")).to_pylist()):
            for x in row or []:
                at = int(w.first[i]) + x["first"]
                if w.joined(at, at + x["length"]) == x["words"]:
                    out.append((i, x["first"], x["first"] + x["length"], set(x["items"])))
        return _found(w.counts, out)

    made = with_columns(keyed.join(by_row, "uid", "left"), "text", _FIELDS, verified)
    place_of = {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)} | {text: F.col("text")}
    return made.select(*(place_of[c].alias(c) for c in docs.columns), *(f.name for f in _FIELDS))


def judged(found: DataFrame) -> DataFrame:
    """found with n_hit and contaminated: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names."""
    narrow, restored = narrowed(docs, text)
    return restored(judged(find(narrow, benchmark, text=text, **options)).where(~F.col("contaminated")))


def without_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs whose texts lack the words of every hit run and what lies between them."""

    def make(batch: pa.RecordBatch) -> list:
        texts = batch.column(batch.schema.get_field_index(text))
        w = words_of(texts, ALNUM)
        out = []
        for i, (t, runs) in enumerate(zip(texts.to_pylist(), batch.column("hit_runs").to_pylist(), strict=True)):
            if runs:
                raw, base, first, at, kept = t.encode(), int(w.offsets[i]), int(w.first[i]), 0, []
                for r in runs:
                    kept.append(raw[at : int(w.start[first + r["start"]]) - base])
                    at = int(w.end[first + r["end"] - 1]) - base
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        return [pa.array(out, pa.string())]

    narrow, restored = narrowed(docs, text)
    found = find(narrow, benchmark, text=text, **options)
    return restored(with_columns(found, text, [T.StructField(text, T.StringType())], make))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    items = F.col("hit_items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) n FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM bl)),
dx AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, (SELECT DISTINCT n FROM bx) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dx.n, item_id FROM dx JOIN bx ON dx.k = bx.k AND dx.n = bx.n),
words AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM hit) GROUP BY 1),
names AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR s FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""
