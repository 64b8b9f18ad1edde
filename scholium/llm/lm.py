"""Stupid-backoff language-model scores from counts over all documents.

The count table of n-grams up to ``order`` words is partitioned by hash: every block of documents
sends its distinct n-grams, each with its count in the block, to their parts of the table, which sum
them; each block's n-grams are joined to their counts, and the words' scores are summed per
document. A word w after its context v (the order - 1 words before it) scores count(v w) / count(v) if
that n-gram occurs, else ALPHA times its score after the context without its first word; alone
it scores count(w) / N.

The documents scored are those counted, so every n-gram of theirs occurs at least once: where it
stands. What is scored is therefore left out of the counts (``own`` = 1 of each, the leaving-one-out
estimate); with ``own`` = 0 nothing is, and no score ever backs off. A word that occurs nowhere
else counts as one of N.

Order 2 is the default: each further order adds a distinct n-gram for nearly every word of a
text to what is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import Exchange, grouped, pack, pack_sorted, questions_table, unpack
from ._text import LOWER, NOT_SPACE, RollingHash, Words, buffer_of
from .mixing import n_words

ALPHA, ORDER, OWN = 0.4, 2, 1
_KEPT: list[RollingHash] = []


class _Grams:
    """The words of some texts, and of each length the n-grams: first words and hashes, words' own for one."""

    def __init__(self, texts: pa.Array, order: int):
        if not _KEPT:
            _KEPT.append(RollingHash(4))
        buf, offsets = buffer_of(texts)
        self.words = w = Words(LOWER[buf], offsets, NOT_SPACE)
        h = w.hashes(4)
        self.at = [np.arange(len(w)), *(w.windows(k) for k in range(2, order + 1))]
        self.hashes = [h, *(_KEPT[0].runs(h, at, at + k) for k, at in enumerate(self.at[1:], 2))]


def scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, order: int = ORDER, own: int = OWN, **sizes_of_blocks) -> DataFrame:
    """doc_id, n_words and log_score, the sum of the words' log10 scores, of every document.

    Words lie between spaces and 0x09-0x0D, A-Z lower-cased; the first words of a text are
    scored after what context they have. A null or wordless text has no words and score 0; rows that repeat
    count and are scored each; an empty table gives an empty one. A very long text is worked on whole, with
    its block: memory of some 30 times its bytes. n-grams are told apart by 64 bits of hash. Only the two columns are read."""
    total = docs.agg(F.coalesce(F.sum(n_words(text)), F.lit(0))).first()[0]
    ex = Exchange(docs, doc_id, text, **sizes_of_blocks)

    def ask(block: int, texts: pa.Array) -> pa.Table:
        keys, n = np.unique(np.concatenate(_Grams(texts, order).hashes), return_counts=True)
        return questions_table([(p, block, pack_sorted(keys[s]), b"", pack(n[s])) for p, s in ex.split(keys)])

    def settle(block: int, rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        g = _Grams(rows.column("text").combine_chunks(), order)
        every = np.concatenate(g.hashes)
        at, of = grouped(every, None)
        n = np.concatenate([np.zeros(0, np.uint64), *(unpack(answers[p]) for p, _ in ex.split(every[at]))]).astype(float) - own
        counts = np.split(n[of], np.cumsum([len(h) for h in g.hashes])[:-1])
        score = np.log10(np.maximum(counts[0], 1) / max(total - own, 1))
        context = counts[0]  # of the shorter n-gram that starts at each word
        for k in range(2, order + 1):
            first, c = g.at[k - 1], counts[k - 1]
            last, seen = first + k - 1, c > 0
            score[last] = np.where(seen, np.log10(np.maximum(c, 1) / np.maximum(context[first], 1)), np.log10(alpha) + score[last])
            context = np.zeros(len(g.words))
            context[first] = c
        sums = np.bincount(g.words.text_of_word(), score, minlength=rows.num_rows)
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(g.words.counts, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    return ex.met(ex.answers(ex.asked(ask), pack, lambda data, n: unpack(data)), settle, f"doc_id {kind}, n_words long, log_score double")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract-free query: every document's score and its mean per word."""
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.greatest("n_words", F.lit(1)), 6).alias("per_word"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
t AS (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM d),
p AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) v FROM t),
c1 AS (SELECT w, count(*) - 1 n FROM t GROUP BY 1),
c2 AS (SELECT v, w, count(*) - 1 n FROM p WHERE v IS NOT NULL GROUP BY 1, 2),
s AS (SELECT doc_id, CASE WHEN c2.n > 0 THEN log10(c2.n / b.n) ELSE log10(greatest(a.n, 1) / (SELECT count(*) - 1 FROM t)) + CASE WHEN p.v IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END END x
  FROM p JOIN c1 a ON a.w = p.w LEFT JOIN c1 b ON b.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w),
z AS (SELECT doc_id, sum(x) x FROM s GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, round(coalesce(x, 0), 4) log_score, round(coalesce(x, 0) / greatest(len(ws), 1), 6) per_word FROM d LEFT JOIN z USING (doc_id)
"""
