"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, and a sample of all documents, whatever
they are, is the unlabelled text. A linear classifier over hashed word indicators
minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss in
mini-batches; where the bracket falls below zero the step goes the other way, as the
method has it. The class prior is the share of toxic rows among labelled ones. Scores
are shifted so that 0.7 is the cut that errs least on labelled training rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _features as X
from ._store import narrowed

#: At most about so many confirmed and unlabelled texts, and bytes of either, are learnt from.
POSITIVES, UNLABELLED, BYTES, CUT = 20_000, 40_000, 256 << 20, 0.7


def telling(n: np.ndarray, support: np.ndarray) -> np.ndarray:
    """Features that confirmed texts (class 1) have clearly more of than all texts (class 2)."""
    expected = n[1] * (support[2] + 0.5) / max(1, n[2])
    return np.flatnonzero((support[1] >= 2) & (support[1] >= 2 * expected) & (support[1] - expected >= 4 * np.sqrt(expected)))


def train(sample: X.Sample, positive: np.ndarray, prior: float, *, epochs: int = 30, batch: int = 512, rate: float = 0.5, decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights of the sample's columns and a bias. positive marks the confirmed rows; all others are unlabelled."""
    names, feature, at = sample.names, sample.column, sample.at
    if not positive.any() or positive.all():
        return np.zeros(len(names)), 0.0
    w, b, rng = np.zeros(len(names)), 0.0, np.random.default_rng(seed)
    p_rows, u_rows = np.flatnonzero(positive), np.flatnonzero(~positive)
    steps = max(1, len(u_rows) // batch)
    g2, gb2 = np.full(len(names), 1e-6), 1e-6

    def picked(rows):
        spans = [feature[at[r] : at[r + 1]] for r in rows]
        return np.repeat(np.arange(len(rows)), [len(s) for s in spans]), np.concatenate(spans) if spans else np.zeros(0, int)

    for _ in range(epochs):
        for u in np.array_split(rng.permutation(u_rows), steps):
            p = rng.choice(p_rows, min(len(p_rows), batch))
            risk, slope = {}, {}
            for name, rows in (("p", p), ("u", u)):
                i, f = picked(rows)
                s = 1 / (1 + np.exp(-np.clip(np.bincount(i, w[f], minlength=len(rows)) + b, -30, 30)))
                risk[name], d = s.mean(), s * (1 - s) / len(rows)  # risk of calling these negative, and its gradient
                slope[name] = (np.bincount(f, d[i], minlength=len(names)), d.sum())
            if risk["u"] - prior * risk["p"] >= 0:
                gw, gb = (slope["u"][k] - 2 * prior * slope["p"][k] for k in (0, 1))
            else:
                gw, gb = (prior * slope["p"][k] - slope["u"][k] for k in (0, 1))
            gw = gw + decay * w
            g2 += gw**2
            gb2 += gb**2
            w -= rate * gw / np.sqrt(g2)
            b -= rate * gb / math.sqrt(gb2)
    return np.maximum(w, 0), b  # only what the confirmed texts have more of can count as toxic


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, rest: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED, sample_bytes: int = BYTES) -> DataFrame:
    """docs with held_out, score and predicted.

    Rows of labels that share an id are one, toxic if any says so; null labels and ids are
    left out. Null and empty texts have no words and get the score of the bias. Without
    confirmed rows all scores are alike and nothing is predicted. Rows that repeat are judged
    one by one; columns of these names are replaced; an empty table gives an empty one."""
    known = labels.where(F.col(label).isNotNull() & ~X.held_out(F.col(doc_id), modulus, rest)).groupBy(F.col(doc_id).alias("of")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n, hits = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(0.9, max(1e-3, hits / n)) if n else 0.5
    open_docs = docs.where(~X.held_out(F.col(doc_id), modulus, rest)).select(F.col(doc_id).alias("of"), F.col(text).alias("text"))
    wanted = X.of_ids(known.where("y = 1"), positives).unionByName(X.of_ids(known.where("y = 0"), positives))
    # Bounded by the parameters, so it can be sent to all tasks.
    judged = open_docs.join(F.broadcast(wanted), "of").select("of", "y", "text")
    free = open_docs.select("of", F.lit(2).alias("y"), "text")
    rows = X.drawn(judged, "text", {0: (positives, sample_bytes), 1: (positives, sample_bytes)})
    # What confirmed texts have more of is told from all open documents; only the steps take a sample of them.
    features = telling(*X.supports(rows.unionByName(free), "text", "y", X.word_indicators, 3))
    sample = X.gathered(rows.unionByName(X.drawn(free, "text", {2: (unlabelled, sample_bytes)})), "text", "y", X.word_indicators, features)
    # Labelled clean rows take no part in training: they only show where the cut errs least.
    learnt = sample.label != 0
    weights, bias = train(sample.rows(learnt), sample.label[learnt] == 1, prior)
    margin, marked = sample.sums(weights) + bias, sample.label != 2
    shift = math.log(CUT / (1 - CUT)) - X.cut(margin[marked], sample.label[marked] == 1, prior)
    if not (sample.label == 1).any():
        shift = -2.0
    out = X.scored(docs.drop("held_out", "predicted"), text, X.word_indicators, sample.full(weights), bias + shift)
    return out.withColumn("held_out", X.held_out(F.col(doc_id), modulus, rest)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever their names."""
    narrow, restored = narrowed(docs, doc_id, text)
    return restored(scored(narrow, labels, doc_id=doc_id, text=text, **options).where("predicted = 0"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: the toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
