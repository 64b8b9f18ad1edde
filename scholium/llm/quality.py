"""Quality by naive Bayes support vectors.

Indicators of word and shape n-grams are scaled by their class log-count ratios, and a
linear model with the hinge loss is fitted to them by dual coordinate descent. The fit
takes a bounded sample of labelled rows; every document is then scored in one scan. Scores
are shifted so that 0.3 is the cut that errs least on the training rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _features as X

#: At most about so many labelled texts, and bytes of them, of each class are learnt from.
PER_CLASS, BYTES, CUT = 8_000, 32 << 20, 0.3


def log_count_ratios(sample: X.Sample, good: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = sample.support(good) + alpha, sample.support(~good) + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(sample: X.Sample, values: np.ndarray, y: np.ndarray, *, c: float = 1.0, epochs: int = 20, seed: int = 1, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """w and b of the least w.w/2 + c * sum of hinge losses, where row i has values[f] at its features f.

    Each step solves for one dual variable in [0, c] exactly; it ends when no variable's
    projected gradient exceeds tolerance."""
    w, b, a = np.zeros(len(sample.names)), 0.0, np.zeros(len(sample))
    rng, at, feature = np.random.default_rng(seed), sample.at, sample.column
    square = np.bincount(sample.text(), values[feature] ** 2, minlength=len(sample)) + 1.0
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(sample)):
            f = feature[at[i] : at[i + 1]]
            x = values[f]
            g = y[i] * (w[f] @ x + b) - 1
            if (a[i] <= 0 and g >= 0) or (a[i] >= c and g <= 0):
                continue
            most = max(most, abs(g))
            new = min(max(a[i] - g / square[i], 0.0), c)
            step = (new - a[i]) * y[i]
            a[i] = new
            w[f] += step * x
            b += step
        if most < tolerance:
            break
    return w, b


def train(sample: X.Sample, *, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of the sample's columns and a bias, on scaled indicators of mean square length 1."""
    good = sample.label == 1
    if good.all() or not good.any():
        return np.zeros(len(sample.names)), 0.0
    ratios = log_count_ratios(sample, good)
    ratios = ratios / math.sqrt(max(1e-9, np.bincount(sample.text(), ratios[sample.column] ** 2, minlength=len(sample)).mean()))
    w, b = dual_coordinate_descent(sample, ratios, np.where(good, 1.0, -1.0), c=c)
    return w * ratios, b


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 5, rest: int = 0, per_class: int = PER_CLASS, class_bytes: int = BYTES) -> DataFrame:
    """docs with held_out, score and predicted.

    Rows of labels that share an id are one, good if all say so; null labels and ids are
    left out. Null and empty texts have no n-grams but their length. Without labels of both
    classes all scores are alike. Rows that repeat are judged one by one; columns of these
    names are replaced; an empty table gives an empty one. A very long text is scored whole, in memory of some
    60 times its bytes. The driver gets the indicators of per_class texts, or class_bytes of text, of each class."""
    known = labels.where(F.col(label).isNotNull() & ~X.held_out(F.col(doc_id), modulus, rest)).groupBy(F.col(doc_id).alias("of")).agg(F.min(F.col(label).cast("int")).alias("y"))
    wanted = X.of_ids(known.where("y = 1"), per_class).unionByName(X.of_ids(known.where("y = 0"), per_class))
    # Bounded by the parameter, so it can be sent to all tasks.
    judged = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(wanted), "of")
    judged = X.drawn(judged, "text", {0: (per_class, class_bytes), 1: (per_class, class_bytes)})
    _, support = X.supports(judged, "text", "y", X.quality_indicators, 2)
    sample = X.gathered(judged, "text", "y", X.quality_indicators, np.flatnonzero(support.sum(axis=0)))
    weights, bias = train(sample)
    shift = math.log(CUT / (1 - CUT)) - X.cut(sample.sums(weights) + bias, sample.label == 1)
    out = X.scored(docs.drop("held_out", "predicted"), text, X.quality_indicators, sample.full(weights), bias + shift)
    return out.withColumn("held_out", X.held_out(F.col(doc_id), modulus, rest)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: the quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
