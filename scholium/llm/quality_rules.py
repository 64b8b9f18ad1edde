"""Quality rules by weak supervision: rules vote or abstain, and a posterior decides.

Eight rules look at a text's counts and vote good, bad or nothing. How often they vote
together, over all documents that the base rules leave, tells how accurate each is: expectation-maximisation on the
table of vote patterns (at most 3**8 rows, counted in Spark) fits a model in which rules err
independently given the quality. A document is kept if its posterior of being good reaches
``least``. All work on texts is SQL expressions in one scan; the counts are written once
and read for the patterns and for the verdicts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written
from .mixing import SPACES

WINDOW, HELD = 5, 0.5
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
#: Rules by name: the ratio they look at, the value above which they vote bad, and that up to which they vote good.
RULES = {
    "symbols": (lambda c: c["n_symbols"] / c["n_words"], 0.1, 0.02),
    "repeats": (lambda c: c["n_repeat_words"] / c["n_words"], 0.15, 0.05),
    "dup_lines": (lambda c: c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)), 0.5, 0.2),
    "upper": (lambda c: c["n_upper"] / c["word_chars"], 0.3, 0.15),
    "digits": (lambda c: c["n_digits"] / c["word_chars"], 0.5, 0.3),
    "marks": (lambda c: c["n_marks"] / c["n_words"], 1.0, 0.5),
    "long_words": (lambda c: c["word_chars"] / c["n_words"], 12.0, 10.0),
    "few_words": (lambda c: 1 / c["n_words"], 1 / 10, 1 / 20),
}


def _rest(x: Column, pattern: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order: a
    repeated window adds the words up to the next one's start, five at most."""
    n = F.size(hashes)
    sorted_ = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(0), n - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(_let(sorted_, starts), covered)


def counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each text. Words lie between spaces and 0x09-0x0D; null has none.
    Windows are compared by 64-bit hash within one text."""
    bare = F.btrim(F.col(text), F.lit(SPACES))
    words = F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), words.alias("words"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    joined = F.array_join("words", "")
    two = one.select(
        "doc_id", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        joined.alias("joined"), F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    return two.select(
        "doc_id", "n_words", F.length("joined").cast("long").alias("word_chars"), _rest(F.col("joined"), r"[#*$%&|<>]").cast("long").alias("n_symbols"), "n_dup_lines",
        F.when(distinct, F.lit(0).cast("long")).otherwise(_repeat_words(F.col("windows"))).alias("n_repeat_words"), "n_lines",
        _rest(F.col("joined"), r"\p{Lu}").cast("long").alias("n_upper"), _rest(F.col("joined"), r"[0-9]").cast("long").alias("n_digits"), _rest(F.col("joined"), r"[!?.,;:(){}\[\]=_/\\~^+@-]").cast("long").alias("n_marks"),
    )


def _votes(c: dict[str, Column]) -> Column:
    """Each rule's vote: 1 good, -1 bad, 0 none. A text without words has no votes but few_words' bad one."""
    out = []
    for name, (ratio, bad, good) in RULES.items():
        x = F.when(c["n_words"] > 0, ratio(c))
        none = F.when(c["n_words"] == 0, -1).otherwise(0) if name == "few_words" else F.lit(0)
        out.append(F.when(x > bad, -1).when(x <= good, 1).otherwise(none))
    return F.array(*out)


class VoteModel:
    """P(good) and each rule's chances of voting good, bad or nothing on good and bad texts."""

    def __init__(self, prior: float, chances: np.ndarray):
        self.prior, self.chances = prior, chances

    @classmethod
    def fit(cls, votes: np.ndarray, n: np.ndarray, held: float = HELD, rounds: int = 10_000) -> "VoteModel":
        """votes: patterns by rules; n: how many documents vote so. At the start a pattern with a bad
        vote is good one time in ten, any other 19 in 20; held times all documents go on counting so, which
        keeps a rule's meaning from turning round. All smoothing is in proportion to the documents, so tables
        of the same shares give the same verdicts at every size. Rounds end when nothing changes."""
        every = float(n.sum())
        if not every:
            return cls(0.9, np.full((2, votes.shape[1], 3), 1 / 3))
        cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)

        def chances(good: np.ndarray, more) -> np.ndarray:
            counted = np.stack([np.einsum("i,ijv->jv", w, cast) for w in (good, n - good)]) + every / 3000 + more
            return counted / counted.sum(axis=2, keepdims=True)

        first = np.where((votes == -1).any(axis=1), 0.1, 0.95) * n
        model = start = cls(first.sum() / every, chances(first, 0.0))
        for _ in range(rounds):
            good = model.posterior(votes) * n
            before, model = model, cls((good.sum() + held * every * start.prior) / (every * (1 + held)), chances(good, held * every * start.chances))
            if np.abs(model.chances - before.chances).max() < 1e-9:
                break
        return model

    def weights(self) -> np.ndarray:
        """Log odds of good that each rule's vote of -1, 0 or 1 adds; a good vote never counts
        against a text, nor a bad one for it."""
        w = np.log(self.chances[0]) - np.log(self.chances[1])
        w[:, 0], w[:, 1], w[:, 2] = np.minimum(w[:, 0], 0), np.clip(w[:, 1], -0.5, 0.5), np.maximum(w[:, 2], 0)
        return w

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        w = self.weights()
        odds = np.log(self.prior / (1 - self.prior)) + sum(w[j][votes[:, j] + 1] for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-odds))

    def column(self, votes: Column) -> Column:
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for j, w in enumerate(self.weights()):
            v = F.get(votes, F.lit(j))
            odds = odds + F.when(v < 0, float(w[0])).when(v > 0, float(w[2])).otherwise(float(w[1]))
        return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, the counts, votes, p_good, base_failed and kept of each document.

    base_failed: under 10 words, or over a fifth of the words in repeated windows; such a
    document is not kept, any other is if p_good reaches least. Null and empty texts have no
    words and so fail; rows that repeat are judged one by one; an empty table gives an empty
    one. A very long text is one row of one task, its words and windows arrays in memory, and repeats cost a sort of them.
    Only the two columns are read, so others may have any name."""
    stats = counts(docs, doc_id=doc_id, text=text)
    stats = written(stats.withColumn("votes", _votes({c: F.col(c) for c in _COUNTS})), "quality-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    patterns = stats.where(~failed).groupBy("votes").count().collect()
    k = len(RULES)
    model = VoteModel.fit(np.array([r["votes"] for r in patterns], int).reshape(-1, k), np.array([r["count"] for r in patterns], float))
    scored = stats.withColumn("p_good", model.column(F.col("votes"))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
