"""URL filter: the ratio of two character language models, learnt from URLs that rules decide.

Rules on hosts and paths decide some URLs. Their characters train two variable-order Markov
models, one of accepted and one of blocked URLs: counts of the next character after
contexts of 0 to 4 characters, over all such URLs, smoothed from order to order by
Witten-Bell's weights. A URL without a rule is judged by the difference of its two mean
log-likelihoods per character against a threshold calibrated on rules' verdicts that the models
did not learn from: of the URLs with rules one in ``calibrate``, chosen by hash, is kept for that.

Characters fall into 40 classes, and every context is a cell of its own: 2,625,641 at most.
Counts of contexts up to three characters lie in a full table (21 MB), those of four in a
sorted table of what occurs: 12 bytes for each context and next class that some ruled URL
holds, and 20 for each context, so its size follows the variety of URLs, not their number
(1.3 GB if every one of 102,400,000 occurred). Counts are summed within each Arrow batch
before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Carried, written
from ._text import buffer_of, with_columns

#: (host, path, verdict), as the contract gives them.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER, SYMBOLS = 4, 40
_BASE = np.concatenate([[0], np.cumsum([SYMBOLS**k for k in range(ORDER + 1)])])
#: Contexts under this number are counted in a full table, those from it on in a sorted one.
DENSE = int(_BASE[ORDER])
_BINS = 400
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Letters 0-25, any digit 26, then marks; all else is the last class.
_CLASS = np.full(256, SYMBOLS - 1, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(26)
_CLASS[48:58] = 26
for _i, _c in enumerate(b"./-_?=&:#%+~"):
    _CLASS[_c] = 27 + _i


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: host after the first :// up to / ? # or the end, A-Z lower-cased; path
    then up to ? or #. Both empty without ://, or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWERED), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (struct of name and verdict), or null. Of two as long, the first by name."""
    return F.coalesce(
        *(
            F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
            for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
        )
    )


def _contexts(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text of each character, its class, its context at each order; -1 where too near the start)."""
    buf, offsets = buffer_of(urls)
    c = _CLASS[buf].astype(np.int64)
    text = np.repeat(np.arange(len(urls)), np.diff(offsets))
    into = np.arange(len(c)) - offsets[:-1][text]
    out, value, ok = [np.zeros(len(c), np.int64)], np.zeros(len(c), np.int64), np.ones(len(c), bool)
    for k in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(min(k, len(c)), np.int64), c[:-k] if k < len(c) else c[:0]])[: len(c)]
        value, ok = value * SYMBOLS + before, into >= k
        out.append(np.where(ok, _BASE[k] + value, -1))
    return text, c, out


def counted(urls: DataFrame, url: str, blocked: str) -> DataFrame:
    """(cell, accepted, blocked): how often a class follows a context in accepted and in blocked URLs."""

    def run(batches):
        for batch in batches:
            text, c, contexts = _contexts(batch.column(0))
            side = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[text]
            cells = np.concatenate([((x * SYMBOLS + c) * 2 + side)[x >= 0] for x in contexts]) if len(c) else np.zeros(0, np.int64)
            cell, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cell // 2).astype(np.int32)), pa.array(np.where(cell % 2, 0, n)), pa.array(np.where(cell % 2, n, 0))], ["cell", "accepted", "blocked"])

    found = urls.select(url, F.col(blocked).cast("int")).mapInArrow(run, "cell int, accepted long, blocked long")
    return found.groupBy("cell").agg(*(F.sum(x).cast("float").alias(x) for x in ("accepted", "blocked")))


class UrlModels:
    """Log probabilities of classes after contexts, for accepted and blocked URLs. The cells may come in any order."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        low = cells < DENSE * SYMBOLS
        full = np.zeros((DENSE * SYMBOLS, 2), np.float32)
        full[cells[low]] = counts[low]
        self.counts = full.reshape(DENSE, SYMBOLS, 2)
        self.total, self.kinds = self.counts.sum(axis=1), (self.counts > 0).sum(axis=1).astype(np.float32)
        order = np.flatnonzero(~low)
        order = order[np.argsort(cells[order])]
        self.cells, self.cell_counts = cells[order].astype(np.int32), counts[order]
        contexts = self.cells // SYMBOLS
        heads = np.flatnonzero(np.diff(contexts, prepend=-1))
        self.contexts = contexts[heads]
        sums = lambda x: np.add.reduceat(x, heads, axis=0, dtype=np.float32) if len(heads) else np.zeros((0, 2), np.float32)
        self.context_total, self.context_kinds = sums(self.cell_counts), sums(self.cell_counts > 0)

    def _after(self, context: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the class, kinds, total) after contexts of one order; zeros after unseen ones."""
        if not len(context) or context[0] < DENSE:
            return self.counts[context, c], self.kinds[context], self.total[context]
        return _looked_up(self.cells, context * SYMBOLS + c, self.cell_counts), *_looked_up(self.contexts, context, self.context_kinds, self.context_total)

    def score(self, urls: pa.Array) -> np.ndarray:
        """Mean log-likelihood per character if accepted less that if blocked; 0 for no characters."""
        text, c, contexts = _contexts(urls)
        p = np.full((len(c), 2), 1.0 / SYMBOLS)
        for x in contexts:  # from the shortest context up: p = (count + kinds * p_shorter) / (total + kinds)
            on = np.flatnonzero(x >= 0)
            n, k, total = self._after(x[on], c[on])
            p[on] = np.where(total > 0, (n + k * p[on]) / np.maximum(total + k, 1), p[on])
        sums = np.bincount(text, np.log(p[:, 0]) - np.log(p[:, 1]), minlength=len(urls))
        return sums / np.maximum(np.bincount(text, minlength=len(urls)), 1)


def _looked_up(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> np.ndarray | list[np.ndarray]:
    """The values at wanted keys of a sorted table, 0 where there is none."""
    at = np.searchsorted(keys, wanted.astype(np.int32))
    there = np.flatnonzero(at < len(keys))
    there = there[keys[at[there]] == wanted[there]]
    out = []
    for v in values:
        x = np.zeros((len(wanted), 2), np.float32)
        x[there] = v[at[there]]
        out.append(x)
    return out if len(out) > 1 else out[0]


def judged(pages: DataFrame, *, url: str = "url", keep: list[str] | None = None, rules=RULES, calibrate: int = 5) -> DataFrame:
    """pages (its columns keep, or all) with host, path, rule, score (of the models) and verdict.

    verdict: the rule's, else block if score is under the threshold, else allow. The threshold
    is the middle of the range of scores that errs least on the URLs with rules that are kept for it (on
    all, if those lack either verdict, or calibrate is 0; then the models learn from all). A null or
    empty URL has no rule, score 0 and so verdict allow if the threshold allows 0; without URLs of either kind
    the models know nothing, and everything without a rule is allowed. Rows that repeat
    count and are judged each; columns of these names are replaced. A very long URL is scored whole."""
    host, path = parts(F.col(url))
    base = pages.select(*(c for c in pages.columns if c == url or (keep is None or c in keep) and c.lower() not in ("host", "path", "rule", "verdict", "score")))
    ruled = base.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    ruled = ruled.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    apart = F.pmod(F.xxhash64(url, F.lit("calibrate")), F.lit(calibrate)) == 0 if calibrate else F.lit(False)
    known = ruled.where(F.col("by_rule").isNotNull()).withColumn("blocked", F.col("by_rule.verdict") == "block")
    cells = counted(known.where(~apart), url, "blocked").toArrow()  # rows of 12 bytes
    models = UrlModels(cells.column("cell").to_numpy(), np.stack([cells.column(x).to_numpy() for x in ("accepted", "blocked")], axis=1))
    held = pages.sparkSession.sparkContext.broadcast(Carried(models))
    scored = with_columns(ruled, url, [T.StructField("score", T.DoubleType())], lambda batch: [held.value.score(batch.column(batch.schema.get_field_index(url)))])
    scored = written(scored, "url-scores")
    top = 4.0
    bin_of = F.least(F.greatest(F.floor((F.col("score") + top) / (2 * top) * _BINS), F.lit(0)), F.lit(_BINS - 1))
    tables = np.zeros((2, _BINS, 2))
    for r in scored.where("by_rule is not null").groupBy(apart.alias("apart"), bin_of.cast("int").alias("bin"), (F.col("by_rule.verdict") == "block").alias("blocked")).count().collect():
        tables[int(r.apart), r.bin, int(r.blocked)] = r["count"]
    table = tables[1] if tables[1].sum(axis=0).all() else tables.sum(axis=0)
    threshold = -np.inf
    if table.sum(axis=0).all():
        wrong = np.concatenate([[0], np.cumsum(table[:, 0])]) / table[:, 0].sum() + (table[:, 1].sum() - np.concatenate([[0], np.cumsum(table[:, 1])])) / table[:, 1].sum()
        best = np.flatnonzero(wrong == wrong.min())
        threshold = float((best[0] + best[-1]) / 2 / _BINS * 2 * top - top)
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return scored.withColumn("rule", F.col("by_rule.rule")).withColumn("verdict", verdict).drop("by_rule")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: the verdict on every page's URL."""
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict", "score")
