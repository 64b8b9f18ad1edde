"""Each stage of the pipeline against a plain version, on given, odd and empty tables."""

import pytest

import corpus_pipeline
from scholium.llm import decontaminate, pii, toxicity

from . import brute

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(params=["given", "odd", "empty"])
def where(request, sf_dir, odd_dir, empty_dir):
    return {"given": sf_dir, "odd": odd_dir, "empty": empty_dir}[request.param]


@pytest.fixture
def docs(spark, where):
    return spark.read.parquet(f"{where}/documents.parquet")


def rows(df):
    return sorted((tuple((v is not None, v) for v in r) for r in df.collect()))


def test_toxicity(spark, where, docs):
    kept = STAGES["toxicity"](spark, docs, where)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{where}/labels.parquet")).where("predicted = 1").collect()}
    assert rows(kept) == rows(docs.where(~docs.doc_id.isin(list(bad) or [-1])))


def test_near_copies(spark, where, docs):
    kept = STAGES["near duplicates"](spark, docs, where)
    assert kept.columns == docs.columns
    ids = brute.components([(r.doc_id, brute.fingerprint(r.text)) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(ids.values()))


def test_near_copies_without_ids_or_with_one_id_twice(spark):
    """Null ids, and one id on rows of different texts: each component keeps exactly one row."""
    say = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    texts = [(None, say("a")), (None, say("a")), (None, say("b")), (3, say("c")), (5, say("c")), (5, say("d")), (7, say("e")), (7, say("f")), (None, say("f"))]
    docs = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(texts)], "doc_id long, text string, uid string").repartition(3)
    kept = STAGES["near duplicates"](spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.doc_id or 0) for r in kept.collect()) == [(say("a"), 0), (say("b"), 0), (say("c"), 3), (say("d"), 5), (say("e"), 7), (say("f"), 7)]


def test_decontamination(spark, where, docs):
    kept = STAGES["decontamination"](spark, docs, where)
    assert kept.columns == docs.columns
    every = docs.select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    clean = [r.doc_id for r, x in zip(every, brute.contaminated(every, items), strict=True) if not x[4]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)


def test_decontaminated_spans(spark, where, docs):
    bench = spark.read.parquet(f"{where}/benchmark.parquet")
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == docs.columns
    before = {r.doc_id: r for r in decontaminate.judged(decontaminate.find(docs.select("doc_id", "text"), bench)).collect()}
    after = {r.doc_id: r.n_words for r in decontaminate.find(cut.select("doc_id", "text"), bench.limit(0)).collect()}
    assert all(after[i] <= r.n_words - r.n_hit + len(r.hit_runs) for i, r in before.items())


def test_personal_data(spark, where, docs):
    clean = STAGES["personal data"](spark, docs, where)
    assert clean.columns == docs.columns
    spans = {(r.doc_id, r.text): [(s.start, s.kind, s.end) for s in r.pii_spans] for r in pii.spans(docs.select("doc_id", "text")).collect()}
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        out, at = [], 0
        for s, k, e in spans[(r.doc_id, r.text)] if r.text is not None else []:
            if s >= at:
                out += [r.text[at:s], f"[{brute.KINDS[k].upper()}]"]
            at = max(at, e)
        wanted.append((r.doc_id, None if r.text is None else "".join(out) + r.text[at:]))
    key = lambda x: (x[0], x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(wanted, key=key)
    assert rows(clean.drop("text")) == rows(docs.drop("text"))


def test_whole(spark, where):
    out = corpus_pipeline.run(spark, where)
    assert {"doc_id", "taken", "target"} <= set(out.columns)
    assert all(r.taken <= 2 * r.size for r in out.collect())
