"""On two executors, where rows come from shuffles in any order: the same results as plain versions.

The session of a test run is local, so the queries run in a process of their own."""

import json
import os
import random
import subprocess
import sys

import pytest

from . import brute
from .conftest import PASSAGE

RUN = """
import json, sys, traceback
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from scholium.llm import audit, collocations, lines, lm, substrings
d, out = sys.argv[1:]
spark = (SparkSession.builder.master("local-cluster[2,1,2048]").config("spark.sql.shuffle.partitions", "7").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.sql.session.timeZone", "UTC").config("spark.executor.memory", "1800m").config("spark.checkpoint.dir", "file://" + d + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.range(100).repartition(4).mapInPandas(lambda x: x, "id long").count()
json.dump("it is up", open(out + "/started", "w"))
docs, small = spark.read.parquet(d + "/documents.parquet"), {"block_bytes": 20_000, "part_bytes": 20_000}
labels = spark.read.parquet(d + "/labels.parquet")
runs = {n: (lambda n=n: entry.queries()[n](spark, d)) for n in ("op9_simhash", "op10_mix", "pipeline")} | {
    "op8": lambda: substrings.deduplicated(docs, **small), "op8 merged": lambda: substrings.deduplicated(docs, fan=3, **small), "op4": lambda: lm.scores(docs, **small),
    "op11": lambda: audit.interactions(docs, labels), "op12": lambda: collocations.mined(docs, **small), "op13": lambda: lines.digest(docs),
}
for n, run in runs.items():
    try:
        found = {"rows": [list(r) for r in run().collect()]}
    except Exception:
        found = {"error": traceback.format_exc()[-3000:]}
    json.dump(found, open(out + "/" + n, "w"))
spark.stop()
"""


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Many files, and a row that is a third of the table."""
    out = str(tmp_path_factory.mktemp("many"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(n))
    more = [(10_000, f"{PASSAGE} tail", "en", "web", 1)] * 110 + [(20_000 + i, f"{say(9)} {PASSAGE} {say(60)}", "en", "hot", 1) for i in range(40)]
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    every.repartition(23).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out


def _home(where):
    """Spark's own folder, but for the workers' files: those go to a folder that is ours to write."""
    import pyspark

    home = os.path.dirname(pyspark.__file__)
    for name in os.listdir(home):
        if name != "work":
            os.symlink(os.path.join(home, name), os.path.join(where, name))
    return where


class _Found:
    """What each query of the run gave; a query that failed, or a cluster that ended early, says why."""

    def __init__(self, folder, ended):
        self.folder, self.ended = folder, ended

    def __getitem__(self, name):
        path = os.path.join(self.folder, name)
        assert os.path.exists(path), f"the run ended before {name}: {self.ended}"
        said = json.load(open(path))
        assert "error" not in said, said["error"]
        return said["rows"]


@pytest.fixture(scope="module")
def found(tables, tmp_path_factory):
    out, top = str(tmp_path_factory.mktemp("found")), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    scratch = str(tmp_path_factory.mktemp("scratch"))
    env = os.environ | {
        "PYTHONPATH": f"{top}:{os.environ.get('PYTHONPATH', '')}", "SPARK_HOME": _home(str(tmp_path_factory.mktemp("home"))), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1",
        "SPARK_LOCAL_DIRS": scratch, "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": f"--driver-memory 2g --driver-java-options -Djava.io.tmpdir={scratch} pyspark-shell",
    }
    try:
        run = subprocess.run([sys.executable, "-c", RUN, tables, out], timeout=1500, env=env, cwd=str(tmp_path_factory.mktemp("cwd")), capture_output=True, text=True)
        ended = f"status {run.returncode}\n{run.stdout[-500:]}\n{run.stderr[-3000:]}"
    except subprocess.TimeoutExpired as e:
        ended = f"too late\n{(e.stderr or b'')[-3000:]}"
    if not os.path.exists(f"{out}/started"):
        pytest.skip(f"no local cluster could be started here: {ended}")
    return _Found(out, ended)


@pytest.fixture(scope="module")
def docs(spark, tables):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["op8", "op8 merged"])
def test_passages(found, docs, name):
    plain = sorted((i, n, gone, sha) for (i, _), (n, gone, sha) in zip(docs, brute.substrings([t for _, t in docs]), strict=True))
    assert sorted((i, n, gone, brute.sha(text)) for i, n, gone, text in found[name]) == plain


def test_scores(found, docs):
    plain = sorted((i, *x) for (i, _), x in zip(docs, brute.lm_scores([t for _, t in docs]), strict=True))
    rows = sorted(map(tuple, found["op4"]))
    assert [r[:2] for r in rows] == [r[:2] for r in plain]
    assert [r[2] for r in rows] == pytest.approx([r[2] for r in plain], rel=1e-9)


def test_components(found, docs):
    fps = [(i, brute.fingerprint(t)) for i, t in docs]
    roots = brute.components(fps)
    assert sorted(map(tuple, found["op9_simhash"])) == sorted((i, f"{f:016x}", roots[i]) for i, f in fps)


def test_mix(found, docs):
    rows = found["op10_mix"]
    assert sorted(r[:2] for r in rows) == sorted([i, len(brute.WORD.findall(t or ""))] for i, t in docs)
    assert all(0 <= r[4] <= 2 * r[1] for r in rows)


def test_pipeline(found, docs):
    ids = [r[0] for r in found["pipeline"]]
    assert len(ids) == len(set(ids)) and set(ids) <= {i for i, _ in docs}


def test_lines(found, docs):
    assert sorted(map(tuple, found["op13"])) == sorted((i, n, gone, brute.sha(k)) for (i, _), (n, gone, k) in zip(docs, brute.kept_lines(docs), strict=True))


def test_audit(found, spark, tables):
    every = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, found["op11"])) == sorted(brute.audit(every, labels))


def test_phrases(found, spark, tables):
    every = [(r.text, r.lang) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert sorted(map(tuple, found["op12"])) == sorted(brute.collocations(every))
