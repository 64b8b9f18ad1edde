"""The bucketed ledger, link states kept by a stream, and what each does after a stop."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scholium.functions.text import content_hash
from scholium.operators import folds
from scholium.streaming import ledger, links


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "k string, p string").coalesce(1).withColumn("payload_hash", content_hash(F.col("p")))


def held(spark, path):
    return sorted((r.k, r.p) for r in ledger.read(spark, path, "k string, p string").collect())


@pytest.fixture
def few_tasks(spark):
    """Many batches of a few rows, each with as little to set up as can be."""
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, value in own.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def test_a_batch_reads_what_it_touches_however_old_the_ledger(spark, tmp_path, few_tasks):
    """Over 30 batches of a few keys the files read stay under buckets touched * most_files."""
    path, rng, every, read = str(tmp_path / "ledger"), random.Random(1), set(), []
    for number in range(30):
        rows = [(f"k{rng.randrange(4000)}", rng.choice("xy")) for _ in range(2)]
        new, n = ledger.append(path, batch_of(spark, rows), number, key=["k"], bits=6, most_files=3, most_rows=1000)
        read.append(n)
        every |= set(rows)
    assert held(spark, path) == sorted(every)
    assert max(read) <= 2 * 3
    assert sum(read[20:]) <= sum(read[10:20]) + 25
    assert len(ledger.manifest(spark, path).files()) > 30


def test_buckets_split_and_batches_run_again(spark, tmp_path):
    path, every = str(tmp_path / "ledger"), set()
    for number in range(6):
        rows = [(f"k{(number * 37 + i) % 150}", str(i % 3)) for i in range(120)]
        batch = batch_of(spark, rows + rows[:5])
        if number == 3:  # a run that wrote its rows and stopped before its manifest
            ledger.append(path, batch_of(spark, [("lost", "1")]), number, key=["k"], bits=1, most_rows=40)
            os.remove(f"{path}/manifest/{number:012d}.json")
        first = {(r.k, r.p) for r in ledger.append(path, batch, number, key=["k"], bits=1, most_rows=40)[0].collect()}
        again = {(r.k, r.p) for r in ledger.append(path, batch, number, key=["k"], bits=1, most_rows=40)[0].collect()}
        assert first == again == set(rows) - every
        every |= set(rows)
        assert held(spark, path) == sorted(every)
    last = ledger.manifest(spark, path)
    assert last.depth > 2 and all(x["rows"] <= 80 for x in last.buckets.values()) and sum(x["rows"] for x in last.buckets.values()) == len(every)
    assert ledger.vacuum(spark, path, kept=1) > 0
    assert held(spark, path) == sorted(every)
    assert ledger.append(path, batch_of(spark, sorted(every)), 6, key=["k"], bits=1, most_rows=40)[0].count() == 0
    assert ledger.append(path, batch_of(spark, []), 7, key=["k"])[1] == 0


SCHEMA = "k string, i int, ts timestamp, t string, s string, r boolean"


@pytest.mark.parametrize("arrival", ["in order", "shuffled", "backwards"])
def test_link_states_by_stream_are_those_of_the_fold(spark, tmp_path, arrival):
    """Three batches, with a stop before each of the last two, in three orders of arrival."""
    rng = random.Random(5)
    rows = [(f"k{k}", i, 1_700_000_000 + i * 60, rng.choice("xyz"), rng.choice(folds.STATES + ["LINKED"] * 3), rng.random() < 0.2) for k in range(6) for i in range(12)]
    changes = spark.createDataFrame(rows, "k string, i int, sec int, t string, s string, r boolean").select("k", "i", F.timestamp_seconds("sec").alias("ts"), "t", "s", "r")
    wanted = sorted(tuple(r) for r in folds.link_states(changes, key=["k"], order=["ts", "i"], target="t", state="s", replay="r").select("k", "state", "target", F.col("n_relinks").cast("long")).collect())
    order = {"in order": sorted(rows, key=lambda r: r[1]), "shuffled": rng.sample(rows, len(rows)), "backwards": sorted(rows, key=lambda r: -r[1])}[arrival]
    for name, value in links.STATE_STORE.items():
        spark.conf.set(name, value)
    source, out, waits = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in (order[:24], order[24:48], order[48:] + order[:5]):  # some come twice
        spark.createDataFrame(part, "k string, i int, sec int, t string, s string, r boolean").coalesce(1).select("k", "i", F.timestamp_seconds("sec").alias("ts"), "t", "s", "r").write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        told = links.follow(stream, key="k", at="ts", order="i", target="t", state="s", replay="r", delay="5 minutes" if arrival == "in order" else "1 hour")
        told.writeStream.outputMode("update").foreachBatch(links.upserted(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        waits.append(spark.read.parquet(out).groupBy().agg(F.max_by("n_waiting", "batch")).first()[0])
    assert sorted(tuple(r) for r in links.states(spark, out).collect()) == wanted
    assert waits[-1] < 12 if arrival == "in order" else waits[-1] <= 12
