"""Resumed appends against plain Python, and what a batch reads of what is there."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.streaming import ingest, key_index

SCHEMA = "source_file string, seq long, keys array<string>, extra string"


def test_filters():
    rng = np.random.default_rng(1)
    own, other = rng.integers(-(2**63), 2**63 - 1, 20_000), rng.integers(-(2**63), 2**63 - 1, 200_000)
    flt = key_index.bloom_filter(own)
    assert len(flt) == 50_000 and key_index.may_hold(flt, own).all() and key_index.may_hold(flt, other).mean() < 5e-4
    assert not key_index.may_hold(key_index.bloom_filter(own[:0]), own).any()


@pytest.mark.parametrize("files_at_once", [1, 3])
def test_batches_append_what_is_new(spark, tmp_path, files_at_once):
    rng = random.Random(5)
    landing = tmp_path / "in"
    rows_of = lambda k: [(f"f{k}", i, rng.choice([None, [], [None]]) if rng.random() < 0.05 else [f"k{rng.randrange(150)}" for _ in range(rng.randrange(1, 3))], "x") for i in range(12)]
    for run in range(3):
        for k in range(3):
            rows = rows_of(run * 3 + k)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(str(landing))
        ingest.append_new(stream, f"file://{tmp_path}/out", str(tmp_path / "cp"), buckets=3).awaitTermination()
    # batches as they were cut, in their order
    got = spark.read.parquet(f"{tmp_path}/out/games").collect()
    for number in sorted({r.batch for r in got}):
        assert len({(r.source_file, r.seq) for r in got if r.batch == number}) == sum(r.batch == number for r in got)
    log = spark.read.parquet(str(landing)).collect()
    kept = {(r.source_file, r.seq) for r in got}
    keys = [k for r in got for k in set(r["keys"] or [])]
    assert len(keys) == len(set(keys)), "a key was kept twice"
    for r in log:
        if (r.source_file, r.seq) not in kept:
            assert set(r["keys"]) & set(keys), "a row without known keys was left out"
        elif not r["keys"]:
            assert (r.source_file, r.seq) in kept


def test_known_keys_and_replayed_batches(spark, tmp_path):
    index = key_index.KeyIndex(spark, f"file://{tmp_path}/index", buckets=4)
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    known = lambda df, n: sorted((r.key or "" for r in index.known(df, n).collect()))
    assert known(keys("a"), 0) == []
    index.add(keys("a", "b", None), 0)
    index.add(keys("c"), 1)
    index.add(keys("c", "d"), 1)  # replaces itself
    index.add(keys("x").limit(0), 2)
    assert known(keys("a", "c", "d", "e", None, "a"), 3) == ["", "a", "c", "d"]
    assert known(keys("a", "c"), 1) == ["a"] and known(keys("z").limit(0), 3) == []


def test_batches_open_only_what_may_repeat(spark, tmp_path, monkeypatch):
    index, opened = key_index.KeyIndex(spark, f"file://{tmp_path}/index", buckets=4), []
    for n in range(6):
        index.add(spark.range(n * 1000, n * 1000 + 1000).select(F.col("id").cast("string").alias("key")), n)
    real = key_index.saved

    def watched(df, label):
        out = real(df, label)
        opened.append(out.select("batch", "bucket").distinct().count())
        return out

    monkeypatch.setattr(key_index, "saved", watched)
    assert index.known(spark.range(50_000, 50_500).select(F.col("id").cast("string").alias("key")), 9).count() == 0
    assert index.known(spark.range(2000, 2001).select(F.col("id").cast("string").alias("key")), 9).count() == 1
    assert opened[0] <= 2 and opened[1] == 1  # of 24 parts
