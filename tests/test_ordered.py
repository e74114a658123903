"""Scans over segments beside the fold of the whole stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import align, folds, windows
from signalloom.sources import audio

N = 6400


def stream(spark, parts=64):
    """Two streams, one of a null id, dealt over many partitions."""
    x = np.random.default_rng(7).normal(0.2, 0.4, N).tolist()
    rows = [(7, i, v) for i, v in enumerate(x)] + [(None, i, v) for i, v in enumerate(x[:130])]
    return spark.createDataFrame(rows, "stream_id int, pos long, x double").repartition(parts), np.array(x)


@pytest.mark.parametrize("name", ["dc", "highpass", "both"])
def test_filters_by_segments_equal_the_fold(spark, name):
    make = {"dc": folds.dc_blocker, "highpass": lambda: folds.high_pass(80, 16_000), "both": lambda: folds.series(folds.dc_blocker(), folds.high_pass(100, 16_000))}[name]
    samples, x = stream(spark)
    got = folds.scan_samples(samples, make, size=100).orderBy("stream_id", "pos").toPandas()
    want = folds.dc_blocker().process(x) if name != "highpass" else folds.high_pass(80, 16_000).process(x)
    want = folds.high_pass(100, 16_000).process(want) if name == "both" else want
    assert len(got) == N + 130 and np.allclose(got["y"][130:], want, atol=1e-9) and np.allclose(got["y"][:130], want[:130], atol=1e-9)


def test_no_group_holds_a_stream(spark):
    samples, _ = stream(spark)
    plan = folds.scan_samples(samples, folds.dc_blocker, size=100)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "hashpartitioning(" in line]
    assert sum("__seg" in line for line in dealt) >= 2 and sum("hashpartitioning(stream_id#" in line and "__seg" not in line for line in dealt) == 1  # that of the sums
    most = samples.select((F.col("pos") / 100).cast("long").alias("g"), "stream_id").groupBy("stream_id", "g").count().agg(F.max("count")).first()[0]
    assert most == 100


@pytest.mark.parametrize("capacity", [1, 12, 1000])
def test_queue_by_segments_equals_the_fold(spark, capacity):
    rng = np.random.default_rng(capacity)
    rows = [(s, i, int(p), int(w), f"x{i}") for s in ("a", "b") for i, (p, w) in enumerate(zip(rng.integers(0, 9, 3200), rng.integers(0, 9, 3200)))]
    blocks = spark.createDataFrame(rows, "stream_id string, ord long, pushed long, wanted long, note string").repartition(64)
    want = align.capped_levels(blocks, capacity)
    got = align.capped_levels_scanned(blocks, capacity, 50).select(want.columns)
    assert got.count() == 6400 and got.exceptAll(want).count() == 0
    free = align.reference_levels(blocks)
    assert align.reference_levels_scanned(blocks, 50).select(free.columns).exceptAll(free).count() == 0


def test_state_and_positions_by_segments(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, int(f), float(v)) for s in ("a", None) for i, (f, v) in enumerate(zip(rng.integers(1, 9, 900), rng.uniform(0, 1, 900) ** 6))]
    chunks = spark.createDataFrame(rows, "stream_id string, seq long, frames long, score double")
    placed = windows.chunk_positions(chunks, 16.0)
    scanned = windows.chunk_positions_scanned(chunks, 16.0, 40)
    assert scanned.select(placed.columns).exceptAll(placed).count() == 0 and scanned.count() == 1800
    want = windows.speaking_state(placed, 0.4, 2.0)
    got = windows.speaking_state_scanned(placed, 0.4, 2.0, 40).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.filter("is_speaking").count() not in (0, 1800)


def test_empty_and_tied(spark):
    none = spark.createDataFrame([], "stream_id string, pos long, x double")
    assert folds.scan_samples(none, folds.dc_blocker).count() == 0 and folds.fold_samples(none, folds.dc_blocker).count() == 0
    assert folds.fold_chunks(spark.createDataFrame([], audio.CHUNKS), lambda r, c: folds.PerChannel(folds.dc_blocker, c)).count() == 0
    hole = spark.createDataFrame([("a", 0, 1.0), ("a", 250, 1.0), ("a", 251, 1.0)], none.schema)  # a segment without rows
    got = folds.scan_samples(hole, folds.dc_blocker, size=100).orderBy("pos").toPandas()["y"]
    assert np.allclose(got, folds.dc_blocker().process(np.ones(3)))


def test_chunks_fold_batch_by_batch(spark):
    """Batches of a few rows give what one batch of all gives, for several streams, tails and odd chunks."""
    rng = np.random.default_rng(4)
    rows = [(s, i, 48_000, 2, rng.normal(0, 0.4, k).tolist()) for s in ("a", "b", "c") for i, k in enumerate([960, 0, 7, 1500, 2])] + [("d", 0, 48_000, 2, None)]
    chunks = spark.createDataFrame(rows, audio.CHUNKS).repartition(5)
    make = lambda rate, c: folds.Chain([folds.PerChannel(lambda: folds.PolyphaseResampler(rate, 16_000), c), folds.GainControl(-18, 16_000), folds.Limiter(-1, 16_000)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for most in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = folds.fold_chunks(chunks, make, 16_000).orderBy("stream_id", "seq").toPandas()
            found.append({s: np.concatenate(g["data"].to_list()) for s, g in got.groupby("stream_id")})
            assert all(g["seq"].tolist() == list(range(len(g))) for _, g in got.groupby("stream_id"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s in "abc":
        x = np.concatenate([np.array(r[4][: len(r[4]) // 2 * 2]).reshape(-1, 2) for r in rows if r[0] == s]).astype(np.float32)
        k = make(48_000, 2)
        want = np.concatenate([k.process(x.astype(float)), k.flush()]).ravel()
        assert all(np.allclose(f[s], want, atol=1e-6) for f in found)
    assert set(found[0]) == set("abc")
