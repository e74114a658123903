import time

import numpy as np
import pytest

from signalloom.operators import folds
from signalloom.streaming import live

ROWS = "stream_id string, seq long, sample_rate int, channels int, data array<float>, last boolean"


def test_live_fold_flush_and_late_rows(spark, tmp_path):
    x = np.random.default_rng(0).normal(0, 0.3, 1000).astype(np.float32)
    rows = [("a", i, 48_000, 1, x[i * 100 : i * 100 + 100].tolist(), i == 9) for i in range(10)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows[:4][::-1], ROWS).coalesce(1).write.parquet(folder)
    seen = []

    def go():
        q = live.play(live.folded(live.capture(spark, folder), lambda r, c: folds.PerChannel(lambda: folds.PolyphaseResampler(r, 16_000), c)), lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck"))
        q.awaitTermination()

    go()
    spark.createDataFrame(rows[4:], ROWS).coalesce(1).write.mode("append").parquet(folder)
    go()
    spark.createDataFrame([("a", 10, 48_000, 1, [0.0], False)], ROWS).coalesce(1).write.mode("append").parquet(folder)
    go()
    got = np.concatenate([r["data"] for r in sorted(seen, key=lambda r: r["seq"]) if r["data"] is not None])
    r = folds.PolyphaseResampler(48_000, 16_000)
    want = np.concatenate([r.process(x.astype(float)), r.flush()])
    assert np.allclose(got, want, atol=1e-6)
    assert sum(r["rejected"] for r in seen) == 1 and sum(bool(r["closed"]) and not r["rejected"] for r in seen) == 1


def test_live_speaking_state(spark, tmp_path):
    scores = [0.5, 0.0, 0.0, 0.0, 0.0, 0.4]
    rows = [("a", i, i * 0.1, (i + 1) * 0.1, s) for i, s in enumerate(scores)]
    ddl, seen = "stream_id string, seq long, start double, end double, score double", []
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    frames = live.speaking(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), 0.1, 0.25)
    live.play(frames, lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [r["is_speaking"] for r in sorted(seen, key=lambda r: r["seq"])] == [True, True, True, False, False, True]


def test_live_echo_and_clock(spark, tmp_path):
    rng = np.random.default_rng(0)
    far = rng.normal(0, 0.3, 32_000)
    near = 0.25 * np.concatenate([np.zeros(100), far[:-100]])
    rows = []
    for i in range(20):
        a = slice(i * 1600, (i + 1) * 1600)
        rows += [("a", 2 * i, "far", 1, far[a].tolist(), False), ("a", 2 * i + 1, "near", 1, near[a].tolist(), i == 19)]
    spark.createDataFrame(rows, live.PAIRED).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    frames = live.echo_cancelled(spark.readStream.schema(live.PAIRED).parquet(str(tmp_path / "in")), 512)
    live.play(frames, lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    seen.sort(key=lambda r: r["ord"])
    y = np.concatenate([r["data"] for r in seen])
    assert len(y) == len(near) and (near[-8000:] ** 2).sum() > 1000 * (y[-8000:] ** 2).sum()
    assert (seen[-1]["dropped"], seen[-1]["silence"], seen[-1]["delay"]) == (0, 0, 100)
    ddl, events = "stream_id string, score double", []
    spark.createDataFrame([("a", 0.5), ("a", 0.0), ("b", 0.0)], ddl).coalesce(1).write.parquet(str(tmp_path / "scores"))
    q = live.speaking_now(spark.readStream.schema(ddl).parquet(str(tmp_path / "scores")), 0.1, 200).writeStream.foreachBatch(lambda df, i: events.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck2")).trigger(processingTime="100 milliseconds").start()
    for _ in range(150):
        if len(events) == 2:
            break
        time.sleep(0.2)
    q.stop()
    assert [(r["stream_id"], r["event"]) for r in events] == [("a", "speech"), ("a", "silence")]


def test_silence_falls_in_spite_of_quiet_chunks(spark, tmp_path):
    ddl, events, folder = "stream_id string, score double", [], str(tmp_path / "scores")
    add = lambda *rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    add(("a", 0.5), ("b", 0.0))
    q = live.speaking_now(spark.readStream.schema(ddl).parquet(folder), 0.1, 3000).writeStream.foreachBatch(lambda df, i: events.extend(r["event"] for r in df.filter("stream_id = 'a'").collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        for want in (["speech"], ["speech", "silence"], ["speech", "silence", "speech"], ["speech", "silence", "speech", "silence"]):
            for i in range(150):
                if len(events) >= len(want):
                    break
                if want[-1] == "silence" and i < 3:
                    add(("a", 0.0))  # quiet chunks before the holdoff is over
                time.sleep(0.2)
            assert events == want
            if want[-1] == "silence" and len(want) == 2:
                add(("a", 0.9))
    finally:
        q.stop()


def chunk_rows(x, size, rate=16_000, channels=1, name="a"):
    parts = [x[i : i + size] for i in range(0, len(x), size)]
    return [(name, i, rate, channels, p.ravel().tolist(), i == len(parts) - 1) for i, p in enumerate(parts)]


def drain(frames, seen, checkpoint, **options):
    live.play(frames, lambda df, i: seen.extend(df.collect()), checkpoint).awaitTermination()


def blocks_in_order(seen):
    return np.concatenate([r["data"] for r in sorted((r for r in seen if r["data"] is not None), key=lambda r: r["seq"])])


def test_shuffled_files_equal_the_fold(spark, tmp_path):
    x = np.random.default_rng(1).normal(0.1, 0.3, 3000).astype(np.float32)
    rows = chunk_rows(x, 100)
    order = np.random.default_rng(2).permutation(len(rows))
    seen, folder = [], str(tmp_path / "in")
    make = lambda r, c: folds.Chain([folds.PerChannel(folds.dc_blocker, c), folds.Limiter(-6, r)])
    for part in np.array_split(order, 4):
        spark.createDataFrame([rows[i] for i in part], ROWS).coalesce(1).write.mode("append").parquet(folder)
        drain(live.folded(live.capture(spark, folder), make, 160), seen, str(tmp_path / "ck"))
    want = make(16_000, 1).process(x.astype(float)[:, None]).ravel()
    assert np.allclose(blocks_in_order(seen), want, atol=1e-6) and len(want) == 3000
    assert [r["rejected"] + r["missing"] + r["overrun"] for r in seen] == [0] * len(seen) and sum(r["closed"] for r in seen) == 1
    # a number that was folded already, twice; then one after the end
    spark.createDataFrame([("b", *rows[0][1:]), ("b", *rows[1][1:])], ROWS).coalesce(1).write.mode("append").parquet(folder)
    drain(live.folded(live.capture(spark, folder), make, 160), seen, str(tmp_path / "ck"))
    spark.createDataFrame([("b", *rows[0][1:]), ("b", *rows[1][1:]), ("a", 99, 16_000, 1, [1.0], False)], ROWS).coalesce(1).write.mode("append").parquet(folder)
    drain(live.folded(live.capture(spark, folder), make, 160), seen, str(tmp_path / "ck"))
    assert {r["stream_id"]: r["rejected"] for r in seen if r["rejected"]} == {"b": 2, "a": 1}


def test_gaps_and_overrun(spark, tmp_path):
    x = np.arange(1, 31, dtype=np.float32)
    rows = chunk_rows(x, 1)
    seen = []
    spark.createDataFrame([r for r in rows if r[1] not in (3, 4)], ROWS).coalesce(1).write.parquet(str(tmp_path / "gap"))
    same = lambda r, c: folds.PerChannel(lambda: folds.LinearResampler(1, 1), c)
    drain(live.folded(live.capture(spark, str(tmp_path / "gap")), same, hold=8), seen, str(tmp_path / "ck"))
    assert blocks_in_order(seen).tolist() == [v for v in x if v not in (4, 5)] and sum(r["missing"] for r in seen) == 2
    seen, n = [], {"s": 25, "t": 20, "u": 3}
    many = [r for s, k in n.items() for r in chunk_rows(x[:k], 1, name=s)]
    spark.createDataFrame(many, ROWS).coalesce(1).write.parquet(str(tmp_path / "full"))
    drain(live.folded(live.capture(spark, str(tmp_path / "full")), same, queue=20), seen, str(tmp_path / "ck2"))
    from pyspark.sql import functions as F

    from signalloom.operators import windows

    arrivals = spark.createDataFrame(many, ROWS).select("stream_id", "seq")
    want = {r[0]: r[1] for r in windows.dropped_newest(arrivals, 20).groupBy("stream_id").agg(F.count_if(~F.col("kept"))).collect()}
    got = dict.fromkeys(n, 0)
    for r in seen:
        got[r["stream_id"]] += r["overrun"]
    assert got == want == {"s": 5, "t": 0, "u": 0} and sum(r["closed"] for r in seen) == 3


def test_rows_without_data_or_number(spark, tmp_path):
    rows = [("a", 0, None, None, None, False), ("a", 1, 8000, 2, [1.0, 2.0], False), ("a", None, 8000, 2, [9.0, 9.0], False), ("a", 2, None, None, None, True), ("b", 0, None, None, None, True), (None, 0, 8000, 1, [3.0], True)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    same = lambda r, c: folds.PerChannel(lambda: folds.LinearResampler(1, 1), c)
    drain(live.folded(live.capture(spark, str(tmp_path / "in")), same), seen, str(tmp_path / "ck"))
    got = {s: [r for r in seen if r["stream_id"] == s] for s in ("a", "b", None)}
    assert blocks_in_order(got["a"]).tolist() == [1, 2] and sum(r["rejected"] for r in got["a"]) == 1
    assert blocks_in_order(got[None]).tolist() == [3] and all(sum(bool(r["closed"]) for r in g) == 1 for g in got.values())


def until(query, done, seconds=60):
    for _ in range(seconds * 5):
        if done():
            return
        time.sleep(0.2)
    query.stop()
    raise AssertionError("the query didn't get there")


def test_state_expires(spark, tmp_path):
    x, folder, seen = np.ones(300, np.float32), str(tmp_path / "in"), []
    same = lambda r, c: folds.PerChannel(lambda: folds.LinearResampler(1, 1), c)
    rows = chunk_rows(x, 100) + [("idle", 0, 16_000, 1, [0.5] * 7, False)] + [("gap", 0, 16_000, 1, [1.0], False), ("gap", 2, 16_000, 1, [3.0], True)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(folder)
    frames = live.observed(live.folded(live.capture(spark, folder), same, 50, patience_ms=500, forget_ms=1500, idle_ms=1000))
    q = frames.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        until(q, lambda: sum(r["closed"] for r in seen) == 3)
        until(q, lambda: q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
    finally:
        q.stop()
    got = {s: np.concatenate([r["data"] for r in seen if r["stream_id"] == s and r["data"] is not None]).tolist() for s in ("a", "idle", "gap")}
    assert got == {"a": x.tolist(), "idle": [0.5] * 7, "gap": [1.0, 3.0]} and sum(r["missing"] for r in seen) == 1
    counted = [p["observedMetrics"]["live"] for p in q.recentProgress if p["observedMetrics"]]
    assert sum((m["closed"] or 0) if isinstance(m, dict) else (m.closed or 0) for m in counted) >= 3


def test_loud_row_after_the_deadline(spark, tmp_path):
    ddl, events, folder = "stream_id string, seq long, score double", [], str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    add(("a", 0, 0.5), ("a", 1, 0.0))
    go = lambda: drain(live.speaking_now(spark.readStream.schema(ddl).parquet(folder), 0.1, 300), events, str(tmp_path / "ck"))
    go()
    time.sleep(0.5)
    add(("a", 2, 0.9))  # no trigger in between: expiry and the row meet in one
    go()
    assert [r["event"] for r in events] == ["speech", "silence", "speech"]
    time.sleep(0.5)
    add(("b", 0, 0.0))
    go()
    add(("a", 3, 0.9))  # a pause without rows ends nothing
    go()
    assert [r["event"] for r in events] == ["speech", "silence", "speech"]


def test_live_echo_of_two_channels_far_first(spark, tmp_path):
    rng = np.random.default_rng(0)
    far = rng.normal(0, 0.3, 32_000)
    near = np.stack([0.25 * np.concatenate([np.zeros(100), far[:-100]]), 0.2 * np.concatenate([np.zeros(60), far[:-60]])], 1)
    for first in ("far", "near"):
        rows, at = [], 0
        for i in range(20):
            a = slice(i * 1600, (i + 1) * 1600)
            both = {"far": ("far", 1, far[a].tolist(), False), "near": ("near", 2, near[a].ravel().tolist(), i == 19)}
            for side in ("far", "near") if first == "far" or i else ("near", "far"):
                rows.append(("a", at, *both[side]))
                at += 1
        spark.createDataFrame(rows, live.PAIRED).coalesce(1).write.parquet(str(tmp_path / first))
        seen = []
        drain(live.echo_cancelled(spark.readStream.schema(live.PAIRED).parquet(str(tmp_path / first)), 512), seen, str(tmp_path / f"ck-{first}"))
        seen.sort(key=lambda r: r["ord"])
        y = np.concatenate([r["data"] for r in seen if r["data"] is not None]).reshape(-1, 2)
        assert len(y) == len(near) and seen[-1]["closed"]
        if first == "far":
            assert ((near[-8000:] ** 2).sum(0) > 1000 * (y[-8000:] ** 2).sum(0)).all() and seen[-1]["delay"] == 100


@pytest.mark.parametrize("kind", ["wav", "flac"])
def test_recording_of_live_blocks(spark, tmp_path, kind):
    """Three runs append parts, the last batch comes twice as after a restart; one valid file is left for each closed stream."""
    from signalloom.sources import audio, sinks

    x = np.random.default_rng(8).normal(0, 0.4, (6000, 2)).astype(np.float32)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    same = lambda r, c: folds.PerChannel(lambda: folds.LinearResampler(1, 1), c)
    rows = chunk_rows(x, 500, 8000, 2) + [r[:5] + (False,) for r in chunk_rows(x[:900], 300, 8000, 2, "open")]
    kept, sink = [], sinks.recorded(out, kind)

    def again(df, batch):
        df = df.persist()
        sink(df, batch)
        kept.append((spark.createDataFrame(df.collect(), df.schema), batch))

    for part in (rows[:5], rows[5:9], rows[9:]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(folder)
        live.play(live.folded(live.capture(spark, folder), same, 128), again, str(tmp_path / "ck")).awaitTermination()
    sink(*kept[-1])
    sink(*kept[-1])
    files = [f for f in (tmp_path / "out").iterdir() if f.is_file()]
    assert len(files) == 1 and files[0].suffix == "." + kind
    got, rate, channels = audio.decode(files[0].read_bytes())
    assert (rate, channels) == (8000, 2) and np.abs(got - sinks.codes16(np.clip(x, -1, 1)).ravel() / 32768).max() < 1e-6
    assert len([d for d in (tmp_path / "out" / "_parts").iterdir()]) == 1  # that of the open stream
