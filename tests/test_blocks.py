"""The detector's tap beside delivered blocks, and the echo stage in the chain."""

import pickle

import numpy as np
import pytest

from signalloom.api import Conditioning, Detector, EchoCancel, File, Microphone
from signalloom.operators.models import EnergyModel, WindowDetector
from signalloom.plans import run
from signalloom.streaming import live

RATE, N = 16_000, 16_000


def frames(chunks):
    return chunks.orderBy("seq").collect()


def test_feed_is_the_signal_before_transforming():
    """A constant offset is gone from what is delivered and still in what the detector hears, block by block."""
    feeds = []

    class Heard:
        def __call__(self, feed):
            feeds.append(feed)
            return 0.0

    fold = run.blocks_of(Conditioning(channels=1, dc_removal=True, detector=Detector()), RATE, 1, 320)
    fold.score = Heard()
    out = [b for part in (fold.push(np.full((N, 1), 0.5)), fold.finish()) for b, _ in part]
    assert sum(map(len, out)) == N and [len(f) for f in feeds] == [320] * 50
    assert np.abs(np.concatenate(feeds) - 0.5).max() < 1e-6 and abs(np.concatenate(out)[-N // 4 :].mean()) < 1e-3


@pytest.mark.parametrize("source", [None, 0, 1])
def test_feed_collapses_channels(source):
    left = (np.arange(160) % 8) * 0.125 - 0.5
    x = np.stack([left, left + 0.5], 1)
    fold = run.blocks_of(Conditioning(channels=2, highpass=80, detector=Detector(source=source)), RATE, 2, 64)
    got = [s for b, s in fold.push(x) + fold.finish()]
    feed = x.mean(1) if source is None else x[:, source]
    assert np.allclose(got, [np.sqrt(np.mean(feed[a : a + 64] ** 2)) for a in (0, 64, 128)])


def stereo(spark, x, config, **more):
    return File.buffer(spark, x.astype(np.float32).ravel(), RATE, x.shape[1], config, **more)


def test_scores_don_t_follow_conditioning(spark):
    t = np.arange(N) / RATE
    tone = 0.02 * np.sin(2 * np.pi * 220 * t)
    opposite = np.stack([0.5 * np.sin(2 * np.pi * 220 * t), -0.5 * np.sin(2 * np.pi * 220 * t)], 1)
    for transform in ({}, {"agc": -10}, {"highpass": 100, "limiter": -1.0, "dc_removal": True}):
        d = Detector(threshold=0.1)
        flat = frames(stereo(spark, opposite, Conditioning(channels=2, detector=d, **transform)).chunks())
        assert len(flat) == 10 and max(r["score"] for r in flat) < 1e-6 and not any(r["is_speaking"] for r in flat)
        one = frames(stereo(spark, opposite, Conditioning(channels=2, detector=Detector(threshold=0.1, source=1), **transform)).chunks())
        assert all(abs(r["score"] - 0.5 / np.sqrt(2)) < 1e-3 and r["is_speaking"] for r in one)
        quiet = frames(stereo(spark, tone[:, None], Conditioning(detector=d, **transform)).chunks())
        assert all(abs(r["score"] - 0.02 / np.sqrt(2)) < 1e-4 and not r["is_speaking"] for r in quiet)


def live_rows(spark, rows, folder, ddl=live.LIVE):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def test_live_scores_equal_the_file_s(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 0.1, (N, 2)) * np.repeat(rng.uniform(0, 1, 10), 1600)[:, None]).astype(np.float32)
    rows = [("buffer", i, RATE, 2, x[a : a + 700].ravel().tolist(), a + 700 >= N) for i, a in enumerate(range(0, N, 700))]
    live_rows(spark, rows[::-1], str(tmp_path / "in"))
    for d, factory in ((Detector(threshold=0.05, holdoff=0.1), None), (Detector("model", threshold=0.3, source=1), EnergyModel)):
        c = Conditioning(channels=2, agc=-12, limiter=-1.0, detector=d)
        seen = []
        live.play(Microphone(spark, str(tmp_path / "in"), RATE, 2, c, factory).read(), lambda df, i: seen.extend(df.collect()), str(tmp_path / f"ck-{d.kind}")).awaitTermination()
        seen.sort(key=lambda r: r["seq"])
        want = frames(stereo(spark, x, c).chunks(factory))
        assert np.allclose([r["score"] for r in seen], [r["score"] for r in want], atol=1e-6) and [r["is_speaking"] for r in seen] == [r["is_speaking"] for r in want]
        assert np.allclose(np.concatenate([r["data"] for r in seen]), np.concatenate([r["data"] for r in want]), atol=1e-6)
        if factory:
            model = WindowDetector(EnergyModel(), RATE, 512)
            assert np.allclose([r["score"] for r in want], [max(model.scores(x[a : a + 1600, 1].astype(float))) for a in range(0, N, 1600)], atol=1e-6)


def test_blocks_survive_storing():
    c = Conditioning(channels=2, sample_rate=8000, agc=-12, highpass=80, detector=Detector("model"), echo=EchoCancel(reference_rate=16_000))
    rng = np.random.default_rng(1)
    x, far = rng.normal(0, 0.2, (4000, 2)), rng.normal(0, 0.2, 8000)
    kept, stored = run.blocks_of(c, 48_000, 2, 100), run.blocks_of(c, 48_000, 2, 100)
    a, b = [], []
    for i in range(0, 4000, 500):
        stored = pickle.loads(pickle.dumps(stored))
        for f, out in ((kept, a), (stored, b)):
            f.score.bind(EnergyModel)
            f.push_reference(far[2 * i : 2 * i + 1000])
            out += f.push(x[i : i + 500])
    for f, out in ((kept, a), (stored, b)):
        f.score.bind(EnergyModel)
        out += f.finish()
    assert len(a) == len(b) == 7 and all((u == w).all() and s == t for (u, s), (w, t) in zip(a, b))


@pytest.mark.parametrize("reference_rate", [16_000, 48_000])
def test_echo_in_the_chain(spark, tmp_path, reference_rate):
    """The case of 400 samples' delay, two channels: 30 dB in the file's chain and in the live one, and equal blocks."""
    rng = np.random.default_rng(3)
    k = reference_rate // RATE
    smooth = np.repeat(rng.normal(0, 0.3, 4 * RATE), k)
    smooth = np.convolve(smooth, np.ones(k) / k, "same") if k > 1 else smooth
    heard = smooth[::k]
    near = np.stack([0.25 * np.concatenate([np.zeros(400), heard[:-400]]), 0.3 * np.concatenate([np.zeros(250), heard[:-250]])], 1).astype(np.float32)
    far = np.repeat(smooth[:, None], 2, 1).astype(np.float32)  # two channels, averaged
    c = Conditioning(channels=2, limiter=-1.0, echo=EchoCancel(tail_ms=64, reference_rate=reference_rate, reference_channels=2))
    reference = spark.createDataFrame([("buffer", i, reference_rate, 2, far[a : a + 320 * k].ravel().tolist()) for i, a in enumerate(range(0, len(far), 320 * k))], "stream_id string, seq long, sample_rate int, channels int, data array<float>")
    source = spark.createDataFrame([("buffer", i, RATE, 2, near[a : a + 320].ravel().tolist()) for i, a in enumerate(range(0, len(near), 320))], reference.schema)
    got = frames(File(source, RATE, 2, c, reference).chunks())
    y = np.concatenate([r["data"] for r in got]).reshape(-1, 2)
    window = slice(3 * RATE, 3 * RATE + RATE // 2)
    removed = 10 * np.log10((near[window] ** 2).sum(0) / (y[window] ** 2).sum(0))
    assert len(y) == len(near) and (removed > 30).all(), removed
    assert got[-1]["echo"]["dropped"] == 0 and abs(got[-1]["echo"]["delays"][0] - 400) <= 1 and len(got[-1]["echo"]["erle_db"]) == 2
    if reference_rate == RATE:
        rows, at = [], 0
        for f, n in zip(reference.orderBy("seq").collect(), source.orderBy("seq").collect()):
            rows += [("buffer", at, f.sample_rate, 2, f.data, False, "far"), ("buffer", at + 1, RATE, 2, n.data, len(rows) == 2 * (len(near) // 320 - 1), "near")]
            at += 2
        live_rows(spark, rows[::-1], str(tmp_path / "in"), live.SIDED)
        seen = []
        live.play(Microphone(spark, str(tmp_path / "in"), RATE, 2, c).read(), lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
        seen.sort(key=lambda r: r["seq"])
        assert np.allclose(np.concatenate([r["data"] for r in seen]), y.ravel(), atol=1e-6) and seen[-1]["echo"]["delays"] == got[-1]["echo"]["delays"]


def test_echo_without_reference_is_the_input(spark):
    x = np.random.default_rng(5).normal(0, 0.2, (4801, 1)).astype(np.float32)
    got = frames(stereo(spark, x, Conditioning(echo=EchoCancel())).chunks())
    assert (np.concatenate([r["data"] for r in got]) == x.ravel()).all() and got[-1]["echo"]["silence"] >= 4801
