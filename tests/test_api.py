import numpy as np
import pytest

from signalloom.api import Conditioning, Detector, EchoCancel, File, Microphone, reblocked, record
from signalloom.errors import ChannelError, ConfigError, ConsumedError, DetectorError
from signalloom.operators import align
from signalloom.operators.models import EnergyModel
from signalloom.sources import audio, sinks
from signalloom.streaming import live

X = np.concatenate([np.sin(np.arange(8000) * 0.2) * 0.5, np.zeros(9600)]).astype(np.float32)


def joined(chunks):
    return np.concatenate(chunks.orderBy("seq").toPandas()["data"].to_list())


def test_pass_through_is_the_input(spark):
    f = File.buffer(spark, X, 16_000, 1)
    assert (joined(f.chunks()) == X).all()
    with pytest.raises(ConsumedError):
        f.chunks()


def test_speaking_over_file_time(spark):
    f = File.buffer(spark, X, 16_000, 1, Conditioning(detector=Detector(threshold=0.01, holdoff=0.3)))
    got = f.chunks().orderBy("seq").toPandas()
    assert got["is_speaking"].tolist()[:5] == [True] * 5 and got["is_speaking"].tolist()[-2:] == [False, False] and len(got) == 11


def test_analysis_ignores_conditioning(spark):
    d = Detector("model", threshold=0.5)
    reports = []
    for c in (Conditioning(detector=d), Conditioning(detector=d, highpass=100, agc=-10, limiter=-1, dc_removal=True)):
        w, s = File.buffer(spark, X, 16_000, 1, c).analyze(EnergyModel)
        reports.append((w.orderBy("win").collect(), s.collect()))
    assert reports[0] == reports[1] and len(reports[0][0]) == len(X) // 512 and len(reports[0][1]) == 1
    for c in (Conditioning(), Conditioning(detector=Detector())):
        with pytest.raises(DetectorError):
            File.buffer(spark, X, 16_000, 1, c).analyze(EnergyModel)


def test_open_save_and_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, kind in enumerate(("wav", "flac")):
        (tmp_path / "in" / f"{i}.x").write_bytes(sinks.encode(np.repeat(X, 2), 16_000, 2, kind))
    f = File.open(spark, str(tmp_path / "in"), Conditioning(channels=1))
    paths = f.save(str(tmp_path / "out"), "aiff").toPandas()["path"]
    want = (sinks.codes16(X) / 32768).astype(np.float32)
    for p in paths:
        y, rate, channels = audio.decode(open(p, "rb").read())
        assert rate == 16_000 and channels == 1 and np.abs(y - want).max() <= 1 / 32768
    r = record(audio.scan_audio(spark, str(tmp_path / "in"), 1600), 0.25, str(tmp_path / "rec")).toPandas()["path"]
    assert {len(audio.decode(open(p, "rb").read())[0]) for p in r} == {2 * 4800}
    (tmp_path / "in" / "other").write_bytes(sinks.encode(X, 8000, 1, "wav"))
    with pytest.raises(ConfigError):
        File.open(spark, str(tmp_path / "in"))
    with pytest.raises(ChannelError):
        File.buffer(spark, X, 16_000, 1, Conditioning(channels=2))


def test_live_stream_equals_the_file(spark, tmp_path):
    c = Conditioning(highpass=80, limiter=-3)
    rows = [("a", i, 16_000, 2, np.repeat(X[i * 1600 : (i + 1) * 1600], 2).tolist(), i == 10) for i in range(11)]
    spark.createDataFrame(rows, live.LIVE).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    live.play(Microphone(spark, str(tmp_path / "in"), 16_000, 2, c).read(), lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    got = np.concatenate([r["data"] for r in sorted(seen, key=lambda r: r["seq"])])
    assert np.allclose(got, joined(File.buffer(spark, np.repeat(X, 2), 16_000, 2, c).chunks()), atol=1e-6)


def test_live_options(spark, tmp_path):
    c = Conditioning(frames_per_buffer=500, detector=Detector(holdoff=0.1), dtype="int16")
    rows = [("a", i, 16_000, 1, X[i * 1600 : i * 1600 + 1600].tolist(), i == 10) for i in range(11)]
    spark.createDataFrame(rows, live.LIVE).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    live.play(Microphone(spark, str(tmp_path / "in"), 16_000, 1, c).read(), lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    seen.sort(key=lambda r: r["seq"])
    assert [len(r["data"]) for r in seen] == [500] * 35 + [100] and [r["closed"] for r in seen] == [False] * 35 + [True]
    x = np.concatenate([r["data"] for r in seen]).astype(np.float32)
    assert (x == X).all() and np.concatenate([r["codes"] for r in seen]).tolist() == sinks.codes16(X).tolist()
    assert all(abs(r["score"] - np.sqrt(np.mean(np.square(r["data"])))) < 1e-6 for r in seen)  # nothing transforms this stream
    on = [r["is_speaking"] for r in seen]
    assert on[:16] == [True] * 16 and on[17:19] == [True] * 2 and not any(on[21:])
    with pytest.raises(DetectorError):
        Microphone(spark, str(tmp_path / "in"), 16_000, 1, Conditioning(detector=Detector("model")))


def test_reblocked_and_headers(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("s", i, 8000, 2, rng.normal(size=2 * n).tolist()) for i, n in enumerate([3, 0, 7, 1, 25, 4])] + [("t", 0, 8000, 2, [])]
    got = reblocked(spark.createDataFrame(rows, audio.CHUNKS), 2, 6).orderBy("seq").toPandas()
    want = np.concatenate([r[4] for r in rows]).astype(np.float32)
    assert [len(d) for d in got["data"]] == [12] * 6 + [8] and (np.concatenate(got["data"].to_list()) == want).all() and set(got["stream_id"]) == {"s"}
    codes = np.zeros(64, np.int16)
    for name, data in (("a.wav", sinks.wav(codes, 44_100, 2)), ("b.aiff", sinks.aiff(codes, 44_100, 2)), ("c.flac", sinks.flac(codes, 44_100, 2)), ("d.wav", sinks.wav(codes, 44_100, 2)[:12] + b"LIST" + (70_000).to_bytes(4, "little") + bytes(70_000) + sinks.wav(codes, 44_100, 2)[12:])):
        (tmp_path / name).write_bytes(data)
        assert audio.header_of(data) == (44_100, 2)
    assert audio.header_of(b"RIFF0000WAVE") is None and audio.header_of(b"no") is None
    rows = audio.scan_headers(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {(r.sample_rate, r.channels) for r in rows} == {(44_100, 2)}
    report = sinks.save_streams(spark.createDataFrame([("s", 0, 8000, 1, [0.0, 2.0])], audio.CHUNKS), (tmp_path / "out").as_uri()).collect()[0]
    assert report.clipped_samples == 1 and report.path.startswith("file:") and len(list((tmp_path / "out").iterdir())) == 1


def test_clamp_scan_equals_a_loop():
    rng = np.random.default_rng(1)
    shift, low, high = rng.integers(-5, 6, 200), rng.integers(-3, 2, 200), rng.integers(-2, 9, 200)
    x, want = 0, []
    for s, a, z in zip(shift.tolist(), low.tolist(), high.tolist()):
        x = max(a, min(max(a, z), x + s))
        want.append(x)
    assert align.clamp_scan(shift, low, high).tolist() == want
