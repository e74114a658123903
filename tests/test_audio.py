import numpy as np
import pytest

from signalloom.errors import ChannelError, ConfigError, ConsumedError, DetectorError, DeviceError, FormatError
from signalloom.operators import devices, folds
from signalloom.plans import run
from signalloom.plans.config import Conditioning, Detector, EchoCancel, detector_feed_rate, plan
from signalloom.sources import audio, sinks

GRID = ((np.arange(4000) % 1201 - 600) / 32768).astype(np.float32)


@pytest.mark.parametrize("kind", ["wav", "aiff", "flac"])
@pytest.mark.parametrize("channels", [1, 2])
def test_round_trip_on_the_grid(kind, channels):
    x, rate, n = audio.decode(sinks.encode(GRID, 16_000, channels, kind))
    assert (x == GRID).all() and rate == 16_000 and n == channels


@pytest.mark.parametrize("kind", ["wav", "aiff", "flac"])
def test_loud_noise_round_trip(kind):
    x = np.random.default_rng(0).uniform(-1, 1, 9000).astype(np.float32)
    y, _, _ = audio.decode(sinks.encode(x, 44_100, 3, kind))
    assert (y == (sinks.codes16(x) / 32768).astype(np.float32)).all()


def test_repair_and_clamp():
    x = GRID[:1600].copy()
    x[[10, 20, 30]] = 1.85, -1.85, 2.5
    y, clipped, bad = sinks.repaired(x)
    assert (clipped, bad) == (3, 0) and sinks.codes16(y)[[10, 20, 30]].tolist() == [32767, -32768, 32767]
    x[[10, 20, 30]] = np.nan, np.inf, -np.inf
    y, clipped, bad = sinks.repaired(x)
    assert (clipped, bad) == (0, 3) and sinks.codes16(y)[[10, 20, 30]].tolist() == [0, 32767, -32768]


def test_codes():
    x = np.array([0, 1, -1, 0.5, 1.5, -1.5, 1.41, 2, 8.5, 1.00001, np.nan], np.float32)
    assert sinks.codes16(x).tolist() == [0, 32767, -32768, 16384, 32767, -32768, 32767, 32767, 32767, 32767, 0]


def test_g711_and_eight_bit():
    code = np.arange(256, dtype=np.uint8)
    mu, a = audio.mu_law(code), audio.a_law(code)
    for x in (mu, a):
        assert np.abs(x).max() <= 1 and x.max() > 0.9 and x.min() < -0.9 and np.median(np.abs(x)) < 0.15
    assert not np.allclose(mu, a)
    assert audio.pcm(bytes(range(256)), 8, False).tolist() == [(b - 128) / 128 for b in range(256)]
    assert audio.pcm(b"\x00\x00\x80\xff\xff\x7f\x01", 24, False).tolist() == [-1.0, 8388607 / 8388608]


def test_formats():
    assert sinks.format_of("a/b.WAV") == "wav" and sinks.format_of("x.mp3", "flac") == "flac"
    for bad in ("x", "x.mp3"):
        with pytest.raises(FormatError):
            sinks.format_of(bad)
    with pytest.raises(FormatError):
        sinks.encode(np.zeros(9), 16_000, 9, "flac")
    with pytest.raises(FormatError):
        audio.decode(b"nothing of the kind")


def test_scan_and_save(spark, tmp_path):
    for kind in ("wav", "aiff", "flac"):
        (tmp_path / f"{kind}.bin").write_bytes(sinks.encode(GRID, 16_000, 2, kind))
    chunks = audio.scan_audio(spark, str(tmp_path), 700)
    got = {k: np.concatenate(g.sort_values("seq")["data"].to_list()) for k, g in chunks.toPandas().groupby("stream_id")}
    assert len(got) == 3 and all((x == GRID).all() for x in got.values())
    report = sinks.save_streams(chunks, str(tmp_path / "out"), "flac").toPandas()
    assert len(report) == 3 and (report["clipped_samples"] == 0).all()
    assert all((audio.decode(open(p, "rb").read())[0] == GRID).all() for p in report["path"])


def test_buffer_and_bytes(spark):
    b = audio.buffer_source(spark, "a", GRID, 16_000, 2)
    assert b.count() == 2
    with pytest.raises(ConfigError):
        audio.buffer_source(spark, "a", GRID[:3], 16_000, 2)
    out = audio.from_bytes(audio.to_bytes(b, "data", "int16"), "payload", "int16", "again").orderBy("seq").toPandas()
    assert (np.concatenate(out["again"].to_list()) == GRID).all()


def test_layout_rules():
    assert Conditioning().layout(2)[0] == "mean" and Conditioning(channels=2).layout(2)[0] == "identity"
    assert Conditioning(channels=2, channel_map=(1, 1)).delivered_channels(4) == 2
    for c, source in ((Conditioning(channels=3), 2), (Conditioning(channels=2), 4), (Conditioning(channel_map=(5,)), 2)):
        with pytest.raises(ChannelError):
            c.layout(source)
    for bad in ({"sample_rate": 999}, {"sample_rate": 384_001}, {"frames_per_buffer": 63}, {"agc": -2}, {"limiter": 0.5}, {"highpass": 90}, {"dtype": "int24"}, {"channels": 0}):
        with pytest.raises(ConfigError):
            Conditioning(**bad)
    with pytest.raises(ConfigError):
        EchoCancel(tail_ms=10)
    with pytest.raises(ConfigError):
        Detector(threshold=1.5)
    assert detector_feed_rate(8000) == (8000, 256) and detector_feed_rate(44_100) == (16_000, 512)


def test_plan_order_and_elision():
    assert plan(Conditioning(), 16_000, 1) == []
    c = Conditioning(limiter=-1, agc=-18, highpass=80, dc_removal=True)
    assert [s.name for s in plan(c, 48_000, 2)] == ["sanitize", "downmix", "resample", "dc", "highpass", "agc", "limiter"]


def test_condition_and_analyze(spark):
    x = np.concatenate([np.sin(np.arange(16_000) * 0.2) * 0.5, np.zeros(16_000)]).astype(np.float32)
    chunks = audio.buffer_source(spark, "a", np.repeat(x, 2), 16_000, 2)
    c = Conditioning(limiter=-3, highpass=80, detector=Detector(threshold=0.01, holdoff=0.3))
    out = run.condition(chunks, c, 16_000, 2).orderBy("seq").toPandas()
    got = np.concatenate(out["data"].to_list())
    want = folds.Limiter(-3, 16_000).process(folds.high_pass(80, 16_000).process(x.astype(float)))
    assert len(got) == len(x) and np.allclose(got, want, atol=1e-5)
    windows, segs = run.analyze(chunks, c, 16_000, 2, run.energy)
    assert windows.count() == 62 and [(r.start, r.end) for r in segs.collect()] == [(0.0, 1.024)]
    with pytest.raises(DetectorError):
        run.analyze(chunks, c, 16_000, 2)
    r = run.Recording(chunks)
    r.take()
    with pytest.raises(ConsumedError):
        r.take()


def test_devices(spark):
    d = spark.createDataFrame([(0, "USB Mic", "a"), (1, "USB Mic", "b"), (2, "Line", None)], "index int, name string, id string")
    w = devices.with_default(d, "b")
    assert devices.select_device(w)["index"] == 1 and devices.select_device(w, name="line")["id"] == "" and devices.select_device(w, id="a")["index"] == 0
    for bad in ({"name": "usb"}, {"name": "none"}, {"index": 9}, {"id": ""}):
        with pytest.raises(DeviceError):
            devices.select_device(w, **bad)
    with pytest.raises(DeviceError):
        devices.select_device(devices.with_default(d, None))


def test_ranges_equal_whole_files(spark, tmp_path):
    import struct

    from pyspark.sql import functions as F

    from signalloom.sources import ranges

    x = np.random.default_rng(9).uniform(-1, 1, 30_000).astype(np.float32)
    float_wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 2, 8000, 64_000, 8, 32) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 4 * len(x)) + x.tobytes()
    long_wav = b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, 0, 2 * len(x), 0, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32_000, 4, 16) + b"data\xff\xff\xff\xff" + sinks.codes16(x).tobytes()
    files = {"a.wav": sinks.encode(x, 8000, 2, "wav"), "b.aiff": sinks.encode(x, 8000, 2, "aiff"), "c.flac": sinks.encode(x[:9000], 8000, 2, "flac"), "d.wav": float_wav, "e.wav": sinks.encode(x[:0], 8000, 2, "wav"), "f.wav": sinks.encode(x, 8000, 2, "wav")[:-7]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = audio.scan_audio(spark, str(tmp_path), 160)
    got = ranges.scan_ranges(spark, str(tmp_path), 160, size=10_000)
    assert got.count() == want.count() > 400 and got.exceptAll(want).count() == 0
    planned = ranges.ranges(spark, str(tmp_path), 160, size=10_000).groupBy(F.element_at(F.split("path", "/"), -1)).count().collect()
    assert {r[0]: r[1] for r in planned} == {"a.wav": 7, "b.aiff": 7, "c.flac": 1, "d.wav": 14, "f.wav": 7}  # 120,000 bytes by 7 blocks of 1,280
    (tmp_path / "g.wav").write_bytes(long_wav)
    only = ranges.scan_ranges(spark, str(tmp_path), 160, "g.wav", 10_000).orderBy("seq").toPandas()["data"]
    assert (np.concatenate(only.to_list()) == (sinks.codes16(x) / 32768).astype(np.float32)).all()


def test_a_file_above_two_gigabytes_is_planned_by_its_header(spark, tmp_path):
    from signalloom.sources import ranges

    size = 3 << 30
    with open(tmp_path / "long.wav", "wb") as f:  # a sparse file
        f.write(sinks.wav_header(size // 2, 48_000, 2))
        f.truncate(44 + size)
    plan = ranges.ranges(spark, str(tmp_path)).orderBy("seq").collect()
    step = plan[1].at - plan[0].at
    assert len(plan) == -(-size // step) and sum(r["size"] for r in plan) == size and step % (4 * 1600) == 0 and step <= 64 << 20
    assert all(r.seq == (r["at"] - 44) // 6400 for r in plan)
