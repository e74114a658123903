"""Registered queries of the signal engine over the driver's tables, and the SQL that checks them.

There is no audio in the tables. Stand-ins: `events` are streams per user in time order with amplitude
value / 397; `embeddings` are short blocks, read as frames of two or four interleaved channels where a layout
matters. Folds run in double precision here, and both sides round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import samples as S
from .operators import align, devices, folds, models, quality
from .operators import windows as W
from .plans import run
from .plans.config import Conditioning, Detector

SIZE, RATE, LEVEL, HOLDOFF = 8, 16.0, 0.15, 0.6
GAIN = 4.0
SCALE = 397.0  # no round number, so that no result ends on a half of the last digit kept


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (stream_id, pos, x)."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", (F.col("value") / SCALE).alias("x"))
    return W.positions(e, "stream_id", "ts", "event_id").select("stream_id", "pos", "x")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (vec_id, data) in double precision."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("data"))


def _spread(df: DataFrame, data, name: str = "y", digits: int | None = 6) -> DataFrame:
    out = df.select("vec_id", F.posexplode(data).alias("pos", name))
    return out if digits is None else out.withColumn(name, F.round(F.col(name), digits))


EVENTS = "s AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 397.0 AS x FROM events)"
BLOCKS = "b AS (SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"
WINDOWS = f"{EVENTS}, w AS (SELECT stream_id, pos // {SIZE} AS win, sqrt(avg(x * x)) AS p, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) = {SIZE}), v AS (SELECT stream_id, win, win * {SIZE} / {RATE} AS t0, (win + 1) * {SIZE} / {RATE} AS t1, p, p >= {LEVEL} AS speech FROM w)"
STATES = f"{WINDOWS}, z AS (SELECT *, max(CASE WHEN speech THEN t1 END) OVER (PARTITION BY stream_id ORDER BY win ROWS UNBOUNDED PRECEDING) AS last_loud FROM v), st AS (SELECT stream_id, win AS seq, t0, t1, p, coalesce(speech OR t1 - last_loud < {HOLDOFF}, false) AS speaking FROM z)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.score_windows(_samples(spark, sf_dir), SIZE, RATE, LEVEL)


def vad_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy score of count windows."""
    return _windows(spark, sf_dir).withColumn("probability", F.round("probability", 6))


def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments by energy, joined within the holdoff."""
    return W.segments(_windows(spark, sf_dir), HOLDOFF)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir).select("stream_id", F.col("win").alias("seq"), "start", "end", F.col("probability").alias("score"))
    return W.speaking_state(w, LEVEL, HOLDOFF)


def speaking_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("stream_id", "seq", "end", F.round("score", 6).alias("score"), "is_speaking")


def speech_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.transitions(_states(spark, sf_dir)).select("stream_id", "seq", "event")


def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.chunk_scores(_windows(spark, sf_dir), 3, LEVEL).withColumn("score", F.round("score", 6))


def rebatch_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.rebatched(_samples(spark, sf_dir), 10)
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return r.select("stream_id", "seq", F.size("data").cast("long").alias("n"), F.round(F.element_at("data", 1), 6).alias("first"), F.round(F.element_at("data", -1), 6).alias("last"), F.round(total, 6).alias("total"))


def chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _samples(spark, sf_dir).groupBy("stream_id", F.floor(F.col("pos") / 7).alias("seq")).agg(F.count("*").alias("frames"))
    return W.chunk_positions(c, RATE)


def overlap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = W.overlapping_frames(_samples(spark, sf_dir), 8)
    return f.groupBy("stream_id", "frame").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.round(F.sum(F.col("x") * F.col("at")), 6).alias("weighted"))


def context_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = W.rebatched(_samples(spark, sf_dir), SIZE).filter(F.size("data") == SIZE).withColumnRenamed("seq", "win")
    out = W.context_carried(whole, SIZE, 2)
    return out.select("stream_id", "win", F.round(F.get("data", F.lit(0)), 6).alias("c0"), F.round(F.get("data", F.lit(1)), 6).alias("c1"), F.round(F.get("data", F.lit(2)), 6).alias("x0"))


def overrun_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded capture queue that nobody reads drops the newest."""
    q = W.dropped_newest(_samples(spark, sf_dir).withColumnRenamed("pos", "seq"), 20)
    return q.groupBy("stream_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def ring_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded ring keeps the newest."""
    r = W.kept_newest(_samples(spark, sf_dir).withColumnRenamed("pos", "seq"), 5)
    return r.groupBy("stream_id").agg(F.min("seq").alias("oldest"), F.max("seq").alias("newest"), F.count("*").alias("n"))


def record_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _samples(spark, sf_dir).groupBy("stream_id", F.floor(F.col("pos") / 7).alias("seq")).agg(F.count("*").alias("frames"))
    return W.taken(c, 30).groupBy("stream_id").agg(F.count("*").alias("chunks"), F.sum("frames").alias("frames"))


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order as pushes and reads of varying size."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id")
    e = W.positions(e, "stream_id", "ts", "event_id", name="ord")
    return e.select("stream_id", "ord", (F.col("event_id") * 7 % 11).alias("pushed"), (F.col("event_id") * 5 % 9).alias("wanted"))


def playback_underrun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.playback(_pushes(spark, sf_dir)).select("stream_id", "ord", "played", "underrun")


def reference_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.reference_levels(_pushes(spark, sf_dir)).select("stream_id", "ord", "queued", "silence")


def reference_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    far = s.filter(F.col("pos") % 3 != 0).withColumn("pos", F.col("pos") - F.floor(F.col("pos") / 3) - 1)
    a = align.aligned(s, far)
    return a.groupBy("stream_id").agg(F.count_if("missing").alias("silence"), F.round(F.sum(F.col("x") * F.col("far")), 6).alias("product"))


def reference_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.capped_levels(_pushes(spark, sf_dir), 12).groupBy("stream_id").agg(F.sum("silence").alias("silence"), F.sum("dropped").alias("dropped"))


def rms_subblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"), "data")
    return b.select("vec_id", "part", F.round(S.rms(F.slice("data", F.col("part") * 16 + 1, 16)), 6).alias("rms"))


def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.downmix(F.col("data"), 4))


def select_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.select_channel(F.col("data"), 4, 2))


def channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.map_channels(F.col("data"), 2, [1, 0, 1]))


def planar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.interleaved(S.deinterleaved(F.col("data"), 4), 4))


def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).select("vec_id", F.posexplode(S.deinterleaved(F.col("data"), 2)).alias("channel", "plane"))
    return b.select("vec_id", "channel", F.posexplode("plane").alias("pos", "y")).withColumn("y", F.round("y", 6))


def pcm16_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), F.transform("data", lambda x: S.pcm16(x * GAIN)), "code", None)


def pcm16_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), F.transform("data", lambda x: S.pcm16_rounded(x * GAIN)), "code", None)


def pcm16_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), F.transform("data", lambda x: S.from_pcm16(S.pcm16(x))))


def frame_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.frame_peaks(F.col("data"), 4))


def frame_mean_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.frame_mean_squares(F.col("data"), 4))


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with gain, and not-a-number and infinities by id."""
    k = F.col("vec_id")
    bad = lambda x, i: F.when((i == 3) & (k % 5 == 0), float("nan")).when((i == 7) & (k % 7 == 0), float("inf")).when((i == 9) & (k % 11 == 0), float("-inf")).otherwise(x * GAIN)
    return _blocks(spark, sf_dir).select("vec_id", F.transform("data", bad).alias("data"))


def sanitize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spoiled(spark, sf_dir)
    total = F.aggregate(F.transform("data", S.finite_or_zero), F.lit(0.0), lambda a, x: a + x)
    return d.select("vec_id", F.size(F.filter("data", lambda x: ~S.is_finite(x))).cast("long").alias("non_finite"), F.round(total, 6).alias("total"))


def clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spoiled(spark, sf_dir).select("vec_id", F.explode("data").alias("x"))
    y = S.repaired(F.col("x"))
    return d.groupBy("vec_id").agg(F.count_if(F.abs(y) > 1).alias("clipped_samples"), F.count_if(~S.is_finite(F.col("x"))).alias("non_finite_samples"), F.round(F.sum(S.clamped(y)), 6).alias("total"))


def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_blocks(spark, sf_dir), S.linear_resampled(F.col("data"), 2.5))


def si_sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    other = b.select((F.col("vec_id") + 1).alias("vec_id"), F.col("data").alias("other"))
    return b.join(other, "vec_id").select("vec_id", F.round(S.si_sdr(F.col("data"), F.zip_with("data", "other", lambda x, y: x + 0.5 * y)), 4).alias("si_sdr"))


def seg_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).select("stream_id", "pos", F.col("x").alias("ref"), (F.col("x") * F.when(F.col("pos") % 2 == 0, 0.9).otherwise(1.2)).alias("est"))
    return quality.seg_snr(s, 16).withColumn("seg_snr", F.round("seg_snr", 4))


def fw_seg_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("stream_id"), "ts", "event_id", (F.col("value") / SCALE).alias("ref"))
    s = W.positions(s, "stream_id", "ts", "event_id").withColumn("est", F.col("ref") * F.when(F.col("pos") % 2 == 0, 0.9).otherwise(1.1))
    return quality.fw_seg_snr(s.select("stream_id", "pos", "ref", "est")).withColumn("fw_seg_snr", F.round("fw_seg_snr", 4))


def dc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_samples(_samples(spark, sf_dir), folds.dc_blocker).withColumn("y", F.round("y", 6))


def highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_samples(_samples(spark, sf_dir), lambda: folds.high_pass(80, 16_000)).withColumn("y", F.round("y", 6))


def limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_samples(_samples(spark, sf_dir), lambda: folds.Limiter(-1.0, 16_000)).withColumn("y", F.round("y", 6))


def agc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_samples(_samples(spark, sf_dir), lambda: folds.GainControl(-18, 16_000)).withColumn("y", F.round("y", 6))


def linear_resample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carried resampler over blocks of ten samples per stream: samples out and their sum."""
    chunks = W.rebatched(_samples(spark, sf_dir), 10).select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.lit(16_000).alias("sample_rate"), F.lit(1).alias("channels"), F.col("data").cast("array<float>").alias("data"))
    out = folds.fold_chunks(chunks, lambda r, c: folds.PerChannel(lambda: folds.LinearResampler(16_000, 10_000), c), 10_000)
    return out.groupBy("stream_id").agg(F.sum(F.size("data")).alias("n"), F.round(F.sum(F.aggregate("data", F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))


def polyphase_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = W.rebatched(_samples(spark, sf_dir), 16).select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.lit(48_000).alias("sample_rate"), F.lit(1).alias("channels"), F.col("data").cast("array<float>").alias("data"))
    out = folds.fold_chunks(chunks, lambda r, c: folds.PerChannel(lambda: folds.PolyphaseResampler(48_000, 16_000), c), 16_000)
    return out.groupBy("stream_id").agg(F.sum(F.size("data")).alias("n"))


def polyphase_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """44.1 to 16 kHz, of 160 phases, sample by sample."""
    chunks = W.rebatched(_samples(spark, sf_dir), 16).select("stream_id", F.col("seq").cast("long").alias("seq"), F.lit(44_100).alias("sample_rate"), F.lit(1).alias("channels"), F.col("data").cast("array<float>").alias("data"))
    out = folds.fold_chunks(chunks, lambda r, c: folds.PerChannel(lambda: folds.PolyphaseResampler(44_100, 16_000), c), 16_000)
    base = F.sum(F.size("data")).over(Window.partitionBy("stream_id").orderBy("seq")) - F.size("data")
    y = out.withColumn("base", base).select("stream_id", "base", F.posexplode("data").alias("i", "y"))
    return y.select("stream_id", (F.col("base") + F.col("i")).alias("pos"), F.round(F.col("y").cast("double"), 5).alias("y"))


def echo_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    far = s.withColumn("pos", F.col("pos") + 2)
    c = align.aligned(s, far)
    y = align.echo_cancelled(c, 32, 16)
    return align.echo_metrics(c.join(y, ["stream_id", "pos"])).withColumn("erle_db", F.round("erle_db", 4))


def echo_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canceller beside a silent reference: what was captured comes back as it was."""
    s = _samples(spark, sf_dir)
    c = align.aligned(s, s.filter(F.col("pos") % 4 == 1).withColumn("x", F.lit(0.0)))
    y = align.echo_cancelled(c, 32, 16)
    m = align.echo_metrics(c.join(y, ["stream_id", "pos"])).withColumn("erle_db", F.round("erle_db", 4))
    return m.join(y.groupBy("stream_id").agg(F.round(F.sum(F.col("y") * (F.col("pos") % 7 + 1)), 5).alias("weighted")), "stream_id")


def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model hook with its stand-in model."""
    w = models.score_stream_windows(_samples(spark, sf_dir), "energy", models.EnergyModel, 16, SIZE)
    return w.withColumn("probability", F.round("probability", 5))


def device_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as devices: a name part, and the default by id."""
    d = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("index"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey").cast("string")).alias("id"))
    return devices.with_default(devices.named(d, "SUPPLIER#0000000"), "7")


def format_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/rec/"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".wav", ".AIFF", ".flac", ".mp3", ""))), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return u.select("page_id", "path", S.file_format(F.col("path")).alias("format"))


def save_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving each block would repair and clamp."""
    d = _spoiled(spark, sf_dir)
    count = lambda test: F.size(F.filter("data", test)).cast("long")
    return d.select("vec_id", count(lambda x: F.abs(S.repaired(x)) > 1).alias("clipped_samples"), count(lambda x: ~S.is_finite(x)).alias("non_finite_samples"))


LONG = 4096  # rows of a segment


def _one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream in the order of their numbers."""
    return _table(spark, sf_dir, "events").select(F.lit(0).alias("stream_id"), F.col("event_id").alias("pos"), (F.col("value") / SCALE).alias("x"))


def long_dc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.scan_samples(_one_stream(spark, sf_dir), folds.dc_blocker, size=LONG).withColumn("y", F.round("y", 6))


def long_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.scan_samples(_one_stream(spark, sf_dir), lambda: folds.high_pass(80, 16_000), size=LONG).withColumn("y", F.round("y", 6))


def long_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    blocks = _table(spark, sf_dir, "events").select(F.lit(0).alias("stream_id"), e.alias("ord"), (e * 7 % 11).alias("pushed"), (e * e % 9).alias("wanted"))
    return align.capped_levels_scanned(blocks, 12, LONG).select("ord", "queued", "silence", "dropped")


def long_speaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.score_windows(_one_stream(spark, sf_dir), SIZE, RATE, LEVEL).select("stream_id", F.col("win").alias("seq"), "end", F.col("probability").alias("score"))
    return W.speaking_state_scanned(w, LEVEL, HOLDOFF, LONG // SIZE).select("seq", "end", F.round("score", 6).alias("score"), "is_speaking")


def detector_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two channels (x, -x / 2) by their mean, beside blocks of 64 frames that went through high-pass and gain control."""
    both = F.flatten(F.transform("data", lambda x: F.array(x, x * -0.5))).cast("array<float>")
    chunks = W.rebatched(_samples(spark, sf_dir), 16).select("stream_id", F.col("seq").cast("long").alias("seq"), F.lit(16_000).alias("sample_rate"), F.lit(2).alias("channels"), both.alias("data"))
    config = Conditioning(channels=2, highpass=80, agc=-18, detector=Detector(threshold=LEVEL))
    out = run.delivered(chunks, config, 16_000, 2, 64)
    return out.select("stream_id", "seq", (F.size("data") / 2).cast("long").alias("frames"), F.round("score", 5).alias("score"))


QUERIES = {f.__name__: f for f in (
    vad_segments, vad_windows, speaking_state, speech_events, chunk_scores, rebatch_fixed, chunk_positions, overlap_frames, context_carry,
    overrun_drop, ring_evict, record_take, playback_underrun, reference_queue, reference_align, reference_capped, rms_subblock, downmix,
    select_channel, channel_map, planar_roundtrip, deinterleave, pcm16_encode, pcm16_round, pcm16_decode, frame_peaks, frame_mean_squares,
    sanitize_report, clip_report, linear_resample, si_sdr, seg_snr, fw_seg_snr, dc_block, highpass, limiter, agc, linear_resample_stream,
    polyphase_resample, echo_cancel, echo_silent, model_windows, device_match, format_resolve, save_report,
    long_dc_block, long_highpass, long_queue, long_speaking, polyphase_values, detector_tap,
)}

_PUSH = "p AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_id * 7 % 11 AS pushed, event_id * 5 % 9 AS wanted FROM events)"
_QUEUE = f"{_PUSH}, c AS (SELECT *, sum(pushed - wanted) OVER o AS sm FROM p WINDOW o AS (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, CAST(sm - least(0, min(sm) OVER o) AS BIGINT) AS queued FROM c WINDOW o AS (PARTITION BY stream_id ORDER BY ord ROWS UNBOUNDED PRECEDING)), u AS (SELECT *, CAST(greatest(0, wanted - coalesce(lag(queued) OVER (PARTITION BY stream_id ORDER BY ord), 0) - pushed) AS BIGINT) AS silence FROM q)"
_CHUNKS = f"{EVENTS}, c AS (SELECT stream_id, CAST(pos // 7 AS BIGINT) AS seq, count(*) AS frames FROM s GROUP BY 1, 2)"
_SPOILED = f"{BLOCKS}, d AS (SELECT vec_id, pos, CASE WHEN pos = 3 AND vec_id % 5 = 0 THEN 'nan'::DOUBLE WHEN pos = 7 AND vec_id % 7 = 0 THEN 'inf'::DOUBLE WHEN pos = 9 AND vec_id % 11 = 0 THEN '-inf'::DOUBLE ELSE x * {GAIN} END AS x FROM b)"

ORACLES: dict[str, str] = {
    "vad_windows": f'WITH {WINDOWS} SELECT stream_id, win, t0 AS start, t1 AS "end", round(p, 6) + 0 AS probability, speech AS is_speech FROM v',
    "vad_segments": f'WITH {WINDOWS}, g AS (SELECT *, CASE WHEN t0 - lag(t1) OVER o <= {HOLDOFF} THEN 0 ELSE 1 END AS fresh FROM v WHERE speech WINDOW o AS (PARTITION BY stream_id ORDER BY win)), k AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY stream_id ORDER BY win ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS seg FROM g) SELECT stream_id, seg, min(t0) AS start, max(t1) AS "end" FROM k GROUP BY 1, 2',
    "speaking_state": f'WITH {STATES} SELECT stream_id, seq, t1 AS "end", round(p, 6) + 0 AS score, speaking AS is_speaking FROM st',
    "speech_events": f"WITH {STATES}, c AS (SELECT *, coalesce(lag(speaking) OVER (PARTITION BY stream_id ORDER BY seq), false) AS before FROM st) SELECT stream_id, seq, CASE WHEN speaking THEN 'speech' ELSE 'silence' END AS event FROM c WHERE speaking <> before",
    "chunk_scores": f"WITH {WINDOWS} SELECT stream_id, win // 3 AS seq, round(max(p), 6) + 0 AS score, max(p) >= {LEVEL} AS is_speech FROM w GROUP BY 1, 2",
    "rebatch_fixed": f"WITH {EVENTS} SELECT stream_id, pos // 10 AS seq, count(*) AS n, round(arg_min(x, pos), 6) + 0 AS first, round(arg_max(x, pos), 6) + 0 AS last, round(sum(x), 6) + 0 AS total FROM s GROUP BY 1, 2",
    "chunk_positions": f'WITH {_CHUNKS} SELECT stream_id, seq, frames, row_number() OVER o - 1 AS sequence, (sum(frames) OVER o - frames) / {RATE} AS start, sum(frames) OVER o / {RATE} AS "end" FROM c WINDOW o AS (PARTITION BY stream_id ORDER BY seq)',
    "overlap_frames": f"WITH {EVENTS}, f AS (SELECT stream_id, pos // 8 + k AS frame, pos - (pos // 8 + k - 1) * 8 AS pos_at, x FROM s, (SELECT unnest([0, 1]) AS k)) SELECT stream_id, frame, count(*) AS n, min(pos_at) AS first_at, round(sum(x * pos_at), 6) + 0 AS weighted FROM f GROUP BY 1, 2",
    "context_carry": f"WITH {EVENTS}, w AS (SELECT stream_id, pos // {SIZE} AS win, list(x ORDER BY pos) AS d FROM s GROUP BY 1, 2 HAVING count(*) = {SIZE}) SELECT stream_id, win, round(coalesce(lag(d[7]) OVER o, 0), 6) + 0 AS c0, round(coalesce(lag(d[8]) OVER o, 0), 6) + 0 AS c1, round(d[1], 6) + 0 AS x0 FROM w WINDOW o AS (PARTITION BY stream_id ORDER BY win)",
    "overrun_drop": f"WITH {EVENTS} SELECT stream_id, count(*) FILTER (WHERE pos < 20) AS kept, count(*) FILTER (WHERE pos >= 20) AS dropped FROM s GROUP BY 1",
    "ring_evict": f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos DESC) AS k FROM s) SELECT stream_id, min(pos) AS oldest, max(pos) AS newest, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1",
    "record_take": f"WITH {_CHUNKS}, t AS (SELECT *, sum(frames) OVER (PARTITION BY stream_id ORDER BY seq) - frames AS before FROM c) SELECT stream_id, count(*) AS chunks, CAST(sum(frames) AS BIGINT) AS frames FROM t WHERE before < 30 GROUP BY 1",
    "playback_underrun": f"WITH {_QUEUE} SELECT stream_id, ord, wanted - silence AS played, silence AS underrun FROM u",
    "reference_queue": f"WITH {_QUEUE} SELECT stream_id, ord, queued, silence FROM u",
    "reference_align": f"WITH {EVENTS}, f AS (SELECT stream_id, pos - pos // 3 - 1 AS pos, x AS far FROM s WHERE pos % 3 <> 0) SELECT stream_id, count(*) FILTER (WHERE far IS NULL) AS silence, round(sum(x * coalesce(far, 0)), 6) + 0 AS product FROM s LEFT JOIN f USING (stream_id, pos) GROUP BY 1",
    "reference_capped": f"WITH RECURSIVE {_PUSH}, r AS (SELECT stream_id, CAST(-1 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS level, CAST(0 AS BIGINT) AS silence, CAST(0 AS BIGINT) AS dropped FROM p GROUP BY 1 UNION ALL SELECT p.stream_id, p.ord, greatest(0, r.level + least(p.pushed, 12 - r.level) - p.wanted), greatest(0, p.wanted - r.level - least(p.pushed, 12 - r.level)), p.pushed - least(p.pushed, 12 - r.level) FROM r JOIN p ON p.stream_id = r.stream_id AND p.ord = r.ord + 1) SELECT stream_id, CAST(sum(silence) AS BIGINT) AS silence, CAST(sum(dropped) AS BIGINT) AS dropped FROM r WHERE ord >= 0 GROUP BY 1",
    "rms_subblock": f"WITH {BLOCKS} SELECT vec_id, pos // 16 AS part, round(sqrt(sum(x * x) / 16), 6) + 0 AS rms FROM b GROUP BY 1, 2",
    "downmix": f"WITH {BLOCKS} SELECT vec_id, pos // 4 AS pos, round(sum(x) / 4, 6) + 0 AS y FROM b GROUP BY 1, 2",
    "select_channel": f"WITH {BLOCKS} SELECT vec_id, pos // 4 AS pos, round(x, 6) + 0 AS y FROM b WHERE pos % 4 = 2",
    "channel_map": f"WITH {BLOCKS} SELECT vec_id, pos // 2 * 3 + j AS pos, round(x, 6) + 0 AS y FROM b JOIN (SELECT unnest([0, 1, 2]) AS j, unnest([1, 0, 1]) AS c) ON pos % 2 = c",
    "planar_roundtrip": f"WITH {BLOCKS} SELECT vec_id, pos, round(x, 6) + 0 AS y FROM b",
    "deinterleave": f"WITH {BLOCKS} SELECT vec_id, pos % 2 AS channel, pos // 2 AS pos, round(x, 6) + 0 AS y FROM b",
    "pcm16_encode": f"WITH {BLOCKS} SELECT vec_id, pos, least(32767, CAST(trunc(greatest(-1, least(1, x * {GAIN})) * 32768) AS INTEGER)) AS code FROM b",
    "pcm16_round": f"WITH {BLOCKS} SELECT vec_id, pos, CAST(greatest(-32768, least(32767, floor(greatest(-2, least(2, x * {GAIN})) * 32768 + 0.5))) AS INTEGER) AS code FROM b",
    "pcm16_decode": f"WITH {BLOCKS} SELECT vec_id, pos, round(least(32767, CAST(trunc(greatest(-1, least(1, x)) * 32768) AS INTEGER)) / 32768, 6) + 0 AS y FROM b",
    "frame_peaks": f"WITH {BLOCKS} SELECT vec_id, pos // 4 AS pos, round(max(abs(x)), 6) + 0 AS y FROM b GROUP BY 1, 2",
    "frame_mean_squares": f"WITH {BLOCKS} SELECT vec_id, pos // 4 AS pos, round(sum(x * x) / 4, 6) + 0 AS y FROM b GROUP BY 1, 2",
    "sanitize_report": f"WITH {_SPOILED} SELECT vec_id, count(*) FILTER (WHERE NOT isfinite(x)) AS non_finite, round(sum(CASE WHEN isfinite(x) THEN x ELSE 0 END), 6) + 0 AS total FROM d GROUP BY 1",
    "clip_report": f"WITH {_SPOILED} SELECT vec_id, count(*) FILTER (WHERE isfinite(x) AND abs(x) > 1) AS clipped_samples, count(*) FILTER (WHERE NOT isfinite(x)) AS non_finite_samples, round(sum(CASE WHEN isnan(x) THEN 0 ELSE greatest(-1, least(1, x)) END), 6) + 0 AS total FROM d GROUP BY 1",
    "save_report": f"WITH {_SPOILED} SELECT vec_id, count(*) FILTER (WHERE isfinite(x) AND abs(x) > 1) AS clipped_samples, count(*) FILTER (WHERE NOT isfinite(x)) AS non_finite_samples FROM d GROUP BY 1",
    "linear_resample": "WITH k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(unnest(range(0, 26)) AS INTEGER) AS k FROM embeddings) SELECT vec_id, k AS pos, round(e[k * 5 // 2 + 1] + (e[k * 5 // 2 + 2] - e[k * 5 // 2 + 1]) * (k % 2) * 0.5, 6) + 0 AS y FROM k",
    "linear_resample_stream": f"""WITH RECURSIVE {EVENTS}, c AS MATERIALIZED (SELECT stream_id, pos // 10 AS seq, list(CAST(x AS FLOAT) ORDER BY pos) AS d, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT stream_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS left_ FROM c GROUP BY 1
  UNION ALL SELECT c.stream_id, c.seq, c.n, greatest(0, CAST(ceil((c.n - 1 - r.left_) / CAST(1.6 AS DOUBLE)) AS BIGINT)), r.left_, greatest(CAST(0 AS DOUBLE), r.left_ + greatest(0, CAST(ceil((c.n - 1 - r.left_) / CAST(1.6 AS DOUBLE)) AS BIGINT)) * CAST(1.6 AS DOUBLE) - c.n) FROM r JOIN c ON c.stream_id = r.stream_id AND c.seq = r.seq + 1),
q AS (SELECT c.stream_id, c.d, c.n, r.p + unnest(range(0, r.k)) * CAST(1.6 AS DOUBLE) AS q FROM r JOIN c USING (stream_id, seq)),
i AS (SELECT stream_id, d, n, q, CAST(floor(q) AS BIGINT) AS i FROM q)
SELECT CAST(stream_id AS VARCHAR) AS stream_id, count(*) AS n, round(sum(CAST(CAST(CAST(d[i + 1] AS DOUBLE) + (CAST(d[least(i + 1, n - 1) + 1] AS DOUBLE) - CAST(d[i + 1] AS DOUBLE)) * (q - i) AS FLOAT) AS DOUBLE)), 3) + 0 AS total FROM i GROUP BY 1""",
    "polyphase_resample": f"WITH {EVENTS} SELECT CAST(stream_id AS VARCHAR) AS stream_id, (count(*) + 2) // 3 AS n FROM s GROUP BY 1",
    "echo_silent": f"WITH {EVENTS} SELECT stream_id, 0.0::DOUBLE AS erle_db, count(*) FILTER (WHERE pos % 4 <> 1) AS silence, round(sum(x * (pos % 7 + 1)), 5) + 0 AS weighted FROM s GROUP BY 1",
    "model_windows": f"""WITH RECURSIVE {EVENTS}, w AS MATERIALIZED (SELECT stream_id, pos // {SIZE} AS win, sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * CAST(CAST(x AS FLOAT) AS DOUBLE)) AS e, CAST(arg_max(x, pos) AS FLOAT) AS tail FROM s GROUP BY 1, 2 HAVING count(*) = {SIZE}),
l AS MATERIALIZED (SELECT stream_id, win, sqrt((e + coalesce(CAST(lag(tail) OVER (PARTITION BY stream_id ORDER BY win) AS DOUBLE) * CAST(lag(tail) OVER (PARTITION BY stream_id ORDER BY win) AS DOUBLE), 0)) / {SIZE + 1}) AS loud FROM w),
r AS (SELECT stream_id, CAST(-1 AS BIGINT) AS win, CAST(0 AS FLOAT) AS state FROM l GROUP BY 1 UNION ALL SELECT l.stream_id, l.win, CAST(0.5 * CAST(r.state AS DOUBLE) + 0.5 * l.loud AS FLOAT) FROM r JOIN l ON l.stream_id = r.stream_id AND l.win = r.win + 1)
SELECT stream_id, win, win * {SIZE} / 16.0 AS start, (win + 1) * {SIZE} / 16.0 AS "end", round(CAST(state / (state + CAST(0.1 AS FLOAT)) AS DOUBLE), 5) + 0 AS probability, state / (state + CAST(0.1 AS FLOAT)) >= 0.5 AS is_speech FROM r WHERE win >= 0""",
    "fw_seg_snr": """WITH s AS MATERIALIZED (SELECT user_id % 4 AS stream_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS pos, value / 397.0 AS r FROM events),
n AS (SELECT stream_id, CASE WHEN count(*) >= 512 THEN (count(*) - 512) // 256 + 1 ELSE 0 END AS n FROM s GROUP BY 1),
f AS MATERIALIZED (SELECT s.stream_id, f, pos - f * 256 AS i, r, r * CASE WHEN pos % 2 = 0 THEN 0.9 ELSE 1.1 END AS e FROM s JOIN n USING (stream_id), (SELECT unnest([0, 1]) AS back), LATERAL (SELECT pos // 256 - back AS f) WHERE f >= 0 AND f < n.n),
a AS (SELECT stream_id, f, sum(r * r) AS energy FROM f GROUP BY 1, 2),
v AS (SELECT stream_id, f FROM (SELECT *, max(energy) OVER (PARTITION BY stream_id) AS top FROM a) WHERE energy > top * 1e-4),
t AS MATERIALIZED (SELECT k, i, (0.5 - 0.5 * cos(2 * pi() * i / 512)) * cos(2 * pi() * (k * i % 512) / 512) AS c, (0.5 - 0.5 * cos(2 * pi() * i / 512)) * sin(2 * pi() * (k * i % 512) / 512) AS d FROM (SELECT unnest(range(0, 257)) AS k), (SELECT unnest(range(0, 512)) AS i)),
z AS (SELECT stream_id, f, k, sqrt(pow(sum(r * c), 2) + pow(sum(r * d), 2)) AS x, sqrt(pow(sum(e * c), 2) + pow(sum(e * d), 2)) AS y FROM f JOIN v USING (stream_id, f) JOIN t USING (i) GROUP BY 1, 2, 3),
g AS (SELECT unnest(range(0, 24)) AS band),
b AS (SELECT stream_id, f, (SELECT max(band) FROM g WHERE band * 257 // 24 <= k) AS band, x, y FROM z),
h AS (SELECT stream_id, f, band, sum(x * x) AS p, sum(pow(x - y, 2)) AS q FROM b GROUP BY 1, 2, 3),
m AS (SELECT stream_id, f, sum(pow(p, 0.2) * greatest(-10, least(35, 10 * log10((p + 1e-10) / (q + 1e-10))))) / sum(pow(p, 0.2)) AS snr FROM h GROUP BY 1, 2)
SELECT n.stream_id, round(coalesce(avg(snr), 0), 4) + 0 AS fw_seg_snr FROM n LEFT JOIN m USING (stream_id) GROUP BY 1""",
    "si_sdr": f"WITH {BLOCKS}, j AS (SELECT a.vec_id, a.x AS r, a.x + 0.5 * o.x AS e FROM b a JOIN b o ON o.vec_id = a.vec_id - 1 AND o.pos = a.pos), m AS (SELECT vec_id, covar_pop(e, r) * 64 AS er, var_pop(r) * 64 AS rr, var_pop(e) * 64 AS ee FROM j GROUP BY 1), g AS (SELECT vec_id, pow(er / (rr + 1e-12), 2) * rr AS s, ee - 2 * er / (rr + 1e-12) * er + pow(er / (rr + 1e-12), 2) * rr AS n FROM m) SELECT vec_id, round(10 * log10((s + 1e-12) / (greatest(n, 0) + 1e-12)), 4) + 0 AS si_sdr FROM g",
    "seg_snr": f"WITH {EVENTS}, f AS (SELECT stream_id, pos // 16 AS f, sum(x * x) AS p, sum(pow(x - x * CASE WHEN pos % 2 = 0 THEN 0.9 ELSE 1.2 END, 2)) AS e FROM s GROUP BY 1, 2 HAVING count(*) = 16), t AS (SELECT *, max(p) OVER (PARTITION BY stream_id) AS top FROM f) SELECT stream_id, round(coalesce(avg(greatest(-10, least(35, 10 * log10((p + 1e-10) / (e + 1e-10))))) FILTER (WHERE p > top * 1e-4), 0), 4) + 0 AS seg_snr FROM t GROUP BY 1",
    "dc_block": f"WITH RECURSIVE {EVENTS}, r AS (SELECT stream_id, pos, x, x AS y FROM s WHERE pos = 0 UNION ALL SELECT s.stream_id, s.pos, s.x, s.x - r.x + 0.995::DOUBLE * r.y FROM r JOIN s ON s.stream_id = r.stream_id AND s.pos = r.pos + 1) SELECT stream_id, pos, round(y, 6) + 0 AS y FROM r",
    "highpass": f"WITH RECURSIVE {EVENTS}, w AS (SELECT 2 * pi() * 80 / 16000 AS w), k AS (SELECT (1 + cos(w)) / 2 / (1 + sin(w) / sqrt(2)) AS b0, -2 * cos(w) / (1 + sin(w) / sqrt(2)) AS a1, (1 - sin(w) / sqrt(2)) / (1 + sin(w) / sqrt(2)) AS a2 FROM w), r AS (SELECT stream_id, pos, b0 * x AS y, -2 * b0 * x - a1 * b0 * x AS z1, b0 * x - a2 * b0 * x AS z2 FROM s, k WHERE pos = 0 UNION ALL SELECT s.stream_id, s.pos, b0 * s.x + z1, -2 * b0 * s.x - a1 * (b0 * s.x + z1) + z2, b0 * s.x - a2 * (b0 * s.x + z1) FROM r JOIN s ON s.stream_id = r.stream_id AND s.pos = r.pos + 1, k) SELECT stream_id, pos, round(y, 6) + 0 AS y FROM r",
    "limiter": f"WITH RECURSIVE {EVENTS}, k AS (SELECT pow(10, -1.0 / 20) AS c, 1 - exp(-1 / (0.0005 * 16000)) AS atk, 1 - exp(-1 / (0.05 * 16000)) AS re), d AS (SELECT stream_id, pos, x, c, atk, re, CASE WHEN abs(x) > c THEN c / abs(x) ELSE 1 END AS want FROM s, k), r AS (SELECT stream_id, pos, x, c, 1 + (want - 1) * (CASE WHEN want < 1 THEN atk ELSE re END) AS g FROM d WHERE pos = 0 UNION ALL SELECT d.stream_id, d.pos, d.x, d.c, r.g + (d.want - r.g) * (CASE WHEN d.want < r.g THEN d.atk ELSE d.re END) FROM r JOIN d ON d.stream_id = r.stream_id AND d.pos = r.pos + 1) SELECT stream_id, pos, round(greatest(-c, least(c, x * g)), 6) + 0 AS y FROM r",
    "agc": f"WITH RECURSIVE {EVENTS}, k AS (SELECT pow(10, -18.0 / 20) AS target, pow(10, -50.0 / 20) AS nf, pow(10, 1.5) AS mx, pow(10, -1.5) AS mn, 1 - exp(-1 / (0.4 * 16000)) AS sl, 1 - exp(-1 / (0.01 * 16000)) AS atk, 1 - exp(-1 / (0.02 * 16000)) AS wm, pow(10, 6.0 / 16000 / 20) AS up), r AS (SELECT stream_id, CAST(-1 AS BIGINT) AS pos, 0.0::DOUBLE AS y, 0.0::DOUBLE AS power, 1.0::DOUBLE AS gain, 1600 AS warm, 0 AS hang FROM s GROUP BY 1 UNION ALL SELECT stream_id, pos, y, power, CASE WHEN NOT present THEN gain WHEN want <= gain THEN gain + (want - gain) * atk WHEN warm > 0 THEN gain + (want - gain) * wm ELSE least(gain * up, want) END, CASE WHEN present THEN greatest(0, warm - 1) ELSE warm END, CASE WHEN loud THEN 3200 ELSE greatest(0, hang - 1) END FROM (SELECT *, loud OR hang > 0 AS present, greatest(mn, least(mx, target / sqrt(power))) AS want FROM (SELECT *, sqrt(power) > nf AS loud FROM (SELECT s.stream_id, s.pos, s.x * r.gain AS y, r.power + greatest(sl, 1.0::DOUBLE / (s.pos + 1)) * (s.x * s.x - r.power) AS power, r.gain, r.warm, r.hang, k.* FROM r JOIN s ON s.stream_id = r.stream_id AND s.pos = r.pos + 1, k)))) SELECT stream_id, pos, round(y, 6) + 0 AS y FROM r WHERE pos >= 0",
    "device_match": "SELECT CAST(s_suppkey AS INTEGER) AS \"index\", s_name AS name, CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS id, s_suppkey = 7 AS is_default FROM supplier WHERE contains(lower(s_name), 'supplier#0000000')",
    "format_resolve": "SELECT page_id, '/rec/' || page_id || ['.wav', '.AIFF', '.flac', '.mp3', ''][page_id % 5 + 1] AS path, CASE page_id % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'aiff' WHEN 2 THEN 'flac' END AS format FROM pages",
    # closed forms of the recursions: sums of past samples under growing weights
    "long_dc_block": "WITH e AS (SELECT event_id AS pos, value / 397.0 AS x FROM events), d AS (SELECT pos, x - coalesce(lag(x) OVER (ORDER BY pos), 0) AS d FROM e) SELECT 0 AS stream_id, pos, round(sum(d * pow(0.995::DOUBLE, -pos)) OVER (ORDER BY pos) * pow(0.995::DOUBLE, pos), 6) + 0 AS y FROM d",
    "long_highpass": "WITH RECURSIVE e AS MATERIALIZED (SELECT event_id AS pos, value / 397.0 AS x FROM events), w AS (SELECT 2 * pi() * 80 / 16000 AS w), k AS MATERIALIZED (SELECT (1 + cos(w)) / 2 / (1 + sin(w) / sqrt(2)) AS b0, -2 * cos(w) / (1 + sin(w) / sqrt(2)) AS a1, (1 - sin(w) / sqrt(2)) / (1 + sin(w) / sqrt(2)) AS a2 FROM w), r AS (SELECT pos, b0 * x AS y, -2 * b0 * x - a1 * b0 * x AS z1, b0 * x - a2 * b0 * x AS z2 FROM e, k WHERE pos = 0 UNION ALL SELECT s.pos, b0 * s.x + z1, -2 * b0 * s.x - a1 * (b0 * s.x + z1) + z2, b0 * s.x - a2 * (b0 * s.x + z1) FROM r JOIN e s ON s.pos = r.pos + 1, k) SELECT 0 AS stream_id, pos, round(y, 6) + 0 AS y FROM r",
    "long_queue": "WITH RECURSIVE p AS MATERIALIZED (SELECT event_id AS ord, event_id * 7 % 11 AS pushed, event_id * event_id % 9 AS wanted FROM events), r AS (SELECT CAST(-1 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS queued, CAST(0 AS BIGINT) AS silence, CAST(0 AS BIGINT) AS dropped UNION ALL SELECT p.ord, greatest(0, r.queued + least(p.pushed, 12 - r.queued) - p.wanted), greatest(0, p.wanted - r.queued - least(p.pushed, 12 - r.queued)), p.pushed - least(p.pushed, 12 - r.queued) FROM r JOIN p ON p.ord = r.ord + 1) SELECT * FROM r WHERE ord >= 0",
    "long_speaking": f'WITH w AS (SELECT event_id // {SIZE} AS win, sqrt(avg(value / 397.0 * value / 397.0)) AS p FROM events GROUP BY 1 HAVING count(*) = {SIZE}), v AS (SELECT win, (win + 1) * {SIZE} / {RATE} AS t1, p, p >= {LEVEL} AS speech FROM w), z AS (SELECT *, max(CASE WHEN speech THEN t1 END) OVER (ORDER BY win) AS last_loud FROM v) SELECT win AS seq, t1 AS "end", round(p, 6) + 0 AS score, coalesce(speech OR t1 - last_loud < {HOLDOFF}, false) AS is_speaking FROM z',
    "polyphase_values": f"WITH {EVENTS}, n AS (SELECT stream_id, count(*) AS n FROM s GROUP BY 1), r AS (SELECT 16000.0::DOUBLE / 44100 * 0.95 AS cut), h AS (SELECT cut, CAST(ceil(16 / cut) AS BIGINT) AS half FROM r), o AS (SELECT stream_id, unnest(range((n * 160 + 440) // 441)) AS j FROM n), k AS (SELECT stream_id, j, cut, half, j * 441 // 160 AS a, (j * 441 % 160) / 160.0::DOUBLE AS part, unnest(range(1 - half, half + 1)) AS k FROM o, h), t AS (SELECT stream_id, j, a + k AS pos, (k - part) * cut * pi() AS t, cut, 0.5 + 0.5 * cos(pi() * greatest(-1, least(1, (k - part) / half))) AS w FROM k) SELECT stream_id, j AS pos, round(CAST(CAST(coalesce(sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * CASE WHEN t = 0 THEN 1 ELSE sin(t) / t END * cut * w), 0) AS FLOAT) AS DOUBLE), 5) + 0 AS y FROM t LEFT JOIN s USING (stream_id, pos) GROUP BY 1, 2",
    "detector_tap": f"WITH {EVENTS} SELECT stream_id, pos // 64 AS seq, count(*) AS frames, round(sqrt(avg(pow((CAST(CAST(x AS FLOAT) AS DOUBLE) + CAST(CAST(x * -0.5 AS FLOAT) AS DOUBLE)) / 2, 2))), 5) + 0 AS score FROM s GROUP BY 1, 2",
}
