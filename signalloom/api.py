"""The surface that callers use: recordings, live streams, devices, recording to a file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import ConfigError, DetectorError
from .functions import samples as S
from .operators import devices as dev
from .operators import folds, models, windows
from .plans import run
from .plans.config import FILE_BLOCK, Conditioning, Detector, EchoCancel
from .sources import audio, ranges, sinks
from .streaming import live


class File:
    """Recordings of one rate and channel count, as chunk rows; single-pass like the stream it stands for."""

    def __init__(self, chunks: DataFrame, sample_rate: int, channels: int, config: Conditioning | None = None, reference: DataFrame | None = None):
        """reference: chunk rows of what was played, by the same stream ids; read where the configuration cancels echo."""
        self.sample_rate, self.channels, self.reference = sample_rate, channels, reference
        self.config = config or Conditioning(sample_rate=sample_rate, channels=channels)
        self.config.layout(channels)  # an impossible or ambiguous layout is refused here
        self._rows = run.Recording(chunks)

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Conditioning | None = None, glob: str | None = None) -> File:
        """All audio files under a path; their common rate and channels come from the headers, which are all that is read here."""
        chunks = ranges.scan_ranges(spark, path, FILE_BLOCK, glob)
        kinds = ranges.ranges(spark, path, FILE_BLOCK, glob).select("sample_rate", "channels").distinct().take(2)
        if len(kinds) != 1:
            raise ConfigError("the files have no or more than one rate and channel count; open them apart")
        return cls(chunks, kinds[0]["sample_rate"], kinds[0]["channels"], config)

    @classmethod
    def buffer(cls, spark: SparkSession, samples, sample_rate: int, channels: int, config: Conditioning | None = None, stream_id: str = "buffer") -> File:
        return cls(audio.buffer_source(spark, stream_id, samples, sample_rate, channels), sample_rate, channels, config)

    def chunks(self, factory: Callable[[], models.Session] | None = None, key: str = "detector") -> DataFrame:
        """The conditioned recording in blocks of FILE_BLOCK frames; a detector adds score and is_speaking, echo cancelling `echo`.

        Scores are of the signal before any transforming step, collapsed to the mean of its channels or the detector's one.
        A model detector needs a session factory; without one, blocks of such a configuration have no score.
        """
        config, d = self.config, self.config.detector
        channels, rows = config.delivered_channels(self.channels), self._rows.take()
        if d is not None and d.kind != "energy" and factory is None:
            config, d = replace(config, detector=None), None
        if run.needs_fold(config, self.sample_rate, self.channels):
            scored = run.delivered(rows, config, self.sample_rate, self.channels, FILE_BLOCK, self.reference, factory, key)
            scored = scored if config.echo is not None else scored.drop("echo")
            if d is None:
                return scored.drop("score")
        else:
            out = reblocked(run.condition(rows, config, self.sample_rate, self.channels), channels, FILE_BLOCK)
            if d is None:
                return out
            scored = out.withColumn("score", S.rms(run.collapsed(F.col("data"), channels, d.source)))
        timed = windows.chunk_positions(scored.withColumn("frames", F.size("data") / F.col("channels")), config.sample_rate)
        return windows.speaking_state(timed, d.level, d.holdoff).drop("frames", "sequence")

    def analyze(self, factory: Callable[[], models.Session] | None = None, key: str = "detector") -> tuple[DataFrame, DataFrame]:
        """Window scores and segments by a model; conditioning has no part in it."""
        if self.config.detector is not None and self.config.detector.kind != "energy" and factory is None:
            raise DetectorError("no session factory for the model")
        score = (lambda s, rate, window, level: models.score_stream_windows(s, key, factory, rate, window, level)) if factory else None
        if self.config.detector is not None and self.config.detector.kind == "energy":
            score = None  # refused by the runner
        return run.analyze(self._rows.take(), self.config, self.sample_rate, self.channels, score)

    analyse = analyze

    def save(self, folder: str, kind: str = "wav") -> DataFrame:
        """Each stream as one file of the folder; the report rows."""
        sinks.format_of("x." + kind)
        config = replace(self.config, detector=None)
        if config.echo is not None:
            out = run.delivered(self._rows.take(), config, self.sample_rate, self.channels, FILE_BLOCK, self.reference)
        else:
            out = run.condition(self._rows.take(), config, self.sample_rate, self.channels)
        return sinks.save_streams(out, folder, kind)


def reblocked(chunks: DataFrame, channels: int, frames: int) -> DataFrame:
    """Chunk rows cut anew into blocks of whole frames, the last of a stream maybe short; arrays are cut and joined."""
    by, size = Window.partitionBy("stream_id").orderBy("seq"), frames * channels
    n = F.size("data")
    base = (F.sum(n).over(by) - n).cast("long")
    parts = chunks.withColumn("__base", base).filter(n > 0)
    first, last = F.floor(F.col("__base") / size), F.floor((F.col("__base") + n - 1) / size)
    parts = parts.withColumn("block", F.explode(F.sequence(first, last)))
    a = F.greatest(F.lit(0), F.col("block") * size - F.col("__base")).cast("int")
    z = F.least(n.cast("long"), (F.col("block") + 1) * size - F.col("__base")).cast("int")
    parts = parts.select("stream_id", "block", "sample_rate", F.struct("__base", F.slice("data", a + 1, z - a).alias("x")).alias("part"))
    out = parts.groupBy("stream_id", "block").agg(F.first("sample_rate").alias("sample_rate"), F.array_sort(F.collect_list("part")).alias("parts"))
    return out.select("stream_id", F.col("block").cast("long").alias("seq"), "sample_rate", F.lit(channels).alias("channels"), F.flatten("parts.x").cast("array<float>").alias("data"))


class Microphone:
    """Live chunk files of a folder, conditioned by one keyed fold per stream.

    Rows of a configuration that cancels echo have a `side`: `far` ones are what was played, at the configured reference rate.
    """

    #: Files that one trigger reads.
    FILES = 64

    def __init__(self, spark: SparkSession, folder: str, source_rate: int, source_channels: int, config: Conditioning | None = None, factory: Callable[[], models.Session] | None = None, key: str = "detector"):
        self.config = config or Conditioning(sample_rate=source_rate, channels=source_channels)
        self.config.layout(source_channels)
        if self.config.detector is not None and self.config.detector.kind != "energy" and factory is None:
            raise DetectorError("no session factory for the model")
        self.source, self.factory, self.key = (spark, folder, source_rate, source_channels), factory, key

    def read(self, queue: int | None = None, **timing) -> DataFrame:
        """A streaming DataFrame of conditioned blocks of frames_per_buffer frames; a stream's last row flushes and closes it.

        dtype int16 adds their 16-bit `codes`; a detector gives score and is_speaking, by the signal before any transforming step.
        queue: chunks of a stream taken in one trigger, the newest beyond are dropped and counted. timing: see streaming.live.
        """
        spark, folder, rate, channels = self.source
        config, d, key = self.config, self.config.detector, self.key
        rows = live.capture(spark, folder, self.FILES, config.echo is not None)
        if config.echo is None:
            near = run.laid_out(rows, config, channels)
        else:  # the reference keeps its own layout
            far = F.col("side") == "far"
            rows = rows.withColumn("near", run.layout_of(F.col("data"), config, channels))
            width = config.delivered_channels(channels)
            near = rows.withColumn("data", F.when(far, F.col("data")).otherwise(F.col("near"))).withColumn("channels", F.when(far, F.col("channels")).otherwise(F.lit(width))).drop("near")
        make = lambda *_: run.blocks_of(config, rate, channels, config.frames_per_buffer, key)
        out = live.folded(near, make, rate=config.sample_rate, level=d.level if d else None, holdoff=d.holdoff if d else 0.0, factory=self.factory, queue=queue, **timing)
        return out.withColumn("codes", F.transform("data", S.pcm16)) if config.dtype == "int16" else out


def record(chunks: DataFrame, seconds: float, folder: str, kind: str = "wav") -> DataFrame:
    """The first seconds of each stream as a file: whole chunks, at least one frame."""
    sized = chunks.withColumn("frames", F.floor(F.size("data") / F.col("channels")).cast("long"))
    target = F.greatest(F.lit(1), F.floor(F.col("sample_rate") * seconds).cast("long"))
    return sinks.save_streams(windows.taken(sized, target).drop("frames"), folder, kind)


devices, select_device = dev.with_default, dev.select_device
__all__ = ["Conditioning", "Detector", "EchoCancel", "File", "Microphone", "devices", "record", "select_device"]
