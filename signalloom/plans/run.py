"""Running a plan over chunk rows: native steps as columns, stateful ones as one fold per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConsumedError, DetectorError
from ..functions import samples as S
from ..operators import folds
from ..operators.align import LiveCanceller
from ..operators.blocks import Blocks, EnergyScore, ModelScore, fold_blocks
from ..operators.models import SpectralDenoiser, session
from ..operators.windows import score_windows, segments
from .config import NORMALISING, Conditioning, Step, detector_feed_rate, plan

#: Seconds of reference that wait for the near end.
REFERENCE_S = 2


def kernel_of(steps: list[Step], rate: int, channels: int):
    """One chain of kernels for the stateful steps, in the plan's order."""
    out = []
    for s in steps:
        if s.name == "resample":
            out.append(folds.PerChannel(lambda s=s: folds.PolyphaseResampler(s.args["from"], s.args["to"]), channels))
        elif s.name == "dc":
            out.append(folds.PerChannel(folds.dc_blocker, channels))
        elif s.name == "denoise":
            out.append(folds.PerChannel(lambda s=s: SpectralDenoiser(session(*s.args["model"]) if isinstance(s.args["model"], tuple) else None), channels))
        elif s.name == "highpass":
            out.append(folds.PerChannel(lambda s=s: folds.high_pass(s.args["cutoff"], rate), channels))
        elif s.name == "agc":
            out.append(folds.GainControl(s.args["target"], rate))
        elif s.name == "limiter":
            out.append(folds.Limiter(s.args["ceiling"], rate))
    return folds.Chain(out)


def blocks_of(config: Conditioning, source_rate: int, source_channels: int, frames: int | None, key: str = "detector") -> Blocks:
    """The fold of one stream that was brought to its layout: normalising kernels, echo canceller, tap, transforming kernels."""
    rate, channels, d = config.sample_rate, config.delivered_channels(source_channels), config.detector
    steps = plan(config, source_rate, source_channels)
    before = kernel_of([s for s in steps if s.name in NORMALISING], rate, channels).kernels
    after = kernel_of([s for s in steps if s.name not in NORMALISING], rate, channels).kernels
    e, echo = config.echo, None
    if e is not None:
        echo = LiveCanceller(e.tail_ms * rate // 1000, channels, REFERENCE_S * e.reference_rate, 256, rate, e.reference_rate, e.suppression == "conservative")
    score = None
    if d is not None:
        score = EnergyScore() if d.kind == "energy" else ModelScore(key, rate, *detector_feed_rate(rate))
    return Blocks(before, echo, after, channels, frames, d.source if d else None, score)


def collapsed(data, channels: int, source: int | None):
    """One sample for each frame: the mean of its channels, or one of them."""
    return S.downmix(data, channels) if source is None else S.select_channel(data, channels, source)


def needs_fold(config: Conditioning, source_rate: int, source_channels: int) -> bool:
    """Whether blocks and scores can't be had from columns and a chain: with echo, a model, or a tap before transforming steps."""
    d = config.detector
    transforming = any(s.name not in NORMALISING for s in plan(config, source_rate, source_channels))
    return config.echo is not None or (d is not None and (d.kind != "energy" or transforming))


def delivered(chunks: DataFrame, config: Conditioning, source_rate: int, source_channels: int, frames: int, reference: DataFrame | None = None, factory=None, key: str = "detector") -> DataFrame:
    """Blocks of `frames` with score (and echo counters) by one fold; reference: chunk rows of the far end at its own rate."""
    near = laid_out(chunks, config, source_channels)
    return fold_blocks(near, lambda *_: blocks_of(config, source_rate, source_channels, frames, key), config.sample_rate, reference, factory)


def layout_of(data, config: Conditioning, source_channels: int):
    kind, wanted = config.layout(source_channels)
    data = F.transform(data, S.finite_or_zero)
    data = S.downmix(data, source_channels) if kind == "mean" else S.map_channels(data, source_channels, list(wanted)) if kind == "map" else data
    return data.cast("array<float>")


def laid_out(chunks: DataFrame, config: Conditioning, source_channels: int) -> DataFrame:
    """Sanitised chunks in the delivered layout; native."""
    return chunks.withColumn("data", layout_of(F.col("data"), config, source_channels)).withColumn("channels", F.lit(config.delivered_channels(source_channels)))


def condition(chunks: DataFrame, config: Conditioning, source_rate: int, source_channels: int) -> DataFrame:
    """Chunk rows conditioned; the same rows if the plan is empty, no Python worker if no step has state."""
    steps = plan(config, source_rate, source_channels)
    if not steps:
        return chunks
    out = laid_out(chunks, config, source_channels)
    stateful = [s for s in steps if s.name not in ("sanitize", "downmix", "map")]
    if not stateful:
        return out
    rate = config.sample_rate
    return folds.fold_chunks(out, lambda _, channels: kernel_of(stateful, rate, channels), rate)


def feed(chunks: DataFrame, config: Conditioning, source_rate: int, source_channels: int) -> DataFrame:
    """Mono samples (stream_id, pos, x) that the detector hears: after the layout, before any conditioning."""
    out, channels = laid_out(chunks, config, source_channels), config.delivered_channels(source_channels)
    mono = collapsed(F.col("data"), channels, config.detector.source if config.detector else None)
    out = out.withColumn("data", mono.cast("array<float>")).withColumn("channels", F.lit(1))
    rate, _ = detector_feed_rate(config.sample_rate)
    if source_rate != rate:
        out = folds.fold_chunks(out, lambda s, c: folds.PerChannel(lambda: folds.PolyphaseResampler(s, rate), c), rate)
    by = Window.partitionBy("stream_id").orderBy("seq")
    base = F.sum(F.size("data")).over(by) - F.size("data")
    out = out.withColumn("base", base).select("stream_id", "base", F.posexplode("data").alias("i", "x"))
    return out.select("stream_id", (F.col("base") + F.col("i")).alias("pos"), F.col("x").cast("double").alias("x"))


def analyze(chunks: DataFrame, config: Conditioning, source_rate: int, source_channels: int, detector=None) -> tuple[DataFrame, DataFrame]:
    """Window scores and segments of a recording; detector(samples, rate, window, threshold) scores the windows.

    Whole-file analysis is a model's work; the energy rule is for chunks and is refused here unless it is passed
    as the detector.
    """
    if config.detector is None:
        raise DetectorError("no detector is configured")
    if config.detector.kind == "energy" and detector is None:
        raise DetectorError("the energy rule scores chunks, not whole recordings")
    rate, window = detector_feed_rate(config.sample_rate)
    windows = detector(feed(chunks, config, source_rate, source_channels), rate, window, config.detector.level)
    return windows, segments(windows, config.detector.holdoff)


def energy(samples: DataFrame, rate: int, window: int, threshold: float) -> DataFrame:
    return score_windows(samples, window, rate, threshold)


class Recording:
    """A single-pass view of chunk rows, for callers who want the guard; the rows themselves can be read again."""

    def __init__(self, chunks: DataFrame):
        self.chunks, self.used = chunks, False

    def take(self) -> DataFrame:
        if self.used:
            raise ConsumedError("this recording was read already")
        self.used = True
        return self.chunks
