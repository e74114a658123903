"""Parameters with their ranges, and the plan they stand for.

A plan is an ordered list of steps over chunk rows; steps that would change nothing are left out, and a
channel reduction always comes before resampling and conditioning, which then touch fewer samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import ChannelError, ConfigError

RATES = (1000, 384_000)
BLOCKS = (64, 65_536)
FILE_BLOCK = 1600
DETECTOR_RATES = {8000: 256, 16_000: 512}  # rate and window


def check(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ConfigError(f"{name} is {value}; it must be from {low} to {high}")


@dataclass(frozen=True)
class Detector:
    """Voice activity: `energy` or a model behind the hook in operators.models."""

    kind: str = "energy"
    threshold: float | None = None
    holdoff: float = 0.3
    source: int | None = None  # a delivered channel, or the mean

    def __post_init__(self) -> None:
        if self.threshold is not None:
            check("threshold", self.threshold, 0, 1)
        check("holdoff", self.holdoff, 0, float("inf"))

    @property
    def level(self) -> float:
        return self.threshold if self.threshold is not None else 0.01 if self.kind == "energy" else 0.5


@dataclass(frozen=True)
class EchoCancel:
    tail_ms: int = 128
    suppression: str = "conservative"
    reference_rate: int = 16_000
    reference_channels: int = 1

    def __post_init__(self) -> None:
        check("tail_ms", self.tail_ms, 16, 500)
        check("reference_rate", self.reference_rate, *RATES)
        check("reference_channels", self.reference_channels, 1, 65_535)
        if self.suppression not in ("conservative", "off"):
            raise ConfigError("suppression is conservative or off")


@dataclass(frozen=True)
class Conditioning:
    """What is asked of a stream; the order of the steps is fixed, whatever the order of the fields."""

    sample_rate: int = 16_000
    channels: int = 1
    channel_map: tuple[int, ...] | None = None
    frames_per_buffer: int = FILE_BLOCK
    dc_removal: bool = False
    denoise: str | None = None
    highpass: int | None = None
    agc: int | None = None
    limiter: float | None = None
    detector: Detector | None = None
    echo: EchoCancel | None = None
    dtype: str = "int16"

    def __post_init__(self) -> None:
        check("sample_rate", self.sample_rate, *RATES)
        check("channels", self.channels, 1, 65_535)
        check("frames_per_buffer", self.frames_per_buffer, *BLOCKS)
        if self.highpass not in (None, 80, 100):
            raise ConfigError("highpass is 80 or 100 Hz")
        if self.agc is not None:
            check("agc", self.agc, -40, -3)
        if self.limiter is not None:
            check("limiter", self.limiter, -3.0, 0.0)
        if self.dtype not in ("int16", "float32"):
            raise ConfigError("dtype is int16 or float32")
        if self.echo is not None:
            check("sample_rate with echo cancelling", self.sample_rate, 8000, 48_000)
        if self.channel_map is not None and len(self.channel_map) != self.channels:
            raise ChannelError("channel_map has one entry for each delivered channel")
        if self.detector and self.detector.source is not None and not 0 <= self.detector.source < self.channels:
            raise ChannelError("the detector's channel is not delivered")

    def layout(self, source_channels: int) -> tuple[str, tuple[int, ...]]:
        """(identity | mean | map, the map) for a source of so many channels."""
        if self.channel_map is not None:
            if any(not 0 <= c < source_channels for c in self.channel_map):
                raise ChannelError("channel_map names a channel that the source lacks")
            same = self.channel_map == tuple(range(source_channels))
            return ("identity" if same else "map"), self.channel_map
        if self.channels == source_channels:
            return "identity", tuple(range(source_channels))
        if self.channels == 1:
            return "mean", ()
        if self.channels > source_channels:
            raise ChannelError(f"{self.channels} channels asked of {source_channels}")
        raise ChannelError("which channels to deliver is ambiguous; give a channel_map")

    def delivered_channels(self, source_channels: int) -> int:
        kind, wanted = self.layout(source_channels)
        return 1 if kind == "mean" else len(wanted)


@dataclass(frozen=True)
class Step:
    name: str
    args: dict = field(default_factory=dict)


def plan(config: Conditioning, source_rate: int, source_channels: int) -> list[Step]:
    """The normalising steps (sanitize, layout, resample, echo), then the transforming ones; empty: pass through."""
    kind, wanted = config.layout(source_channels)
    steps = []
    if kind != "identity":
        steps.append(Step("downmix" if kind == "mean" else "map", {"map": wanted}))
    if source_rate != config.sample_rate:
        steps.append(Step("resample", {"from": source_rate, "to": config.sample_rate}))
    if config.echo is not None:
        steps.append(Step("echo", {"cancel": config.echo}))
    if config.dc_removal:
        steps.append(Step("dc"))
    if config.denoise:
        steps.append(Step("denoise", {"model": config.denoise}))
    if config.highpass:
        steps.append(Step("highpass", {"cutoff": config.highpass}))
    if config.agc is not None:
        steps.append(Step("agc", {"target": config.agc}))
    if config.limiter is not None:
        steps.append(Step("limiter", {"ceiling": config.limiter}))
    return [Step("sanitize"), *steps] if steps else []


#: Steps before the detector's tap.
NORMALISING = ("sanitize", "downmix", "map", "resample", "echo")


def detector_feed_rate(rate: int) -> tuple[int, int]:
    """Rate and window that the detector runs at: 8 and 16 kHz as they are, anything else at 16 kHz."""
    rate = rate if rate in DETECTOR_RATES else 16_000
    return rate, DETECTOR_RATES[rate]
