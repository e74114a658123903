"""Sample arithmetic as native columns over arrays of interleaved floats; all of it stays in code generation.

Trailing partial frames are dropped. NaN counts as larger than anything in Spark and makes integer casts
fail, so encoders map it to 0 first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _frames(data: Column, channels: int) -> Column:
    return F.floor(F.size(data) / channels).cast("int")


def _per_frame(data: Column, channels: int, make, empty: str = "array<double>") -> Column:
    """make(index of the frame's first sample, from 0) for each whole frame."""
    n = _frames(data, channels)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda f: make(f * channels))).otherwise(F.array().cast(empty))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def rms(data: Column) -> Column:
    """Root of the mean square in double precision; 0 for an empty block."""
    total = F.aggregate(data, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(data) > 0, F.sqrt(total / F.size(data))).otherwise(0.0)


def finite_or_zero(x: Column) -> Column:
    """Before any stage: a sample that is not finite becomes 0."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), 0.0).otherwise(x)


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == INF))


def repaired(x: Column) -> Column:
    """Before saving: NaN becomes 0, an infinity full scale of its sign."""
    return F.when(F.isnan(x), 0.0).when(x == INF, 1.0).when(x == -INF, -1.0).otherwise(x)


def clamped(x: Column, ceiling: float = 1.0) -> Column:
    return F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), x))


def pcm16(x: Column) -> Column:
    """Clamp, scale by 32768, cut towards zero, 32767 at most."""
    scaled = clamped(F.when(F.isnan(x), 0.0).otherwise(x)) * 32768.0
    return F.least(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("int"), F.lit(32767))


def pcm16_rounded(x: Column) -> Column:
    """Scale by 32768, round half up, then clamp: as the browser build does; up to one step from pcm16."""
    scaled = F.floor(F.when(F.isnan(x), 0.0).otherwise(clamped(x, 2.0)) * 32768.0 + 0.5).cast("int")
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), scaled))


def from_pcm16(code: Column) -> Column:
    return code / 32768.0


def downmix(data: Column, channels: int) -> Column:
    """The mean of each frame, summed in channel order."""
    if channels <= 1:
        return data
    return _per_frame(data, channels, lambda i: sum((F.get(data, i + c).cast("double") for c in range(1, channels)), F.get(data, i).cast("double")) / channels)


def select_channel(data: Column, channels: int, index: int) -> Column:
    return _per_frame(data, channels, lambda i: F.get(data, i + index))


def map_channels(data: Column, channels: int, wanted: list[int]) -> Column:
    """Output channel j is input channel wanted[j]; entries may repeat and permute."""
    return F.flatten(_per_frame(data, channels, lambda i: F.array(*[F.get(data, i + k) for k in wanted]), "array<array<double>>"))


def deinterleaved(data: Column, channels: int) -> Column:
    """One array per channel."""
    return F.array(*[select_channel(data, channels, c) for c in range(channels)])


def interleaved(planes: Column, channels: int) -> Column:
    n = F.size(F.get(planes, F.lit(0)))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda f: F.array(*[F.get(F.get(planes, F.lit(c)), f) for c in range(channels)])))).otherwise(F.array().cast("array<double>"))


def widened(data: Column, channels: int) -> Column:
    """A mono block on every channel."""
    return F.flatten(F.transform(data, lambda x: F.array_repeat(x, channels)))


def frame_peaks(data: Column, channels: int) -> Column:
    """Largest magnitude of each frame; a sample that is no number counts as 0."""
    return _per_frame(data, channels, lambda i: F.greatest(F.lit(0.0), *[F.abs(F.when(F.isnan(F.get(data, i + c)), 0.0).otherwise(F.get(data, i + c).cast("double"))) for c in range(channels)]))


def frame_mean_squares(data: Column, channels: int) -> Column:
    return _per_frame(data, channels, lambda i: sum((F.get(data, i + c).cast("double") * F.get(data, i + c).cast("double") for c in range(channels)), F.lit(0.0)) / channels)


def linear_resampled(data: Column, step: float) -> Column:
    """Linear interpolation at 0, step, 2 step, ... while a right neighbour exists, within one block."""
    n = F.size(data)
    count = F.when(n > 1, F.ceil((n - 1) / step)).otherwise(0).cast("int")

    def at(k: Column) -> Column:
        p = k * step
        i = F.floor(p).cast("int")
        return F.get(data, i).cast("double") + (F.get(data, i + 1).cast("double") - F.get(data, i).cast("double")) * (p - i)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def si_sdr(reference: Column, estimate: Column) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB; both sides lose their mean. One pass over the pair."""
    n = F.least(F.size(reference), F.size(estimate))
    pairs = F.zip_with(F.slice(reference, 1, n), F.slice(estimate, 1, n), lambda r, e: F.struct(r.cast("double").alias("r"), e.cast("double").alias("e")))
    names = ("n", "r", "e", "rr", "ee", "er")
    start = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def add(s: Column, p: Column) -> Column:
        r, e = p["r"], p["e"]
        terms = {"n": F.lit(1.0), "r": r, "e": e, "rr": r * r, "ee": e * e, "er": e * r}
        return F.struct(*[(s[k] + terms[k]).alias(k) for k in names])

    def ratio(s: Column) -> Column:
        rr, ee, er = s["rr"] - s["r"] * s["r"] / s["n"], s["ee"] - s["e"] * s["e"] / s["n"], s["er"] - s["e"] * s["r"] / s["n"]
        alpha = er / (rr + 1e-12)
        signal = alpha * alpha * rr
        return 10 * F.log10((signal + 1e-12) / (F.greatest(ee - 2 * alpha * er + signal, F.lit(0.0)) + 1e-12))

    return F.when(n > 0, F.aggregate(pairs, start, add, ratio))


def file_format(path: Column) -> Column:
    """The container that an extension names, whatever its case; null if none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("wav", "wave"), "wav").when(ext.isin("aif", "aiff", "aifc"), "aiff").when(ext == "flac", "flac")
