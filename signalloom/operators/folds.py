"""Stateful conditioning as ordered folds, one per stream (or stream and channel).

Linear filters (DC blocker, high-pass) run in blocks: the response of a block to its own samples is one matrix
product for all blocks at once, and only the short state walks from block to block. Gain control and limiter
are nonlinear and walk sample by sample over one detector value per frame. Resamplers keep a fractional
position. Every kernel gives the same output for any cut of its input, so Spark may batch as it likes; state is
plain data and can be kept between batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ordered import SEGMENT, in_order, scanned, spans

BLOCK = 64


@lru_cache(maxsize=256)
def block_tables(a: tuple, b: tuple, c: tuple, d: float) -> tuple[np.ndarray, ...]:
    """What a block gives from its state, from its samples, and the state behind it from both; one set for all streams."""
    a, b, c = np.array(a), np.array(b), np.array(c)
    powers = [np.eye(len(b))]
    for _ in range(BLOCK):
        powers.append(a @ powers[-1])
    from_state = np.array([c @ p for p in powers[:BLOCK]])  # block x state
    impulse = np.array([d, *(c @ p @ b for p in powers[: BLOCK - 1])])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None]
    response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    return from_state, response, powers[BLOCK], np.array([powers[BLOCK - 1 - k] @ b for k in range(BLOCK)]).T


class LinearFilter:
    """s' = a s + b x, y = c s + d x for one channel."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        self.a, self.b, self.c, self.d, self.state = a, b, c, d, np.zeros(len(b))
        self.from_state, self.response, self.step, self.drive = block_tables(tuple(map(tuple, a.tolist())), tuple(b.tolist()), tuple(c.tolist()), d)

    def __getstate__(self) -> tuple:
        return self.a, self.b, self.c, self.d, self.state  # the tables are made again

    def __setstate__(self, kept: tuple) -> None:
        self.__init__(*kept[:4])
        self.state = kept[4]

    def process(self, x: np.ndarray) -> np.ndarray:
        n = len(x) // BLOCK
        blocks = x[: n * BLOCK].reshape(n, BLOCK)
        driven, states = blocks @ self.drive.T, np.empty((n, len(self.state)))
        s = self.state
        for i in range(n):
            states[i] = s
            s = self.step @ s + driven[i]
        out = [(blocks @ self.response.T + states @ self.from_state.T).ravel()]
        for v in x[n * BLOCK :]:
            out.append([self.c @ s + self.d * v])
            s = self.a @ s + self.b * v
        self.state = s
        return np.concatenate(out)

    def flush(self) -> np.ndarray:
        return np.zeros(0)


def dc_blocker() -> LinearFilter:
    """y = x - previous x + 0.995 previous y; the state is y's share from the past."""
    r = 0.995
    return LinearFilter(np.array([[r]]), np.array([r - 1.0]), np.array([1.0]), 1.0)


def high_pass(cutoff: float, rate: float) -> LinearFilter:
    """Second-order Butterworth high-pass by the usual bilinear recipe, as a transposed state space."""
    w = 2 * math.pi * cutoff / rate
    alpha = math.sin(w) / math.sqrt(2)
    scale = 1 / (1 + alpha)
    b0, b1 = (1 + math.cos(w)) / 2 * scale, -(1 + math.cos(w)) * scale
    a1, a2 = -2 * math.cos(w) * scale, (1 - alpha) * scale
    return LinearFilter(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b0 - a2 * b0]), np.array([1.0, 0.0]), b0)


def decibels(db: float) -> float:
    return 10 ** (db / 20)


def smoothing(seconds: float, rate: float) -> float:
    return 1 - math.exp(-1 / (seconds * rate))


class GainControl:
    """Automatic gain towards a target level; one detector (mean square of the frame) for all channels.

    The gain found so far is applied first, then the frame moves it: the level follows the mean square with a
    slow average primed by the opening frames; above the noise floor, or for a while after, the gain falls fast
    and rises slowly (fast during a warm-up that only counts such frames); otherwise it stays.
    """

    # Level, attack and warm-up smoothing in seconds; rise in dB a second; warm-up and hangover in
    # seconds; noise floor and largest gain in dB.
    LEVEL_S, ATTACK_S, WARM_S, RISE_DB, WARM_LENGTH_S, HANG_S, FLOOR_DB, MOST_DB = 0.4, 0.010, 0.020, 6.0, 0.1, 0.2, -50.0, 30.0

    def __init__(self, target_db: float, rate: float):
        self.target, self.floor = decibels(target_db), decibels(self.FLOOR_DB)
        self.range = decibels(-self.MOST_DB), decibels(self.MOST_DB)
        slow, self.attack, self.warm = (smoothing(s, rate) for s in (self.LEVEL_S, self.ATTACK_S, self.WARM_S))
        self.rise, self.hang, self.warm_frames = decibels(self.RISE_DB / rate), int(self.HANG_S * rate), int(self.WARM_LENGTH_S * rate)
        self.opening = math.floor(1 / slow)  # so many frames are averaged evenly
        self.average = LinearFilter(np.array([[1 - slow]]), np.array([slow]), np.array([1 - slow]), slow)
        self.seen = self.moved = 0
        self.total, self.quiet, self.gain = 0.0, self.hang + 1, 1.0

    def levels(self, squares: np.ndarray) -> np.ndarray:
        """Root of the running average of mean squares: of all frames at first, then with exponential weights."""
        k = min(len(squares), max(0, self.opening - self.seen))
        even = (self.total + np.cumsum(squares[:k])) / (self.seen + 1 + np.arange(k))
        if k:
            self.total += float(squares[:k].sum())
            self.average.state = even[-1:].copy()
        self.seen += len(squares)
        return np.sqrt(np.concatenate([even, self.average.process(squares[k:])]))

    def moving(self, level: np.ndarray) -> np.ndarray:
        """The frames that move the gain: loud ones and those up to `hang` behind one."""
        at = np.arange(len(level))
        last = np.maximum.accumulate(np.where(level > self.floor, at, -1 - self.quiet))
        since = at - last
        if len(level):
            self.quiet = min(int(since[-1]), self.hang + 1)
        return np.flatnonzero(since <= self.hang)

    def gains(self, squares: np.ndarray) -> np.ndarray:
        """The gain of each frame, from the mean squares of the frames before it."""
        level = self.levels(squares)
        at = self.moving(level)
        with np.errstate(divide="ignore"):
            goals = np.clip(self.target / level[at], *self.range).tolist()
        warm = max(0, min(len(at), self.warm_frames - self.moved))
        self.moved += len(at)
        g, after = self.gain, []
        for goal in goals[:warm]:
            g += (goal - g) * (self.attack if goal <= g else self.warm)
            after.append(g)
        for goal in goals[warm:]:
            g = min(g * self.rise, goal) if goal > g else g + (goal - g) * self.attack
            after.append(g)
        out = np.concatenate([[self.gain], after])[np.searchsorted(at, np.arange(len(level)), "left")] if len(level) else np.zeros(0)
        self.gain = g
        return out

    def process(self, frames: np.ndarray) -> np.ndarray:
        """frames: n, or n x channels."""
        x = frames if frames.ndim == 2 else frames[:, None]
        return (x * self.gains((x * x).mean(1))[:, None]).reshape(frames.shape)

    def flush(self) -> np.ndarray:
        return np.zeros(0)


class Limiter:
    """Gain reduction by the frame's peak, which moves the gain before it is applied; never above the ceiling."""

    ATTACK_S, RELEASE_S = 0.0005, 0.050  # fixed values

    def __init__(self, ceiling_db: float, rate: float):
        self.ceiling, self.gain = decibels(ceiling_db), 1.0
        self.attack, self.release = smoothing(self.ATTACK_S, rate), smoothing(self.RELEASE_S, rate)

    def process(self, frames: np.ndarray) -> np.ndarray:
        x = frames if frames.ndim == 2 else frames[:, None]
        peaks = np.nanmax(np.abs(np.where(np.isnan(x), 0, x)), axis=1, initial=0)
        with np.errstate(invalid="ignore"):
            goals = np.where(peaks > self.ceiling, self.ceiling / np.maximum(peaks, self.ceiling), 1.0)
        gains, g = np.ones(len(x)), self.gain
        first = 0 if g != 1.0 else int(np.argmax(goals < 1)) if (goals < 1).any() else len(x)  # the gain rests at 1 before
        for i, goal in enumerate(goals[first:].tolist(), first):
            g += (goal - g) * (self.attack if goal < g else self.release)
            gains[i] = g
        self.gain = g
        with np.errstate(invalid="ignore"):
            y = np.clip(np.nan_to_num(x * gains[:, None], nan=0.0, posinf=np.inf, neginf=-np.inf), -self.ceiling, self.ceiling)
        return y.reshape(frames.shape)

    def flush(self) -> np.ndarray:
        return np.zeros(0)


class LinearResampler:
    """Linear interpolation with a fractional position carried between blocks.

    Each block is read while a right neighbour lies in it; the position left over, never below 0, begins the
    next block. A join of blocks is therefore not interpolated across.
    """

    def __init__(self, source: float, target: float):
        self.step, self.position = source / target, 0.0

    def process(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if self.step == 1:
            return x
        k = max(0, math.ceil((n - 1 - self.position) / self.step))
        p = self.position + np.arange(k) * self.step
        i = p.astype(int)
        y = x[i] + (x[np.minimum(i + 1, n - 1)] - x[i]) * (p - i) if k else np.zeros(0)
        self.position = max(0.0, self.position + k * self.step - n)
        return y

    def flush(self) -> np.ndarray:
        return np.zeros(0)


def sinc_taps(part: np.ndarray, half: int, cut: float) -> np.ndarray:
    """For each fraction of a sample the weights of the 2 * half samples round it: a sinc under a raised cosine."""
    t = np.arange(-half + 1, half + 1)[None] - part[:, None]
    return np.sinc(t * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))


@lru_cache(maxsize=64)
def tap_table(phases: int, half: int, cut: float) -> np.ndarray:
    return sinc_taps(np.arange(phases) / phases, half, cut)


class PolyphaseResampler:
    """Windowed-sinc resampling by a ratio; output j needs the input round j * source / target.

    An output has one of as many phases as the reduced upsampling factor. Up to PHASES of them the taps of all come from
    one table, made once for a pair of rates; beyond, each output's taps are computed.
    How much has come out after n inputs depends on the rates and n only; flush gives the tail.
    """

    TAPS, PHASES = 32, 1024

    def __init__(self, source: int, target: int):
        ratio = Fraction(source, target)
        self.same, self.ratio, self.total, self.made = source == target, ratio, 0, 0
        self.cut = min(1.0, target / source) * 0.95
        self.half = math.ceil(self.TAPS / 2 / self.cut)
        self.kept = np.zeros(self.half)  # silence before the first sample
        self.first = -self.half

    def _give(self, end: int) -> np.ndarray:
        """Outputs up to `end` (exclusive), from the samples at hand."""
        if end <= self.made:
            return np.zeros(0)
        j = np.arange(self.made, end)
        at, phase = np.divmod(j * self.ratio.numerator, self.ratio.denominator)
        near = np.lib.stride_tricks.sliding_window_view(self.kept, 2 * self.half)  # from each sample on
        if self.ratio.denominator <= self.PHASES:
            taps = tap_table(self.ratio.denominator, self.half, self.cut)[phase]
        else:
            taps = sinc_taps(phase / self.ratio.denominator, self.half, self.cut)
        y = np.einsum("jk,jk->j", near[at - self.first - self.half + 1], taps)
        self.made = end
        low = end * self.ratio.numerator // self.ratio.denominator - self.half
        drop = max(0, min(low - self.first, len(self.kept)))
        self.kept, self.first = self.kept[drop:], self.first + drop
        return y

    def process(self, x: np.ndarray) -> np.ndarray:
        if self.same:
            return x
        self.kept, self.total = np.concatenate([self.kept, x]), self.total + len(x)
        ready = max(0, self.total - self.half)  # outputs at or before input `ready - 1` have all they need
        return self._give(-(-ready * self.ratio.denominator // self.ratio.numerator))

    def flush(self) -> np.ndarray:
        if self.same:
            return np.zeros(0)
        self.kept = np.concatenate([self.kept, np.zeros(self.half + 1)])
        return self._give(-(-self.total * self.ratio.denominator // self.ratio.numerator))


class PerChannel:
    """An independent kernel for each channel of frames n x channels."""

    def __init__(self, make: Callable[[], object], channels: int):
        self.kernels = [make() for _ in range(channels)]

    def process(self, frames: np.ndarray) -> np.ndarray:
        return np.stack([k.process(frames[:, c]) for c, k in enumerate(self.kernels)], 1)

    def flush(self) -> np.ndarray:
        return np.stack([k.flush() for k in self.kernels], 1)


class Chain:
    """Kernels one behind the other; flush drains each through those behind it."""

    def __init__(self, kernels: list):
        self.kernels = kernels

    def process(self, frames: np.ndarray) -> np.ndarray:
        for k in self.kernels:
            frames = k.process(frames)
        return frames

    def flush(self) -> np.ndarray:
        tail = None
        for k in self.kernels:
            own = k.flush()
            own = own.reshape(-1, tail.shape[1]) if tail is not None and own.ndim == 1 and tail.ndim == 2 else own
            tail = own if tail is None or not len(tail) else np.concatenate([k.process(tail), own])
        return tail if tail is not None else np.zeros(0)


def series(first: LinearFilter, then: LinearFilter) -> LinearFilter:
    """Both, one behind the other, as one filter."""
    a = np.block([[first.a, np.zeros((len(first.b), len(then.b)))], [np.outer(then.b, first.c), then.a]])
    return LinearFilter(a, np.concatenate([first.b, then.b * first.d]), np.concatenate([then.d * first.c, then.c]), first.d * then.d)


class FilterCarry:
    """A linear filter as a carry: n rows take the state s to a^n s + what they drive."""

    def __init__(self, make: Callable[[], LinearFilter]):
        self.filter = make()

    def start(self) -> np.ndarray:
        return np.zeros(len(self.filter.b))

    def summary(self, x: np.ndarray) -> np.ndarray:
        self.filter.state = self.start()
        self.filter.process(x)
        return np.concatenate([[len(x)], self.filter.state])

    def composed(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return np.concatenate([[first[0] + then[0]], self.after(first[1:], then)])

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.filter.a, int(summary[0])) @ state + summary[1:]

    def outputs(self, state: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        self.filter.state = state
        return [self.filter.process(x)], self.filter.state


def scan_samples(samples: DataFrame, make: Callable[[], LinearFilter], out: str = "y", size: int = SEGMENT) -> DataFrame:
    """samples (stream_id, pos, x) through a linear filter, by a scan over segments: one stream is many tasks' work."""
    x = samples.select("stream_id", "pos", samples["x"].cast("double").alias("x"))
    return scanned(x, "pos", ["x"], lambda: FilterCarry(make), [(out, T.DoubleType())], size).drop("x")


def fold_samples(samples: DataFrame, make: Callable[[], object], out: str = "y") -> DataFrame:
    """samples (stream_id, pos, x) with the kernel's output, one fold per stream in position order, batch by batch.

    For kernels that keep the length.
    """
    x = samples.select("stream_id", "pos", samples["x"].cast("double").alias("x"))
    schema = T.StructType([*x.schema.fields[:2], T.StructField(out, T.DoubleType())])

    def run(batches):
        kernel = None
        for b, parts in spans(batches):
            v, y = b.column(2).to_numpy(zero_copy_only=False), []
            for a, z, fresh in parts:
                kernel = make() if fresh else kernel
                y.append(kernel.process(v[a:z]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(y), pa.float64())], names=schema.names)

    return in_order(x, ["stream_id"], ["pos"], run, schema)


def fold_chunks(chunks: DataFrame, make: Callable[[int, int], object], rate: int | None = None) -> DataFrame:
    """Chunk rows through make(sample_rate, channels), flushed at the end of each stream; ids, order and layout stay.

    Batch by batch: memory is a batch's and the kernel's, whatever the stream's length. Null data is an empty chunk, a
    part of a frame at a chunk's end is left out.
    """
    src = chunks.select("stream_id", "sample_rate", "channels", chunks["data"].cast("array<float>").alias("data"), "seq")
    types = (T.LongType(), T.IntegerType(), T.IntegerType(), T.ArrayType(T.FloatType()))
    schema = T.StructType([src.schema["stream_id"], *(T.StructField(n, t) for n, t in zip(("seq", "sample_rate", "channels", "data"), types))])

    def run(batches):
        kernel = who = None
        seq = channels = source = 0
        kind = None

        def given(rows: list[tuple]) -> pa.RecordBatch:
            ids, seqs, rates, widths, data = zip(*rows)
            sizes = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(sizes, np.concatenate(data).astype(np.float32))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(seqs, pa.int64()), pa.array(rates, pa.int32()), pa.array(widths, pa.int32()), lists], names=schema.names)

        def row(x: np.ndarray) -> list[tuple]:
            nonlocal seq
            if not len(x):
                return []
            seq += 1
            return [(who, seq - 1, rate or source, channels, np.asarray(x, np.float32).ravel())]

        for b, parts in spans(batches):
            rows, kind = [], b.schema.field(0).type
            for a, z, fresh in parts:
                if fresh:
                    rows += row(kernel.flush()) if kernel is not None else []
                    who, source, channels, seq = b.column(0)[a].as_py(), b.column(1)[a].as_py(), b.column(2)[a].as_py(), 0
                    kernel = make(source, channels)
                for i in range(a, z):
                    data = b.column(3)[i].values
                    x = data.to_numpy(zero_copy_only=False).astype(float) if data is not None else np.zeros(0)
                    rows += row(kernel.process(x[: len(x) // channels * channels].reshape(-1, channels)))
            if rows:
                yield given(rows)
        if kernel is not None and (rows := row(kernel.flush())):
            yield given(rows)

    return in_order(src, ["stream_id"], ["seq"], run, schema)
