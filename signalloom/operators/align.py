"""A captured stream beside its reference: queueing, alignment by position, echo cancelling.

The reference is a queue that each near-end block empties at its own pace: a missing sample is silence, a
surplus one waits. At equal rates the queue's level and the silence supplied follow from running sums alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import PolyphaseResampler
from .ordered import SEGMENT, running, scanned


def reference_levels(blocks: DataFrame) -> DataFrame:
    """Rows (stream_id, ord, pushed, wanted) with queued after the block and silence supplied in it."""
    order = Window.partitionBy("stream_id").orderBy("ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.withColumn("__s", F.sum(F.col("pushed") - F.col("wanted")).over(so_far))
    df = df.withColumn("queued", F.col("__s") - F.least(F.lit(0), F.min("__s").over(so_far)))
    before = F.coalesce(F.lag("queued").over(order), F.lit(0))
    return df.withColumn("silence", F.greatest(F.lit(0), F.col("wanted") - before - F.col("pushed"))).drop("__s")


def clamp_maps(shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All prefixes of steps x -> max(low, min(high, x + shift)); such steps compose to steps of the same kind, so by doubling."""
    shift, low, high, d = shift.copy(), low.copy(), np.maximum(low, high), 1
    while d < len(shift):
        s, lo, hi = shift[d:], low[d:], high[d:]
        shift[d:], low[d:], high[d:] = shift[:-d] + s, np.clip(low[:-d] + s, lo, hi), np.clip(high[:-d] + s, lo, hi)
        d *= 2
    return shift, low, high


def clamp_scan(shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Running values of the steps from 0 on."""
    return np.clip(*clamp_maps(shift, low, high))


class QueueCarry:
    """A bounded queue as a carry: rows of samples pushed and wanted shift its level between limits."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def steps(self, pushed: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, w = pushed.astype(np.int64), wanted.astype(np.int64)
        return p - w, np.zeros(len(p), np.int64), np.maximum(0, self.capacity - w)

    def start(self) -> np.ndarray:
        return np.zeros(1)

    def summary(self, pushed: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return np.array([c[-1] for c in clamp_maps(*self.steps(pushed, wanted))], float)

    def composed(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        (s1, low1, high1), (s2, low2, high2) = first, then
        return np.array([s1 + s2, np.clip(low1 + s2, low2, high2), np.clip(high1 + s2, low2, high2)])

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return np.clip(state + summary[0], summary[1], summary[2])

    def outputs(self, state: np.ndarray, pushed: np.ndarray, wanted: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        p, w, level = pushed.astype(np.int64), wanted.astype(np.int64), int(state[0])
        shift, low, high = self.steps(pushed, wanted)
        low[0] = high[0] = np.clip(level + shift[0], 0, high[0])
        after = clamp_scan(shift, low, high)
        before = np.concatenate([[level], after[:-1]])
        kept = np.minimum(p, self.capacity - before)
        return [after, np.maximum(0, w - before - kept), p - kept], np.array([after[-1]], float)


def capped_levels_scanned(blocks: DataFrame, capacity: int, size: int = SEGMENT) -> DataFrame:
    """`capped_levels` (queued, silence, dropped) by a scan over segments of `size` in ord: one stream is many tasks' work."""
    new = [(c, T.LongType()) for c in ("queued", "silence", "dropped")]
    return scanned(blocks, "ord", ["pushed", "wanted"], lambda: QueueCarry(capacity), new, size)


def reference_levels_scanned(blocks: DataFrame, size: int = SEGMENT) -> DataFrame:
    """`reference_levels` (queued, silence) from running sums by segments."""
    df = running(blocks, "ord", size, "sum", F.col("pushed") - F.col("wanted"), "__s")
    df = running(df, "ord", size, "min", F.col("__s"), "__low")
    df = df.withColumn("queued", F.col("__s") - F.least(F.lit(0), F.col("__low")))
    # the level before a block follows from the sums behind it, without its row
    sum_before = F.col("__s") - F.col("pushed") + F.col("wanted")
    low_before = running(df.withColumn("__b", sum_before), "ord", size, "min", F.col("__b"), "__lb")
    before = F.col("__b") - F.least(F.lit(0), F.col("__lb"))
    return low_before.withColumn("silence", F.greatest(F.lit(0), F.col("wanted") - before - F.col("pushed"))).drop("__s", "__low", "__b", "__lb")


def capped_levels(blocks: DataFrame, capacity: int) -> DataFrame:
    """The same with a bounded queue that drops the newest surplus, with dropped; streams in batches, in order."""
    names = blocks.columns
    ids, pushed, wanted = (names.index(c) for c in ("stream_id", "pushed", "wanted"))

    def run(batches):
        last, level = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            p, w = b.column(pushed).to_numpy().astype(np.int64), b.column(wanted).to_numpy().astype(np.int64)
            streams = pa.concat_arrays([pa.array(last, b.schema.field(ids).type), b.column(ids)])
            code = pd.factorize(streams.to_pandas(), use_na_sentinel=False)[0]
            fresh = np.concatenate([[True], code[1:] != code[:-1]])[len(last) :]
            shift, low, high = p - w, np.zeros(len(p), np.int64), np.maximum(0, capacity - w)
            known = fresh.copy()  # rows whose level before is known: one value whatever came before
            known[0] = True
            first = np.where(fresh, 0, level)[known]
            low[known] = high[known] = np.clip(first + shift[known], 0, high[known])
            after = clamp_scan(shift, low, high)
            before = np.where(fresh, 0, np.concatenate([[level], after[:-1]]))
            kept = np.minimum(p, capacity - before)
            new = (after, np.maximum(0, w - before - kept), p - kept)
            last, level = b.column(ids)[-1:].to_pylist(), int(after[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in new)], names=[*names, "queued", "silence", "dropped"])

    schema = T.StructType([*blocks.schema.fields, *(T.StructField(c, T.LongType()) for c in ("queued", "silence", "dropped"))])
    return blocks.repartition("stream_id").sortWithinPartitions("stream_id", "ord").mapInArrow(run, schema)


def aligned(near: DataFrame, far: DataFrame) -> DataFrame:
    """near (stream_id, pos, x) with the far sample at the same position, silence where there is none.

    far positions are those assigned by the queue; one equi-join on (stream_id, pos).
    """
    f = far.select("stream_id", "pos", F.col("x").alias("far"))
    return near.join(f, ["stream_id", "pos"], "left").withColumn("missing", F.col("far").isNull()).withColumn("far", F.coalesce("far", F.lit(0.0)))


class EchoCanceller:
    """Adaptive filter in the frequency domain, partitioned in blocks (overlap-save, normalised steps).

    With a silent reference the output is the input, bit for bit. suppress: what is left of the echo is lowered further, by
    LEAST at most, where the echo found is strong beside the output.
    """

    LEAST = 0.5

    def __init__(self, tail: int, block: int = 256, step: float = 0.5, suppress: bool = False):
        self.suppress, self.gain = suppress, 1.0
        self.n, self.parts, self.step = block, max(1, -(-tail // block)), step
        self.weights = np.zeros((self.parts, block + 1), complex)
        self.far_spectra = np.zeros((self.parts, block + 1), complex)
        self.last, self.power = np.zeros(block), np.zeros(block + 1)
        self.near_left, self.far_left = np.zeros(0), np.zeros(0)

    def process(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Blocks that are complete so far; the rest waits."""
        near, far = np.concatenate([self.near_left, near]), np.concatenate([self.far_left, far])
        k, out = min(len(near), len(far)) // self.n, []
        for i in range(k):
            a = slice(i * self.n, (i + 1) * self.n)
            out.append(self._block(near[a], far[a]))
        self.near_left, self.far_left = near[k * self.n :], far[k * self.n :]
        return np.concatenate(out) if out else np.zeros(0)

    def flush(self) -> np.ndarray:
        """What waits, with silence for what the reference lacks."""
        n = len(self.near_left)
        short = n + -n % self.n - len(self.far_left)
        out = self.process(np.zeros(-n % self.n), np.zeros(max(0, short))) if n else np.zeros(0)
        return out[:n]

    def _block(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        spectrum = np.fft.rfft(np.concatenate([self.last, far]))
        self.last = far
        self.far_spectra = np.concatenate([spectrum[None], self.far_spectra[:-1]])
        if not self.far_spectra.any():
            return near
        echo = np.fft.irfft((self.weights * self.far_spectra).sum(0))[self.n :]
        error = near - echo
        self.power = 0.9 * self.power + 0.1 * (np.abs(self.far_spectra) ** 2).sum(0)
        e = np.fft.rfft(np.concatenate([np.zeros(self.n), error]))
        g = self.step * np.conj(self.far_spectra) * e / (self.power + 1e-6)
        t = np.fft.irfft(g, axis=1)
        t[:, self.n :] = 0  # only causal taps of each part
        self.weights = self.weights + np.fft.rfft(t, axis=1)
        if not self.suppress:
            return error
        left = float((error * error).sum())
        goal = max(self.LEAST, left / (left + 0.01 * float((echo * echo).sum()) + 1e-12))
        ramp, self.gain = np.linspace(self.gain, goal, self.n), goal
        return error * ramp


def echo_cancelled(pairs: DataFrame, tail: int, block: int = 256) -> DataFrame:
    """Aligned rows (stream_id, pos, x, far) with y, the captured sample without the echo of far."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, e = g.sort_values("pos"), EchoCanceller(tail, block)
        y = np.concatenate([e.process(g["x"].to_numpy(float), g["far"].to_numpy(float)), e.flush()])
        return pd.DataFrame({"stream_id": g["stream_id"], "pos": g["pos"], "y": y})

    kind = pairs.schema["stream_id"].dataType.simpleString()
    return pairs.select("stream_id", "pos", "x", "far").groupBy("stream_id").applyInPandas(run, f"stream_id {kind}, pos long, y double")


def echo_metrics(cancelled: DataFrame, *by: str) -> DataFrame:
    """Per stream (and `by`, such as a channel): echo return loss enhancement in dB and silence supplied.

    For rows (x, far, missing, y); one hash aggregation.
    """
    g = cancelled.groupBy("stream_id", *by).agg(F.sum(F.col("x") * F.col("x")).alias("__i"), F.sum(F.col("y") * F.col("y")).alias("__o"), F.count_if("missing").alias("silence"))
    return g.select("stream_id", *by, (10 * F.log10((F.col("__i") + 1e-12) / (F.col("__o") + 1e-12))).alias("erle_db"), "silence")


class LiveCanceller:
    """Near and far samples as they come: the far ones wait in a bounded queue, the near ones set the pace.

    One engine per near channel, made at the first near block, hears the same reference, which is averaged over its channels
    and brought to the near rate. A near block takes as much reference as the far end lags behind it; only when none is
    queued, silence makes up the rest. Several channels are fed in whole blocks of the engine. Counters: far samples
    dropped (the newest) at a full queue, silence supplied at an empty one.
    """

    def __init__(self, tail: int, channels: int | None = None, capacity: int = 32_000, block: int = 256, rate: int = 16_000, reference_rate: int | None = None, suppress: bool = False):
        self.tail, self.block, self.capacity, self.suppress = tail, block, capacity, suppress
        self.rate, self.reference_rate = rate, reference_rate or rate
        self.resampler = PolyphaseResampler(self.reference_rate, rate) if self.reference_rate != rate else None
        self.engines = self.pending = None
        self.queue, self.dropped, self.silence = np.zeros(0), 0, 0
        self.far_fed = self.near_seen = 0
        if channels is not None:
            self._prepare(channels)

    def _prepare(self, channels: int) -> None:
        self.engines = [EchoCanceller(self.tail, self.block, suppress=self.suppress) for _ in range(channels)]
        self.pending = np.zeros((0, channels))
        self.power = np.zeros((2, channels))

    def push_reference(self, far: np.ndarray) -> None:
        """far: n, or n x channels, which are averaged."""
        far = far if far.ndim == 1 else far.mean(1)
        room = self.capacity - len(self.queue)
        self.dropped += max(0, len(far) - room)
        self.queue = np.concatenate([self.queue, far[:room]])

    def _reference(self, n: int) -> np.ndarray:
        """Reference for n more near samples."""
        self.near_seen += n
        budget = self.near_seen - self.far_fed
        if budget <= 0:
            return np.zeros(0)
        take = -(-budget * self.reference_rate // self.rate)
        far, self.queue = self.queue[:take], self.queue[take:]
        if not len(far):  # silence only where nothing is queued: in front of queued reference it would be a gap
            self.silence += budget
            self.far_fed += budget
            return np.zeros(budget)
        far = self.resampler.process(far) if self.resampler else far
        self.far_fed += len(far)
        return far

    def _cancelled(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        out = np.stack([e.process(near[:, c], far) for c, e in enumerate(self.engines)], 1)
        return self._measured(near, out)

    def _measured(self, near: np.ndarray, out: np.ndarray) -> np.ndarray:
        self.power += np.stack([(near * near).sum(0), (out * out).sum(0)])
        return out

    def process(self, near: np.ndarray) -> np.ndarray:
        """near: n x channels."""
        if self.engines is None:
            self._prepare(near.shape[1])
        if len(self.engines) > 1:
            near = np.concatenate([self.pending, near])
            whole = len(near) // self.block * self.block
            near, self.pending = near[:whole], near[whole:]
        return self._cancelled(near, self._reference(len(near))) if len(near) else near[:0]

    def flush(self) -> np.ndarray:
        if self.engines is None:
            return np.zeros((0, 1))
        rest, self.pending = self.pending, self.pending[:0]
        tail = self._cancelled(rest, self._reference(len(rest)))
        left, self.queue = self.queue, self.queue[:0]
        if self.resampler:
            left = np.concatenate([self.resampler.process(left), self.resampler.flush()])
        more = self._cancelled(rest[:0], left)
        end = np.stack([e.flush() for e in self.engines], 1)
        return np.concatenate([tail, more, self._measured(end[:0], end)])

    @property
    def delays(self) -> list[int]:
        """Where each channel's filter is strongest, in samples."""
        return [int(np.abs(np.fft.irfft(e.weights, axis=1)[:, : e.n].ravel()).argmax()) for e in self.engines or []]

    @property
    def delay(self) -> int:
        return self.delays[0] if self.engines else 0

    def counters(self) -> dict:
        power = self.power if self.engines else np.ones((2, 0))
        return {"dropped": self.dropped, "silence": self.silence, "delays": self.delays, "erle_db": (10 * np.log10((power[0] + 1e-12) / (power[1] + 1e-12))).tolist()}
