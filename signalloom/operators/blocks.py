"""A stream as delivered blocks with the detector's feed beside them.

Two signals come out of one fold: the conditioned samples, cut into blocks, and the tap, which is the signal before any
transforming step (behind layout, resampling and echo cancelling), collapsed to the mean of its channels or to
one of them. The tap is drained in step: a block of n frames takes the next n frames of it, fewer at the end of a stream whose
last step holds samples back. A detector scores what was drained, so gain control or filters never change its scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import LiveCanceller
from .folds import Chain, PolyphaseResampler
from .models import Session, WindowDetector, session
from .ordered import in_order, spans


class EnergyScore:
    """Root mean square of a feed; none of an empty one."""

    def __call__(self, feed: np.ndarray) -> float | None:
        return float(np.sqrt(np.mean(feed * feed))) if len(feed) else None

    def bind(self, factory: Callable[[], Session] | None) -> None: ...


class ModelScore:
    """The largest window score of a feed at the detector's rate; 0 if no window was completed, none of an empty feed.

    The model belongs to the worker and is bound anew after the state was stored.
    """

    def __init__(self, key: str, rate: int, detector_rate: int, window: int):
        self.key, self.detector = key, WindowDetector(None, detector_rate, window)
        self.resampler = PolyphaseResampler(rate, detector_rate) if rate != detector_rate else None

    def bind(self, factory: Callable[[], Session] | None) -> None:
        self.detector.model = session(self.key, factory)

    def __getstate__(self) -> dict:
        model, self.detector.model = self.detector.model, None
        try:
            kept = WindowDetector(None, self.detector.rate, self.detector.window)
            kept.__dict__.update(self.detector.__dict__)
            return {**self.__dict__, "detector": kept}
        finally:
            self.detector.model = model

    def __call__(self, feed: np.ndarray) -> float | None:
        if not len(feed):
            return None
        x = self.resampler.process(feed) if self.resampler else feed
        return max(self.detector.scores(x), default=0.0)


class Blocks:
    """normalise, tap, transform and cut one stream; frames None gives blocks as they come.

    Samples are n x channels. `push` and `finish` give (block, score) in order; a score stays until a feed changes it.
    """

    def __init__(self, normalise: list, echo: LiveCanceller | None, transform: list, channels: int | None, frames: int | None, source: int | None = None, score=None):
        """channels None: those of the first block."""
        self.normalise, self.echo, self.transform = normalise, echo, transform
        self.channels, self.frames, self.source, self.score = channels, frames, source, score
        self.left, self.tap, self.last = None, np.zeros(0), None

    def push_reference(self, far: np.ndarray) -> None:
        if self.echo is not None:
            self.echo.push_reference(far)

    def _tapped(self, x: np.ndarray) -> np.ndarray:
        if self.score is not None:
            self.tap = np.concatenate([self.tap, x.mean(1) if self.source is None else x[:, self.source]])
        return x

    def _cut(self, y: np.ndarray, end: bool) -> list[tuple[np.ndarray, float | None]]:
        y = np.concatenate([self.left, y]) if self.left is not None else y
        size = self.frames or max(1, len(y))
        whole = len(y) if end else len(y) // size * size
        out = []
        for a in range(0, whole, size):
            block = y[a : min(whole, a + size)]
            if self.score is not None:
                feed, self.tap = self.tap[: len(block)], self.tap[len(block) :]
                got = self.score(feed)
                self.last = self.last if got is None else got
            out.append((block, self.last))
        self.left = y[whole:]
        return out

    def push(self, x: np.ndarray) -> list[tuple[np.ndarray, float | None]]:
        self.channels = self.channels or x.shape[1]
        x = Chain(self.normalise).process(x)
        x = self.echo.process(x) if self.echo is not None else x
        return self._cut(Chain(self.transform).process(self._tapped(x)), False)

    def finish(self) -> list[tuple[np.ndarray, float | None]]:
        if self.channels is None:  # nothing came but reference
            return []
        shaped = lambda y: np.asarray(y).reshape(-1, self.channels)
        tail = shaped(Chain(self.normalise).flush())
        if self.echo is not None:
            tail = np.concatenate([shaped(self.echo.process(tail)), shaped(self.echo.flush())])
        y = Chain(self.transform).process(self._tapped(tail))
        return self._cut(np.concatenate([shaped(y), shaped(Chain(self.transform).flush())]), True)


COUNTERS = T.StructType([T.StructField("dropped", T.LongType()), T.StructField("silence", T.LongType()), T.StructField("delays", T.ArrayType(T.IntegerType())), T.StructField("erle_db", T.ArrayType(T.DoubleType()))])


def far_and_near(near: DataFrame, far: DataFrame | None) -> DataFrame:
    """Chunk rows of both sides in the order in which they were heard: by their start in seconds, the reference first."""

    def timed(c: DataFrame, is_near: bool) -> DataFrame:
        n = F.coalesce(F.size("data"), F.lit(0)) / F.col("channels")
        by = Window.partitionBy("stream_id").orderBy("seq")
        return c.select("stream_id", "sample_rate", "channels", F.col("data").cast("array<float>").alias("data"), "seq", ((F.sum(n).over(by) - n) / F.col("sample_rate")).alias("start"), F.lit(is_near).alias("near"))

    if far is None:
        return near.select("stream_id", "sample_rate", "channels", F.col("data").cast("array<float>").alias("data"), "seq", F.lit(0.0).alias("start"), F.lit(True).alias("near"))
    return timed(near, True).unionByName(timed(far, False))


def fold_blocks(near: DataFrame, make: Callable[[int, int], Blocks], rate: int, far: DataFrame | None = None, factory: Callable[[], Session] | None = None) -> DataFrame:
    """(stream_id, seq, sample_rate, channels, data, score, echo): the blocks of each stream, batch by batch.

    far: reference chunks of the same stream ids, pushed in step; a stream without near chunks gives nothing. echo holds the
    queue's counters and each channel's delay and echo return loss enhancement so far, null without a reference stage.
    """
    src = far_and_near(near, far)
    types = (T.LongType(), T.IntegerType(), T.IntegerType(), T.ArrayType(T.FloatType()), T.DoubleType(), COUNTERS)
    schema = T.StructType([src.schema["stream_id"], *(T.StructField(n, t) for n, t in zip(("seq", "sample_rate", "channels", "data", "score", "echo"), types))])

    def run(batches):
        fold = who = kind = None
        seq, waiting = 0, []

        def rows(found: list) -> list[tuple]:
            nonlocal seq
            out = []
            for block, score in found:
                if len(block):
                    out.append((who, seq, rate, fold.channels, np.asarray(block, np.float32).ravel(), score, fold.echo.counters() if fold.echo is not None else None))
                    seq += 1
            return out

        def given(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found))
            kinds = (kind, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.float64(), ECHO)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=schema.names)

        for b, parts in spans(batches):
            found, kind = [], b.schema.field(0).type
            is_near = b.column(6).to_numpy(zero_copy_only=False)
            for a, z, fresh in parts:
                if fresh:
                    found += rows(fold.finish()) if fold is not None else []
                    fold, seq, waiting, who = None, 0, [], b.column(0)[a].as_py()
                for i in range(a, z):
                    source, channels, data = b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].values
                    x = data.to_numpy(zero_copy_only=False).astype(float) if data is not None else np.zeros(0)
                    x = x[: len(x) // channels * channels].reshape(-1, channels)
                    if not is_near[i]:
                        if fold is None:
                            waiting.append(x)
                        else:
                            fold.push_reference(x)
                        continue
                    if fold is None:
                        fold = make(source, channels)
                        if fold.score is not None:
                            fold.score.bind(factory)
                        for w in waiting:
                            fold.push_reference(w)
                    found += rows(fold.push(x))
            if found:
                yield given(found)
        if fold is not None and (found := rows(fold.finish())):
            yield given(found)

    return in_order(src, ["stream_id"], ["start", "near", "seq"], run, schema)


ECHO = pa.struct([("dropped", pa.int64()), ("silence", pa.int64()), ("delays", pa.list_(pa.int32())), ("erle_db", pa.list_(pa.float64()))])
