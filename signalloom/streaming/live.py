"""Live streams: chunk files as they land, folded with keyed state.

A stream is folded by its sequence numbers, in whatever order its chunks arrive: a chunk that is early waits in the state, one
whose number was folded already is rejected and counted. A gap is passed over when `hold` chunks wait behind it or
`patience_ms` have gone by, and counted as missing. Rows without a number are rejected, ones without data only end a stream. A row with `last` flushes the kernels once and closes the stream; what
comes later is rejected and counted, never merged. A closed stream leaves the state after `forget_ms`; one that
is idle for `idle_ms` is flushed and closed. Timers fire in triggers, so they need a query that goes on.

`queue` bounds what one trigger takes of a stream, as a full capture queue does: the newest chunks beyond it are dropped and
counted as overrun.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.align import LiveCanceller
from ..operators.blocks import Blocks, EnergyScore

LIVE = "stream_id string, seq long, sample_rate int, channels int, data array<float>, last boolean"
#: Both sides of a conversation under one numbering; side is `far` for what was played.
SIDED = LIVE + ", side string"
_ECHO = "struct<dropped: bigint, silence: bigint, delays: array<int>, erle_db: array<double>>"
OUT = f"stream_id string, seq long, sample_rate int, channels int, data array<float>, closed boolean, rejected long, missing long, overrun long, score double, is_speaking boolean, echo {_ECHO}"
COLUMNS = ["stream_id", "seq", "sample_rate", "channels", "data", "closed", "rejected", "missing", "overrun", "score", "is_speaking", "echo"]


def capture(spark: SparkSession, path: str, files_per_trigger: int = 64, sided: bool = False) -> DataFrame:
    """Chunk rows from a folder of Parquet files; so many files a trigger is the backpressure."""
    return spark.readStream.schema(SIDED if sided else LIVE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class _Stream:
    """One stream's fold, the chunks that wait for earlier ones, and what was counted since the last row given."""

    def __init__(self):
        self.blocks: Blocks | None = None
        self.waiting: dict[int, tuple] = {}  # by sequence number
        self.want = self.seq = self.done = 0
        self.loud: float | None = None
        self.closed, self.since = False, None  # since: when the gap began
        self.rejected = self.missing = self.overrun = 0

    def arrive(self, rows, queue: int | None) -> None:
        taken = 0
        for r in rows:
            seq = -1 if pd.isna(r.seq) else int(r.seq)
            if self.closed or seq < self.want or seq in self.waiting:
                self.rejected += 1
                continue
            full = queue is not None and taken >= queue
            taken, self.overrun = taken + (not full), self.overrun + full
            data = np.zeros(0, np.float32) if full or r.data is None else np.asarray(r.data, np.float32)
            self.waiting[seq] = (r.sample_rate, r.channels, data, bool(r.last), getattr(r, "side", None))

    def pass_gap(self) -> None:
        if self.waiting:
            first = min(self.waiting)
            self.missing += first - self.want
            self.want = first

    def ready(self) -> Iterator[tuple]:
        while self.want in self.waiting:
            self.want += 1
            yield self.waiting.pop(self.want - 1)


def folded(
    chunks: DataFrame,
    make: Callable[[int, int | None], object],
    frames: int | None = None,
    rate: int | None = None,
    level: float | None = None,
    holdoff: float = 0.0,
    channel: int | None = None,
    factory: Callable[[], object] | None = None,
    hold: int = 64,
    patience_ms: int = 10_000,
    forget_ms: int = 60_000,
    idle_ms: int | None = None,
    queue: int | None = None,
) -> DataFrame:
    """Output blocks of make(rate, channels) for each stream; works on a stream of LIVE or SIDED rows.

    make gives operators.blocks.Blocks, or one kernel, which is then a transforming step cut into `frames` frames, its score the
    energy of what goes in (of one channel, or of the mean). level: is_speaking from the score and the holdoff by the time of the
    samples at `rate`. Counts are of what happened since the row before; a row without data has what no block carries.
    """

    def start(source: int, channels: int | None) -> Blocks:
        made = make(source, channels)
        if not isinstance(made, Blocks):
            made = Blocks([], None, [made], channels, frames, channel, EnergyScore() if level is not None else None)
        return made

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else _Stream()
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut and s.closed:
            state.remove()
            return
        rows, source = [], None
        if s.blocks is not None and s.blocks.score is not None:
            s.blocks.score.bind(factory)

        def give(blocks: list) -> None:
            for block, score in blocks:
                if not len(block):
                    continue
                speaking = None
                if level is not None and score is not None:
                    s.done += len(block)
                    end = s.done / (rate or source or 1)
                    s.loud = end if score >= level else s.loud
                    speaking = s.loud is not None and (score >= level or end - s.loud < holdoff)
                row(rate or source, s.blocks.channels, block.astype(np.float32).ravel(), score, speaking)

        def row(at, channels, data, score=None, speaking=None) -> None:
            echo = s.blocks.echo.counters() if s.blocks is not None and s.blocks.echo is not None else None
            rows.append([key[0], s.seq, at, channels, data, False, s.rejected, s.missing, s.overrun, score, speaking, echo])
            s.rejected = s.missing = s.overrun = 0
            s.seq += data is not None

        def finish() -> None:
            give(s.blocks.finish() if s.blocks is not None else [])
            if not rows:
                row(rate or source, s.blocks.channels if s.blocks is not None else None, np.zeros(0, np.float32))
            rows[-1][5] = s.closed = True
            s.blocks, s.waiting = None, {}

        def fold() -> None:
            nonlocal source
            for at, channels, data, last, side in s.ready():
                far = side == "far"
                if not len(data):  # dropped, or without data: nothing but maybe the end
                    if last and not far:
                        finish()
                        return
                    continue
                if s.blocks is None:
                    s.blocks = start(int(at), None if far else int(channels))
                    if s.blocks.score is not None:
                        s.blocks.score.bind(factory)
                x = data.astype(float)[: len(data) // int(channels) * int(channels)].reshape(-1, int(channels))
                if far:
                    s.blocks.push_reference(x)
                else:
                    source = int(at)
                    give(s.blocks.push(x))
                if last and not far:
                    finish()
                    return

        if state.hasTimedOut:
            if s.waiting:
                s.pass_gap()
                fold()
            elif not s.closed:
                finish()
        else:
            g = pd.concat(list(groups))
            s.arrive(g.sort_values("seq", kind="stable").itertuples(), queue)
            fold()
            while len(s.waiting) > hold and not s.closed:
                s.pass_gap()
                fold()
        if s.rejected or s.missing or s.overrun:
            row(None, None, None)
            rows[-1][5] = s.closed
        s.since = (s.since or now) if s.waiting else None
        state.update((pickle.dumps(s),))
        left = forget_ms if s.closed else s.since + patience_ms - now if s.waiting else idle_ms
        if left is not None:
            state.setTimeoutDuration(max(1, int(left)))
        yield pd.DataFrame(rows, columns=COLUMNS)

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, "stream binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def observed(frames: DataFrame, name: str = "live") -> DataFrame:
    """The rows of `folded` with their counters as metrics of the query's progress."""
    return frames.observe(name, *[F.sum(c).alias(c) for c in ("rejected", "missing", "overrun")], F.count_if("closed").alias("closed"))


def speaking(scores: DataFrame, threshold: float, holdoff: float) -> DataFrame:
    """Live speaking state of rows (stream_id, seq, start, end, score); only the last loud end is kept."""

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(groups)).sort_values("seq")
        loud = state.get[0] if state.exists else None
        on = []
        for score, end in zip(g["score"], g["end"]):
            loud = end if score >= threshold else loud
            on.append(loud is not None and (score >= threshold or end - loud < holdoff))
        if loud is not None:
            state.update((float(loud),))
        yield pd.DataFrame({"stream_id": g["stream_id"], "seq": g["seq"], "score": g["score"], "is_speaking": on})

    return scores.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, score double, is_speaking boolean", "loud double", "append", GroupStateTimeout.NoTimeout)


def speaking_now(scores: DataFrame, threshold: float, holdoff_ms: int) -> DataFrame:
    """Transitions by the clock: `speech` at a loud row, `silence` once the holdoff has passed since the first quiet one behind it.

    Expiry is settled before a new row is read, so a loud row that comes after the deadline begins anew. A pause without
    rows doesn't end speech. Rows of one trigger go by `seq` where there is one. A silent stream has no state. The clock is
    the engine's processing time, so results depend on when rows arrive; use `speaking` where they must not.
    """
    numbered = "seq" in scores.columns

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, events = state.getCurrentProcessingTimeMs(), []
        deadline = state.get[0] if state.exists else None  # of a speaking stream; 0: no quiet row since
        if deadline and now >= deadline:
            events, deadline = ["silence"], None
        if not state.hasTimedOut:
            g = pd.concat(list(groups))
            for loud in (g.sort_values("seq") if numbered else g)["score"] >= threshold:
                if loud:
                    events += ["speech"] if deadline is None else []
                    deadline = 0
                elif deadline == 0:
                    deadline = now + holdoff_ms
        if deadline is None:
            if state.exists:
                state.remove()
        else:
            state.update((deadline,))
            if deadline:  # the engine forgets the timeout at every call
                state.setTimeoutDuration(max(1, deadline - now))
        yield pd.DataFrame({"stream_id": [key[0]] * len(events), "event": events})

    return scores.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, event string", "deadline long", "append", GroupStateTimeout.ProcessingTimeTimeout)


PAIRED = "stream_id string, ord long, side string, channels int, data array<float>, last boolean"


def echo_cancelled(rows: DataFrame, tail: int, capacity: int = 32_000, rate: int = 16_000, reference_rate: int | None = None) -> DataFrame:
    """Live near and far blocks (PAIRED rows in ord, from 0) to near blocks without echo, with the queue's counters."""
    chunks = rows.select("stream_id", F.col("ord").alias("seq"), F.lit(rate).alias("sample_rate"), "channels", "data", "last", "side")
    out = folded(chunks, lambda _, c: Blocks([], LiveCanceller(tail, c, capacity, rate=rate, reference_rate=reference_rate), [], c, None), rate=rate)
    return out.select("stream_id", F.col("seq").alias("ord"), "channels", "data", "closed", "rejected", "echo.dropped", "echo.silence", F.element_at("echo.delays", 1).cast("long").alias("delay"), "echo.erle_db")


def play(frames: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Write each micro-batch of what has landed once, in order of its id; a batch seen again after a restart has the same id.

    Batches without new rows are left out, since with timers there would be no end of them: timers that are due by then fire
    in the next run.
    """
    conf, key = frames.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # the query takes the settings of the moment it starts
    try:
        return frames.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
