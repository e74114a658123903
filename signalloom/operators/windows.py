"""Count windows, segments and speaking state as window functions over ordered sample or chunk rows.

Every operator is partitioned by the stream; order columns are integers, so results don't depend on how rows
were batched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SEGMENT, running


def positions(df: DataFrame, stream: str, *order: str, name: str = "pos") -> DataFrame:
    """Position from 0 within each stream."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(stream).orderBy(*order)).cast("long") - 1)


def score_windows(samples: DataFrame, size: int, rate: float, threshold: float) -> DataFrame:
    """Energy of each whole window of `size` samples; a trailing part is not scored."""
    w = samples.groupBy("stream_id", F.floor(F.col("pos") / size).alias("win")).agg(F.count("*").alias("__n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("probability"))
    w = w.filter(F.col("__n") == size)
    return w.select("stream_id", "win", (F.col("win") * size / rate).alias("start"), ((F.col("win") + 1) * size / rate).alias("end"), "probability", (F.col("probability") >= threshold).alias("is_speech"))


def segments(windows: DataFrame, holdoff: float) -> DataFrame:
    """Speech windows joined while the gap from the last one's end is at most holdoff."""
    by = Window.partitionBy("stream_id").orderBy("win")
    s = windows.filter("is_speech").withColumn("__new", F.coalesce(F.col("start") - F.lag("end").over(by) > holdoff, F.lit(True)).cast("long"))
    s = s.withColumn("seg", F.sum("__new").over(by) - 1)
    return s.groupBy("stream_id", "seg").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def speaking_state(chunks: DataFrame, threshold: float, holdoff: float) -> DataFrame:
    """is_speaking for chunks (stream_id, seq, start, end, score): on at the threshold, off once holdoff has passed.

    Silence begins where the last loud chunk ended, and time only grows, so the state is a running maximum.
    """
    by = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    above = F.col("score") >= threshold
    last = F.max(F.when(above, F.col("end"))).over(by)
    return chunks.withColumn("is_speaking", F.coalesce(above | (F.col("end") - last < holdoff), F.lit(False)))


def speaking_state_scanned(chunks: DataFrame, threshold: float, holdoff: float, size: int = SEGMENT) -> DataFrame:
    """`speaking_state` by segments of `size` in seq: one stream is many tasks' work."""
    above = F.col("score") >= threshold
    df = running(chunks, "seq", size, "max", F.when(above, F.col("end")), "__last")
    return df.withColumn("is_speaking", F.coalesce(above | (F.col("end") - F.col("__last") < holdoff), F.lit(False))).drop("__last")


def chunk_positions_scanned(chunks: DataFrame, rate: float, size: int = SEGMENT) -> DataFrame:
    """`chunk_positions` by segments of `size` in seq."""
    df = running(running(chunks, "seq", size, "sum", F.col("frames"), "__total"), "seq", size, "sum", F.lit(1), "__n")
    out = df.withColumn("sequence", F.col("__n") - 1).withColumn("start", (F.col("__total") - F.col("frames")) / rate)
    return out.withColumn("end", F.col("__total") / rate).drop("__total", "__n")


def transitions(states: DataFrame) -> DataFrame:
    """`speech` and `silence` events where is_speaking changes; a stream begins in silence."""
    by = Window.partitionBy("stream_id").orderBy("seq")
    changed = states.withColumn("__before", F.coalesce(F.lag("is_speaking").over(by), F.lit(False))).filter("is_speaking != __before")
    return changed.withColumn("event", F.when(F.col("is_speaking"), "speech").otherwise("silence")).drop("__before")


def chunk_scores(windows: DataFrame, per_chunk: int, threshold: float) -> DataFrame:
    """The largest window score of each chunk of so many windows."""
    c = windows.groupBy("stream_id", F.floor(F.col("win") / per_chunk).alias("seq")).agg(F.coalesce(F.max("probability"), F.lit(0.0)).alias("score"))
    return c.withColumn("is_speech", F.col("score") >= threshold)


def rebatched(samples: DataFrame, frames: int, channels: int = 1) -> DataFrame:
    """Blocks of `frames` whole frames in order; the last one of a stream may be short."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    blocks = samples.groupBy("stream_id", F.floor(F.col("pos") / (frames * channels)).alias("seq")).agg(ordered.alias("__s"))
    return blocks.select("stream_id", "seq", F.transform("__s", lambda s: s["x"]).alias("data"))


def chunk_positions(chunks: DataFrame, rate: float) -> DataFrame:
    """Sequence from 0, and start and end in seconds by frames, for chunks (stream_id, seq, frames)."""
    by = Window.partitionBy("stream_id").orderBy("seq")
    total = F.sum("frames").over(by)
    return chunks.withColumn("sequence", F.row_number().over(by) - 1).withColumn("start", (total - F.col("frames")) / rate).withColumn("end", total / rate)


def overlapping_frames(samples: DataFrame, hop: int) -> DataFrame:
    """(frame, at, x): windows of two hops, each hop in two of them; the first has a hop of silence before it."""
    h = F.floor(F.col("pos") / hop)
    return samples.withColumn("frame", F.explode(F.array(h, h + 1))).withColumn("at", F.col("pos") - (F.col("frame") - 1) * hop)


def context_carried(windows: DataFrame, size: int, context: int) -> DataFrame:
    """Each window's array with the last `context` samples of the one before it in front; silence first."""
    by = Window.partitionBy("stream_id").orderBy("win")
    tail = F.lag(F.slice("data", size - context + 1, context)).over(by)
    return windows.withColumn("data", F.concat(F.coalesce(tail, F.array_repeat(F.lit(0.0), context)), "data"))


def dropped_newest(arrivals: DataFrame, capacity: int) -> DataFrame:
    """Bounded queue without a reader: of rows in order, those that find it full are dropped."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq"))
    return arrivals.withColumn("kept", rank <= capacity)


def kept_newest(arrivals: DataFrame, capacity: int) -> DataFrame:
    """Bounded ring: only the newest `capacity` rows of a stream are left."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    return arrivals.withColumn("__r", rank).filter(F.col("__r") <= capacity).drop("__r")


def taken(chunks: DataFrame, target: int | Column) -> DataFrame:
    """Chunks until `target` frames have come: at least that many, less than one chunk over."""
    by = Window.partitionBy("stream_id").orderBy("seq")
    before = F.sum("frames").over(by) - F.col("frames")
    return chunks.withColumn("__before", before).filter(F.col("__before") < F.greatest(F.lit(1), F.lit(target))).drop("__before")


def playback(pushes: DataFrame) -> DataFrame:
    """Queue of a player with rows (stream_id, ord, pushed, wanted): played, and silence filled in, per row.

    Each call plays what is queued, zeros for the rest; the queue's level follows a running minimum.
    """
    by = Window.partitionBy("stream_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum(F.col("pushed") - F.col("wanted")).over(by)
    df = pushes.withColumn("__s", s)
    low = F.least(F.lit(0), F.min("__s").over(by))
    df = df.withColumn("queued", F.col("__s") - low)
    before = F.coalesce(F.lag("queued").over(Window.partitionBy("stream_id").orderBy("ord")), F.lit(0))
    df = df.withColumn("underrun", F.greatest(F.lit(0), F.col("wanted") - before - F.col("pushed")))
    return df.withColumn("played", F.col("wanted") - F.col("underrun")).drop("__s")


def rendered(samples: DataFrame, block: int, wanted: int | None = None) -> DataFrame:
    """What a player hears: samples (stream_id, pos, x) in fixed output blocks, silence where none is left.

    wanted: blocks asked of each stream; by default as many as hold its samples. underrun counts the silence.
    """
    full = rebatched(samples, block).select("stream_id", F.col("seq").cast("long").alias("seq"), "data")
    count = F.lit(wanted) if wanted is not None else F.col("__n")
    asked = full.groupBy("stream_id").agg((F.max("seq") + 1).cast("int").alias("__n")).select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("seq"))
    out = asked.join(full, ["stream_id", "seq"], "left").withColumn("data", F.coalesce("data", F.array().cast("array<double>")))
    missing = F.lit(block) - F.size("data")
    return out.select("stream_id", "seq", F.concat("data", F.array_repeat(F.lit(0.0), missing)).alias("data"), missing.cast("long").alias("underrun"))
