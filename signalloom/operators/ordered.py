"""Ordered work on streams in bounded memory.

`in_order` sorts each stream's rows inside one partition and hands them on batch by batch, so what a task holds is a batch
and the state between batches, however long the stream. `scanned` gives up even the one task: a stream is cut into
segments by its order column; each segment is summed up on its own, the small sums are folded per stream into the
state that each segment begins with, and the segments are computed apart from those. It serves every carry whose
steps compose: linear filters (an affine map of the state), bounded queues (a shift between two limits). `running`
does the same with window functions for sums and extremes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the order column's range that make a segment.
SEGMENT = 1 << 20


def spans(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool]]]]:
    """Each batch with its runs (first row, end, whether a new key begins) of equal values of its first columns."""
    last: list | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        edge = np.zeros(n, bool)
        for c in b.columns[:keys]:
            code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edge[1:] |= code[1:] != code[:-1]
        edge[0] = last is None or last != [c[0].as_py() for c in b.columns[:keys]]
        first = np.union1d([0], np.flatnonzero(edge))
        yield b, [(int(a), int(z), bool(edge[a])) for a, z in zip(first, np.append(first[1:], n))]
        last = [c[-1].as_py() for c in b.columns[:keys]]


def in_order(df: DataFrame, keys: list[str], order: list[str | Column], run: Callable, schema: T.StructType | str) -> DataFrame:
    """run(batches) over the rows of whole keys in order; a key's rows are consecutive, and in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Carry(Protocol):
    """Steps that compose. A state and a summary are short lists of numbers."""

    def start(self) -> np.ndarray:
        """The state before the first row."""

    def summary(self, *columns: np.ndarray) -> np.ndarray:
        """What consecutive rows do to a state."""

    def composed(self, first: np.ndarray, then: np.ndarray) -> np.ndarray: ...

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray: ...

    def outputs(self, state: np.ndarray, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The new columns of consecutive rows, and the state behind them."""


def scanned(rows: DataFrame, order: str, inputs: list[str], make: Callable[[], Carry], new: list[tuple[str, T.DataType]], size: int = SEGMENT) -> DataFrame:
    """rows (stream_id, order, inputs, ...) with the columns `new` of a carry, by segments of `size` of the order column.

    No task and no group holds a stream. The rows are shuffled twice, to be summed up and to be computed; between
    these, one short row for each segment is.
    """
    keys = ["stream_id", "__seg"]
    rows = rows.withColumn("__seg", F.floor(F.col(order) / size).cast("long"))
    names = [c for c in rows.columns if c not in (*keys, order)]
    kind = rows.schema["stream_id"]
    small = T.StructType([kind, T.StructField("__seg", T.LongType()), T.StructField("__v", T.ArrayType(T.DoubleType()))])
    need = rows.select(*keys, *inputs, order)
    at = [need.columns.index(c) for c in inputs]

    def table(ids: list, segs: list, values: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(segs, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=small.names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, key, total, schema = make(), None, None, None
        for b, parts in spans(batches, 2):
            ids, segs, values, schema = [], [], [], b.schema
            for a, z, fresh in parts:
                got = carry.summary(*(b.column(i)[a:z].to_numpy(zero_copy_only=False) for i in at))
                if fresh and key is not None:
                    ids, segs, values = [*ids, key[0]], [*segs, key[1]], [*values, total.tolist()]
                total = got if fresh else carry.composed(total, got)
                key = [b.column(i)[a].as_py() for i in (0, 1)]
            yield table(ids, segs, values, schema)
        if key is not None:
            yield table([key[0]], [key[1]], [total.tolist()], schema)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, state = make(), None
        for b, parts in spans(batches):
            values, summaries = [], b.column(2).to_pylist()
            for a, z, fresh in parts:
                state = carry.start() if fresh else state
                for i in range(a, z):
                    values.append(state.tolist())
                    state = carry.after(state, np.array(summaries[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.list_(pa.float64()))], names=small.names)

    sums = in_order(need, keys, [order], summed, small)
    starts = in_order(sums, ["stream_id"], ["__seg"], folded, small)
    # the state comes before its segment's rows: null in the order column sorts first
    begin = starts.select(*keys, F.lit(None).cast(rows.schema[order].dataType).alias(order), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "__v")
    marked = rows.select(*keys, order, *names, F.lit(None).cast("array<double>").alias("__v")).unionByName(begin)
    schema = T.StructType([kind, *(rows.schema[c] for c in (order, *names)), *(T.StructField(c, t) for c, t in new)])
    places = [marked.columns.index(c) for c in ("stream_id", order, *names)]
    inner = [marked.columns.index(c) for c in inputs]
    last = len(marked.columns) - 1

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, state = make(), None
        for b, parts in spans(batches, 2):
            kept, outs = [], []
            for a, z, fresh in parts:
                if fresh:
                    state, a = np.array(b.column(last)[a].as_py()), a + 1
                if z > a:
                    got, state = carry.outputs(state, *(b.column(i)[a:z].to_numpy(zero_copy_only=False) for i in inner))
                    kept.append(np.arange(a, z))
                    outs.append(got)
            if not kept:
                continue
            rows_ = pa.array(np.concatenate(kept))
            cols = [b.column(i).take(rows_) for i in places] + [pa.array(np.concatenate(c)) for c in zip(*outs)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return in_order(marked, keys, [F.col(order).asc_nulls_first()], computed, schema)


def running(df: DataFrame, order: str, size: int, fold: str, value: Column, name: str) -> DataFrame:
    """df with `name`, the fold ("sum", "max" or "min") of value over the rows of the stream up to each one, by segments.

    Window functions over segments, and over one row for each segment of a stream.
    """
    of = {"sum": F.sum, "max": F.max, "min": F.min}[fold]
    df = df.withColumn("__seg", F.floor(F.col(order) / size).cast("long")).withColumn("__x", value)
    inner = Window.partitionBy("stream_id", "__seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("stream_id").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy("stream_id", "__seg").agg(of("__x").alias("__all"))
    whole = whole.select(F.col("stream_id").alias("__id"), F.col("__seg").alias("__at"), of("__all").over(before).alias("__before"))
    out = df.withColumn("__in", of("__x").over(inner))
    out = out.join(whole, F.col("stream_id").eqNullSafe(F.col("__id")) & (F.col("__seg") == F.col("__at"))).drop("__id", "__at")
    joined = {"sum": F.coalesce("__in", F.lit(0)) + F.coalesce("__before", F.lit(0)), "max": F.greatest("__in", "__before"), "min": F.least("__in", "__before")}[fold]
    return out.withColumn(name, joined).drop("__seg", "__x", "__in", "__before")
