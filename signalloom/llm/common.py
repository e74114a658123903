"""Shared plumbing of the training-data operators.

Everything here is bounded per task: Arrow batches are cut to a fixed number of rows and bytes, and the
kernels get texts in packs of a fixed number of characters.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Upper bounds of one Arrow batch sent to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Characters that a kernel looks at together.
PACK_CHARS = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to this module's; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def share_of_hash(column: str | Column, fraction: float | Column, seed: int) -> Column:
    """True for about `fraction` of the ids, by a hash of the id alone."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.pmod(F.xxhash64(F.lit(seed), c), F.lit(1 << 30)) / float(1 << 30)) < fraction


def add_columns(df: DataFrame, make: Callable[[], Callable[..., Sequence[pa.Array]]], inputs: Sequence[str], new: T.StructType) -> DataFrame:
    """df with the columns `new`, computed per Arrow batch by make()(*arrays of inputs).

    All columns of df pass through; one of the same name as a new column is replaced. Row-preserving and
    shuffle-free. make() runs once per task, so per-worker tables are built there.
    """
    bound_batches(df.sparkSession)
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in df.columns if c.lower() not in names]
    need = [c for c in inputs if c not in kept]
    src = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in_{c}") for c in need])
    at = [src.columns.index(c if c in kept else f"__in_{c}") for c in inputs]
    schema = T.StructType([*src.schema.fields[: len(kept)], *new.fields])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), to_arrow_schema(schema)
        for b in batches:
            cols = fn(*[b.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*(c if c.type == out.field(i).type else c.cast(out.field(i).type) for i, c in enumerate(b.columns[:n_kept])), *(c.cast(out.field(n_kept + i).type) for i, c in enumerate(cols))], schema=out)
        del fn
        release_memory()

    return src.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict | None]], schema: T.StructType) -> DataFrame:
    """Any number of rows out of each Arrow batch: make()(batch) gives a dict of columns."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), to_arrow_schema(schema)
        for b in batches:
            got = fn(b)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in out], schema=out)
        del fn
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are kept for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def packs(texts: Sequence[str], most: int = PACK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters together, or of one text."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 2
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if len(texts) > a:
        yield a, len(texts)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); h is changed."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; unset, a new one under a local master, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that its path names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def truncate_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
