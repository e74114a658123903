"""Recordings of any length as many tasks' work: byte ranges of PCM files, planned from their headers.

Spark lists the files without reading them; a task seeks through the headers of its files and gives ranges of whole blocks; each
range is then read and decoded by itself. Files are opened through pyarrow by the URI that Spark lists (file, hdfs, s3, gs, as
far as pyarrow knows it here); `audio.scan_audio` reads what only Spark can open. WAV (RF64 too) and AIFF are cut; FLAC frames
have no fixed place, so a FLAC file is one range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..plans.config import FILE_BLOCK
from .audio import CHUNKS, HEAD, _extended, chunked, decode, header_of

#: Bytes of a file that one range holds, and that one read takes.
RANGE, PIECE = 64 << 20, 4 << 20
RANGES = "path string, sample_rate int, channels int, frame int, head binary, at long, size long, seq long"


def opened(path: str):
    """A seekable file of the store that its URI names."""
    store, inner = (pa_fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:/") and not path.startswith("file://") else pa_fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def layout(f) -> tuple[int, int, int, bytes, int, int] | None:
    """(rate, channels, bytes of a frame, head, place, size) of a WAV or AIFF file's samples; None for others.

    head with samples behind it is a file that decodes to them.
    """
    start = f.read(12)
    big = start[:4] == b"FORM" and start[8:12] in (b"AIFF", b"AIFC")
    if not big and not (start[:4] in (b"RIFF", b"RF64") and start[8:12] == b"WAVE"):
        return None
    end, at, form, long_size, found = f.size(), 12, None, None, None
    while at + 8 <= end and (form is None or found is None):
        f.seek(at)
        name, size = struct.unpack(">4sI" if big else "<4sI", f.read(8))
        if name == b"ds64":
            long_size = struct.unpack("<8xQ", f.read(16))[0]
        elif name in (b"fmt ", b"COMM") and form is None:
            form = f.read(size)
        elif name in (b"data", b"SSND") and found is None:
            size = long_size if name == b"data" and size == 0xFFFFFFFF and long_size is not None else size
            skip = 8 + struct.unpack(">I", f.read(4))[0] if big else 0
            found = at + 8 + skip, min(size - skip, end - at - 8 - skip)
        at += 8 + size + size % 2
    if form is None or found is None or len(form) < (18 if big else 16):
        raise FormatError("a file without its format or data")
    if big:
        (channels,), (bits,), rate = struct.unpack_from(">h", form), struct.unpack_from(">h", form, 6), round(_extended(form[8:18]))
        kind = form[18:22].lower() if len(form) >= 22 else b"none"
        width = 1 if kind in (b"ulaw", b"alaw") else 4 if kind == b"fl32" else (bits + 7) // 8
        head = b"FORM\xff\xff\xff\xff" + start[8:12] + b"COMM" + struct.pack(">I", len(form)) + form + bytes(len(form) % 2) + b"SSND\xff\xff\xff\xff" + bytes(8)
    else:
        channels, rate, bits = struct.unpack_from("<HI", form, 2) + struct.unpack_from("<H", form, 14)
        width = bits // 8
        head = b"RIFF\xff\xff\xff\xffWAVEfmt " + struct.pack("<I", len(form)) + form + bytes(len(form) % 2) + b"data\xff\xff\xff\xff"
    if channels < 1 or width < 1:
        raise FormatError("a file of no channels or no bits")
    return rate, channels, width * channels, head, *found


def ranges(spark: SparkSession, path: str, frames: int = FILE_BLOCK, glob: str | None = None, size: int = RANGE) -> DataFrame:
    """Ranges (path, sample_rate, channels, frame, head, at, size, seq) of all audio files under a path; frame 0: the whole file."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path")  # no content is read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name in b.column(0).to_pylist():
                with opened(name) as f:
                    found = layout(f)
                    if found is None:
                        f.seek(0)
                        kind = header_of(f.read(HEAD))
                        if kind is None:
                            f.seek(0)
                            kind = decode(f.read())[1:]
                        rows.append((name, *kind, 0, b"", 0, f.size(), 0))
                        continue
                    rate, channels, frame, head, at, n = found
                    step = max(1, size // (frame * frames)) * frame * frames  # whole blocks
                    rows += [(name, rate, channels, frame, head, at + a, min(step, n - a), a // (frame * frames)) for a in range(0, n, step)]
            if rows:
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in RANGES.split(", ")])

    return files.mapInArrow(run, RANGES)


def scan_ranges(spark: SparkSession, path: str, frames: int = FILE_BLOCK, glob: str | None = None, size: int = RANGE) -> DataFrame:
    """Chunk rows as `audio.scan_audio` gives them, a task for about `size` bytes of a file."""
    reader = spark.read.format("binaryFile")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).agg(F.sum(F.ceil(F.col("length") / size))).first()[0]
    # the ranges are dealt out: they are a few bytes each, and what they stand for is not
    dealt = ranges(spark, path, frames, glob, size).repartition(max(1, int(listed or 1)), "path", "seq")

    def rows(name: str, rate: int, channels: int, x: np.ndarray, seq: int) -> Iterator[pa.RecordBatch]:
        parts = chunked(x, channels, frames)
        for a in range(0, len(parts), 256):
            some = parts[a : a + 256]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(seq + a, seq + a + n), pa.int64()), pa.array([rate] * n, pa.int32()), pa.array([channels] * n, pa.int32()), pa.array(some, pa.list_(pa.float32()))], names=["stream_id", "seq", "sample_rate", "channels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, rate, channels, frame, head, at, n, seq in zip(*(c.to_pylist() for c in b.columns)):
                with opened(name) as f:
                    f.seek(at)
                    if not frame:
                        yield from rows(name, rate, channels, decode(f.read())[0], 0)
                        continue
                    step = max(1, PIECE // (frame * frames)) * frame * frames
                    for a in range(0, n, step):
                        data = f.read(min(step, n - a))
                        yield from rows(name, rate, channels, decode(head + data)[0], seq + a // (frame * frames))

    return dealt.mapInArrow(run, CHUNKS)
