"""Saving streams as 16-bit WAV, AIFF or FLAC: repair, clamp, encode, write, report.

A stream is one object, written by one task chunk by chunk: its length is counted beforehand, since it belongs into the
header, so no task holds more than a batch of chunks. The store is the one that the folder's URI names (file, s3, gs, hdfs, as
far as pyarrow knows it here); a path without a scheme is for local masters. The driver only sees the report rows.

`recorded` writes live blocks: each micro-batch appends a part per stream, and the row that closes a stream puts its parts
together. Names of parts follow the batch's number, so a batch that is seen again writes the same parts again.
"""

from __future__ import annotations

import struct
import uuid

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, FormatError
from ..operators.ordered import in_order, spans

# The most channels each container takes.
MOST_CHANNELS = {"wav": 32767, "aiff": 32767, "flac": 8}
EXTENSIONS = {"wav": "wav", "wave": "wav", "aif": "aiff", "aiff": "aiff", "aifc": "aiff", "flac": "flac"}


def format_of(path: str, wanted: str | None = None) -> str:
    """The container: an explicit one wins, else the extension, whatever its case."""
    kind = wanted or EXTENSIONS.get(path.rpartition(".")[2].lower() if "." in path else "")
    if kind not in MOST_CHANNELS:
        raise FormatError(f"no container for {path!r}")
    return kind


def repaired(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Samples without NaN and infinities, held to -1..1; how many were clamped and how many repaired."""
    bad = ~np.isfinite(x)
    y = np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=-1.0)
    return np.clip(y, -1, 1), int((np.abs(y) > 1).sum()), int(bad.sum())


def codes16(x: np.ndarray) -> np.ndarray:
    """Scaled by 32768, cut towards zero, 32767 at most; NaN is 0."""
    return np.minimum(np.trunc(np.clip(np.nan_to_num(x.astype(np.float64), nan=0.0), -1, 1) * 32768), 32767).astype(np.int16)


def wav_header(samples: int, rate: int, channels: int) -> bytes:
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + 2 * samples) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", 2 * samples)


def aiff_header(samples: int, rate: int, channels: int) -> bytes:
    top = rate.bit_length() - 1
    common = struct.pack(">hIh", channels, samples // channels, 16) + struct.pack(">HQ", 16383 + top, rate << (63 - top))
    size = 8 + 2 * samples
    return b"FORM" + struct.pack(">I", 4 + 8 + len(common) + 8 + size) + b"AIFF" + b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">III", size, 0, 0)


def _crc(data: bytes, width: int, poly: int) -> int:
    crc, top, mask = 0, 1 << (width - 1), (1 << width) - 1
    for byte in data:
        crc ^= byte << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
    return crc


class _Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value, self.n = (self.value << n) | (v & ((1 << n) - 1)), self.n + n

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8)


def _rice(w: _Writer, residual: list[int]) -> None:
    """One partition: the parameter from the mean magnitude, then zigzag codes."""
    folded = [(r << 1) ^ (r >> 63) for r in residual]
    k = min(14, max(0, int(np.log2(max(1.0, float(np.mean(folded)) if folded else 1.0)))))
    w.put(0, 6)
    w.put(k, 4)
    for u in folded:
        w.put(1, (u >> k) + 1)
        w.put(u, k)


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    return bytes([(0xFF00 >> (more + 1)) & 0xFF | n >> (6 * more), *(0x80 | n >> (6 * i) & 0x3F for i in range(more - 1, -1, -1))])


FLAC_BLOCK = 4096


def flac_header(frames: int, rate: int, channels: int) -> bytes:
    info = struct.pack(">HH", FLAC_BLOCK, FLAC_BLOCK) + bytes(6) + ((rate << 44) | ((channels - 1) << 41) | (15 << 36) | frames).to_bytes(8) + bytes(16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3) + info


def flac_frame(part: np.ndarray, number: int) -> bytes:
    """A frame of fixed predictors of order 0 to 4 (the smallest residual wins), verbatim where they don't pay; part: n x channels."""
    n, channels = part.shape
    head = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | 0x08]) + _number(number) + struct.pack(">H", n - 1)
    head += bytes([_crc(head, 8, 0x07)])
    subframes = _Writer()
    for c in range(channels):
        best = min(range(min(5, n)), key=lambda o: int(np.abs(np.diff(part[:, c], o)).sum()))
        rest = np.diff(part[:, c], best)
        if int(np.abs(rest).sum()) > 2000 * n:
            subframes.put(1 << 1, 8)
            for v in part[:, c].tolist():
                subframes.put(v, 16)
        else:
            subframes.put((8 + best) << 1, 8)
            for v in part[:best, c].tolist():
                subframes.put(v, 16)
            _rice(subframes, rest.tolist())
    frame = head + subframes.bytes()
    return frame + _crc(frame, 16, 0x8005).to_bytes(2)


class Encoder:
    """The bytes of one file, piece by piece; `samples` come in all."""

    def __init__(self, kind: str, samples: int, rate: int, channels: int):
        if channels > MOST_CHANNELS[kind]:
            raise FormatError(f"{kind} takes {MOST_CHANNELS[kind]} channels at most")
        if kind != "flac" and 2 * samples >= (1 << 32) - 64:
            raise FormatError(f"{kind} holds 4 GB at most; save as flac")
        self.kind, self.channels, self.number, self.left = kind, channels, 0, np.zeros((0, channels), np.int64)
        self.head = {"wav": wav_header, "aiff": aiff_header}[kind](samples, rate, channels) if kind != "flac" else flac_header(samples // channels, rate, channels)

    def encode(self, codes: np.ndarray, end: bool = False) -> bytes:
        head, self.head = self.head, b""
        if self.kind != "flac":
            return head + codes.astype("<i2" if self.kind == "wav" else ">i2").tobytes()
        x = np.concatenate([self.left, codes.reshape(-1, self.channels).astype(np.int64)])
        whole = len(x) if end else len(x) // FLAC_BLOCK * FLAC_BLOCK
        out = [head]
        for a in range(0, whole, FLAC_BLOCK):
            out.append(flac_frame(x[a : min(whole, a + FLAC_BLOCK)], self.number))
            self.number += 1
        self.left = x[whole:]
        return b"".join(out)


def wav(codes: np.ndarray, rate: int, channels: int) -> bytes:
    return Encoder("wav", len(codes), rate, channels).encode(codes, True)


def aiff(codes: np.ndarray, rate: int, channels: int) -> bytes:
    return Encoder("aiff", len(codes), rate, channels).encode(codes, True)


def flac(codes: np.ndarray, rate: int, channels: int) -> bytes:
    return Encoder("flac", len(codes), rate, channels).encode(codes, True)


def encode(x: np.ndarray, rate: int, channels: int, kind: str) -> bytes:
    return Encoder(kind, len(x), rate, channels).encode(codes16(x), True)


def store_of(folder: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system that a folder's URI names, and the folder in it."""
    return pa_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa_fs.LocalFileSystem(), folder)


def shared(df: DataFrame, folder: str) -> str:
    """folder, unless it has no scheme and the master isn't local: then it would be a folder of each executor."""
    if "://" not in folder and not folder.startswith("file:") and not df.sparkSession.sparkContext.master.startswith("local"):
        raise ConfigError("name a shared store by its URI")
    return folder.rstrip("/")


class _File:
    """A file that takes its name when it is whole."""

    def __init__(self, folder: str, name: str):
        (self.store, root), self.path = store_of(folder), f"{folder}/{name}"
        self.store.create_dir(root, recursive=True)
        self.final, self.part = f"{root}/{name}", f"{root}/{name}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.part)

    def close(self) -> str:
        self.out.close()
        self.store.move(self.part, self.final)
        return self.path


def save_streams(chunks: DataFrame, folder: str, kind: str = "wav") -> DataFrame:
    """One file per stream in a shared folder or store; rows (stream_id, path, clipped_samples, non_finite_samples).

    The name is the number of the stream's hash, so a retried task writes the same file again.
    """
    format_of("x." + kind)
    folder = shared(chunks, folder)
    src = chunks.select("stream_id", F.sha1(F.col("stream_id").cast("string")).alias("file"), "sample_rate", "channels", F.col("data").cast("array<float>").alias("data"), F.lit(None).cast("long").alias("total"), "seq")
    # a stream's length comes before its chunks: null sorts first
    lengths = src.groupBy("stream_id").agg(F.sum(F.greatest(F.size("data"), F.lit(0))).cast("long").alias("total"))
    first = lengths.select("stream_id", *[F.lit(None).cast(src.schema[c].dataType).alias(c) for c in ("file", "sample_rate", "channels", "data")], "total", F.lit(None).cast(src.schema["seq"].dataType).alias("seq"))
    schema = T.StructType([src.schema["stream_id"], T.StructField("path", T.StringType()), T.StructField("clipped_samples", T.LongType()), T.StructField("non_finite_samples", T.LongType())])

    def run(batches):
        file = encoder = None
        who = total = kind_id = None
        clipped = bad = 0

        def finished() -> list[tuple]:
            if file is None:
                return []
            file.out.write(encoder.encode(np.zeros(0, np.int16), True))
            return [(who, file.close(), clipped, bad)]

        def report(rows: list[tuple]) -> pa.RecordBatch:
            types = (kind_id, pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=schema.names)

        for b, parts in spans(batches):
            rows, kind_id = [], b.schema.field(0).type
            for a, z, fresh in parts:
                if fresh:
                    rows += finished()
                    file, clipped, bad, who, total, a = None, 0, 0, b.column(0)[a].as_py(), b.column(5)[a].as_py(), a + 1
                for i in range(a, z):
                    if file is None:
                        file = _File(folder, f"{b.column(1)[i].as_py()}.{kind}")
                        encoder = Encoder(kind, total, b.column(2)[i].as_py(), b.column(3)[i].as_py())
                    data = b.column(4)[i].values
                    x, c, n = repaired(data.to_numpy(zero_copy_only=False) if data is not None else np.zeros(0, np.float32))
                    clipped, bad = clipped + c, bad + n
                    file.out.write(encoder.encode(codes16(x)))
            if rows:
                yield report(rows)
        if rows := finished():
            yield report(rows)

    return in_order(src.unionByName(first), ["stream_id"], [F.col("seq").asc_nulls_first()], run, schema)


def recorded(folder: str, kind: str = "wav") -> Callable[[DataFrame, int], None]:
    """A sink for the micro-batches of streaming.live.folded: one file per stream, once its closing row has come.

    Until then a stream is a folder of parts, one a batch. A batch that is seen again replaces its parts; a file that is whole
    stays as it is, so there is one recording for each stream id.
    """
    format_of("x." + kind)

    def sink(df: DataFrame, batch: int) -> None:
        where = shared(df, folder)
        src = df.filter("data IS NOT NULL").select("stream_id", F.sha1(F.col("stream_id").cast("string")).alias("file"), "sample_rate", "channels", "data", "closed", "seq")

        def run(batches):
            part = end = None
            name = width = ""

            def done() -> None:
                if part is not None:
                    part.close()
                if end:
                    assembled(where, name, kind)

            for b, parts in spans(batches):
                for a, z, fresh in parts:
                    if fresh:
                        done()
                        part, end, name = None, False, b.column(1)[a].as_py()
                    for i in range(a, z):
                        x = b.column(4)[i].values.to_numpy(zero_copy_only=False)
                        end = end or bool(b.column(5)[i].as_py())
                        if len(x):
                            width = f"{b.column(2)[i].as_py()}-{b.column(3)[i].as_py()}"
                            part = part or _File(f"{where}/_parts/{name}", f"{batch:012d}-{width}.pcm")
                            part.out.write(codes16(repaired(x)[0]).astype("<i2").tobytes())
            done()
            yield from ()

        in_order(src, ["stream_id"], ["seq"], run, T.StructType([T.StructField("none", T.LongType())])).write.format("noop").mode("overwrite").save()

    return sink


def assembled(folder: str, name: str, kind: str, piece: int = 1 << 20) -> None:
    """The parts of a stream as one file, a piece at a time; the parts go once the file has its name."""
    store, root = store_of(folder)
    found = store.get_file_info(pa_fs.FileSelector(f"{root}/_parts/{name}", allow_not_found=True))
    found = sorted((f for f in found if f.base_name.endswith(".pcm")), key=lambda f: f.base_name)
    if found and store.get_file_info(f"{root}/{name}.{kind}").type == pa_fs.FileType.NotFound:
        rate, channels = map(int, found[0].base_name[:-4].split("-")[1:])
        encoder, file = Encoder(kind, sum(f.size for f in found) // 2, rate, channels), _File(folder, f"{name}.{kind}")
        for f in found:
            with store.open_input_stream(f.path) as part:
                while data := part.read(piece * 2 * channels):
                    file.out.write(encoder.encode(np.frombuffer(data, "<i2")))
        file.out.write(encoder.encode(np.zeros(0, np.int16), True))
        file.close()
    if found:
        store.delete_dir(f"{root}/_parts/{name}")
