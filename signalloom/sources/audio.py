"""Audio containers: WAV, AIFF / AIFF-C and FLAC to float samples, found by content and not by name.

A file is the unit of parallelism: `binaryFile` rows are decoded in Arrow batches on the executors.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, FormatError
from ..plans.config import FILE_BLOCK, RATES


def mu_law(code: np.ndarray) -> np.ndarray:
    """G.711 mu-law bytes to -1..1, from its rule: inverted bits, three of segment, four of step, bias 132."""
    c = ~code.astype(np.int32) & 0xFF
    size = ((((c & 0x0F) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 0x80, -size, size) / 32768.0


def a_law(code: np.ndarray) -> np.ndarray:
    """G.711 A-law bytes to -1..1: even bits inverted, segments above the first have a hidden bit."""
    c = code.astype(np.int32) ^ 0x55
    segment, step = (c >> 4) & 7, (c & 0x0F) << 4
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(c & 0x80, size, -size) / 32768.0


def pcm(data: bytes, bits: int, big: bool, signed8: bool = False) -> np.ndarray:
    """Integer samples of 8, 16, 24 or 32 bits to -1..1; an incomplete last sample is dropped."""
    width = bits // 8
    data = data[: len(data) // width * width]
    if bits == 8:
        return np.frombuffer(data, np.int8) / 128.0 if signed8 else (np.frombuffer(data, np.uint8).astype(float) - 128) / 128.0
    if bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3)[:, :: -1 if big else 1].astype(np.int32)
        return (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8) / 8388608.0
    if bits in (16, 32):
        return np.frombuffer(data, f"{'>' if big else '<'}i{width}") / float(1 << (bits - 1))
    raise FormatError(f"samples of {bits} bits")


def _chunks(data: bytes, at: int, big: bool):
    """(name, body) of the chunks of a RIFF or IFF file; a cut last body is given as far as it goes."""
    while at + 8 <= len(data):
        name, (size,) = data[at : at + 4], struct.unpack_from(">I" if big else "<I", data, at + 4)
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def read_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    found = dict(reversed(list(_chunks(data, 12, False))))
    if b"fmt " not in found or b"data" not in found or len(found[b"fmt "]) < 16:
        raise FormatError("a WAV file without its format or data")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if kind == 0xFFFE and len(found[b"fmt "]) >= 26:
        (kind,) = struct.unpack_from("<H", found[b"fmt "], 24)
    body = found[b"data"]
    if kind == 1:
        x = pcm(body, bits, False)
    elif kind == 3 and bits in (32, 64):
        x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(float)
    elif kind in (6, 7):
        x = (a_law if kind == 6 else mu_law)(np.frombuffer(body, np.uint8))
    else:
        raise FormatError(f"WAV samples of kind {kind}")
    return x, rate, channels


def _extended(b: bytes) -> float:
    """An 80-bit extended number, as AIFF gives its rate."""
    exponent, mantissa = struct.unpack(">HQ", b)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def read_aiff(data: bytes) -> tuple[np.ndarray, int, int]:
    found = dict(reversed(list(_chunks(data, 12, True))))
    if b"COMM" not in found or b"SSND" not in found or len(found[b"COMM"]) < 18:
        raise FormatError("an AIFF file without its format or data")
    common = found[b"COMM"]
    channels, _, bits = struct.unpack_from(">hIh", common)
    rate, kind = round(_extended(common[8:18])), common[18:22].lower() if len(common) >= 22 else b"none"
    (skip,) = struct.unpack_from(">I", found[b"SSND"])
    body = found[b"SSND"][8 + skip :]
    if kind in (b"ulaw", b"alaw"):
        x = (mu_law if kind == b"ulaw" else a_law)(np.frombuffer(body, np.uint8))
    elif kind in (b"none", b"twos", b"sowt"):
        x = pcm(body, (bits + 7) // 8 * 8, kind != b"sowt", signed8=True)
    elif kind == b"fl32":
        x = np.frombuffer(body[: len(body) // 4 * 4], ">f4").astype(float)
    else:
        raise FormatError(f"AIFF samples of kind {kind!r}")
    return x, rate, channels


class Bits:
    """Bits of a byte string, most significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        a, z = self.at // 8, (self.at + n + 7) // 8
        if z > len(self.data):
            raise FormatError("a FLAC frame is cut off")
        v = int.from_bytes(self.data[a:z]) >> (z * 8 - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while True:
            room = min(32, len(self.data) * 8 - self.at)
            if room <= 0:
                raise FormatError("a FLAC frame is cut off")
            v = self.take(room)
            if v:
                zeros = room - v.bit_length()
                self.at -= room - zeros - 1
                return n + zeros
            n += room


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # predictors: differences of order 0 to 4


def _residual(b: Bits, size: int, order: int) -> list[int]:
    method, parts = b.take(2), 1 << b.take(4)
    out: list[int] = []
    width, escape = (4, 15) if method == 0 else (5, 31)
    for i in range(parts):
        k, n = b.take(width), size // parts - (order if i == 0 else 0)
        if k == escape:
            w = b.take(5)
            out += [b.signed(w) for _ in range(n)]
        else:
            for _ in range(n):
                u = (b.unary() << k) | b.take(k)
                out.append((u >> 1) ^ -(u & 1))
    return out


def _subframe(b: Bits, size: int, bits: int) -> list[int]:
    b.take(1)
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * size
    elif kind == 1:
        x = [b.signed(bits) for _ in range(size)]
    else:
        fixed = 8 <= kind <= 12
        order = kind - 8 if fixed else kind - 31
        if not fixed and kind < 32:
            raise FormatError("a reserved FLAC subframe")
        x, shift, weights = [b.signed(bits) for _ in range(order)], 0, FIXED[order] if fixed else ()
        if not fixed:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = tuple(b.signed(precision) for _ in range(order))
        for r in _residual(b, size, order):
            x.append(r + (sum(w * v for w, v in zip(weights, reversed(x[-order:]))) >> shift if order else 0))
    return [v << wasted for v in x] if wasted else x


def read_flac(data: bytes) -> tuple[np.ndarray, int, int]:
    at, last, rate, channels, depth = 4, False, 0, 0, 0
    while not last:
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4])
        last = bool(head & 0x80)
        if head & 0x7F == 0:
            v = int.from_bytes(data[at + 14 : at + 18])
            rate, channels, depth = v >> 12, (v >> 9 & 7) + 1, (v >> 4 & 31) + 1
        at += 4 + size
    b, planes = Bits(data, at), [[] for _ in range(channels)]
    while b.at // 8 + 4 < len(data):
        if b.take(15) != 0x7FFC:
            break
        b.take(1)
        code, rate_code, layout, depth_code = b.take(4), b.take(4), b.take(4), b.take(3)
        b.take(1)
        first = b.take(8)
        b.take(8 * max(0, 8 - (first ^ 0xFF).bit_length() - 1) if first & 0x80 else 0)
        size = 192 if code == 1 else 576 << (code - 2) if code < 6 else b.take(8) + 1 if code == 6 else b.take(16) + 1 if code == 7 else 256 << (code - 8)
        b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        b.take(8)
        bits = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth_code]
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        got = [_subframe(b, size, bits + (side == c)) for c in range(layout + 1 if layout < 8 else 2)]
        if layout == 8:
            got[1] = [x - y for x, y in zip(*got)]
        elif layout == 9:
            got[0] = [x + y for x, y in zip(*got)]
        elif layout == 10:
            mid = [(m << 1) | (s & 1) for m, s in zip(*got)]
            got = [[(m + s) >> 1 for m, s in zip(mid, got[1])], [(m - s) >> 1 for m, s in zip(mid, got[1])]]
        for p, g in zip(planes, got):
            p += g
        b.at = (b.at + 7) // 8 * 8 + 16
    return np.array(planes, float).T.ravel() / (1 << (depth - 1)), rate, channels


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved samples, rate and channels, whatever the file is called."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        x, rate, channels = read_wav(data)
    elif data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        x, rate, channels = read_aiff(data)
    elif data[:4] == b"fLaC":
        x, rate, channels = read_flac(data)
    else:
        raise FormatError("no WAV, AIFF or FLAC file")
    if not RATES[0] <= rate <= RATES[1]:
        raise ConfigError(f"a rate of {rate}; it must be from {RATES[0]} to {RATES[1]}")
    return x[: len(x) // channels * channels].astype(np.float32), rate, channels


#: Bytes of a file that are looked at for its rate and channels before all of it is.
HEAD = 1 << 16


def header_of(data: bytes) -> tuple[int, int] | None:
    """Rate and channels from a file's first bytes; None if they lie further behind or it is no audio file."""
    try:
        if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
            form = next(body for name, body in _chunks(data, 12, False) if name == b"fmt ")
            channels, rate = struct.unpack_from("<HI", form, 2)
        elif data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
            common = next(body for name, body in _chunks(data, 12, True) if name == b"COMM")
            channels, rate = struct.unpack_from(">h", common)[0], round(_extended(common[8:18]))
        elif data[:4] == b"fLaC":
            v = int.from_bytes(data[18:22])
            rate, channels = v >> 12, (v >> 9 & 7) + 1
        else:
            return None
    except (StopIteration, struct.error):
        return None
    return rate, channels


def scan_headers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(stream_id, sample_rate, channels) of all audio files under a path; samples are only decoded where a header isn't
    among a file's first bytes."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    heads = files.select("path", F.substring("content", 1, HEAD).alias("head"), F.when(F.length("content") > HEAD, F.col("content")).alias("content"))

    def run(batches):
        for b in batches:
            found = []
            for i, head in enumerate(b.column(1)):
                kind = header_of(head.as_py())
                if kind is None:
                    whole = b.column(2)[i].as_py()
                    kind = decode(head.as_py() if whole is None else whole)[1:]
                found.append(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32())], names=["stream_id", "sample_rate", "channels"])

    return heads.mapInArrow(run, "stream_id string, sample_rate int, channels int")


def chunked(x: np.ndarray, channels: int, frames: int) -> list[np.ndarray]:
    return [x[i : i + frames * channels] for i in range(0, len(x), frames * channels)]


CHUNKS = "stream_id string, seq long, sample_rate int, channels int, data array<float>"


def scan_audio(spark: SparkSession, path: str, frames: int = FILE_BLOCK, glob: str | None = None) -> DataFrame:
    """Chunk rows of all audio files under a path; stream_id is the file's path."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                x, rate, channels = decode(data.as_py())
                rows = chunked(x, channels, frames)
                for a in range(0, len(rows), 256):
                    some = rows[a : a + 256]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(range(a, a + n), pa.int64()), pa.array([rate] * n, pa.int32()), pa.array([channels] * n, pa.int32()), pa.array(some, pa.list_(pa.float32()))],
                        names=["stream_id", "seq", "sample_rate", "channels", "data"],
                    )

    return files.mapInArrow(run, CHUNKS)


def buffer_source(spark: SparkSession, stream_id: str, samples, sample_rate: int, channels: int, frames: int = FILE_BLOCK) -> DataFrame:
    """Chunk rows of samples in memory; samples that don't fill their last frame are refused."""
    x = np.asarray(samples, np.float32)
    if channels < 1 or len(x) % channels:
        raise ConfigError("the samples don't fill whole frames")
    if not RATES[0] <= sample_rate <= RATES[1]:
        raise ConfigError(f"a rate of {sample_rate}")
    rows = [(stream_id, i, sample_rate, channels, c.tolist()) for i, c in enumerate(chunked(x, channels, frames))]
    return spark.createDataFrame(rows, CHUNKS)


def from_bytes(df: DataFrame, column: str, kind: str, out: str = "data") -> DataFrame:
    """Little-endian `int16` or `float32` bytes to an array of floats; incomplete last samples are dropped."""
    width, dtype = (2, "<i2") if kind == "int16" else (4, "<f4")

    @F.pandas_udf("array<float>")
    def read(s):
        return s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // width * width], dtype).astype(np.float32) / np.float32(32768 if width == 2 else 1))

    return df.withColumn(out, read(column))


def to_bytes(df: DataFrame, column: str, kind: str, out: str = "payload") -> DataFrame:
    """Floats to little-endian bytes: 16-bit codes cut towards zero, or the floats as they are."""
    from .sinks import codes16

    @F.pandas_udf("binary")
    def write(s):
        return s.map(lambda x: None if x is None else codes16(np.asarray(x, np.float32)).astype("<i2").tobytes() if kind == "int16" else np.asarray(x, "<f4").tobytes())

    return df.withColumn(out, write(column))
