"""Words of whole Arrow string batches as numpy arrays: positions, 64-bit hashes and the distinct words.

Texts are cut into segments of bounded size between words, so memory follows the segment, not the longest
text (only a single word without any separator is kept whole).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mix64

#: Bytes looked at together.
SEGMENT = 4 << 20
SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a span that are hashed in step with other spans.
LONG = 256


def string_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 offsets; null counts as empty."""
    a = a.cast(pa.large_string()).fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def separators(values: list[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[values] = True
    return t


def distinct_spans(b: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings b[first:end] of ascending spans that don't overlap, and each span's number among them."""
    edge = np.zeros(len(b) + 1, np.int8)
    edge[first] += 1
    edge[end] -= 1
    data = b[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = spans.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def span_hashes(b: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each b[first:end]: eight bytes after the other, each mixed with all before it.

    Mixing is a bijection of eight bytes and not linear, so no two different spans of up to eight bytes have equal
    hashes, and longer ones only by chance, whatever pattern they repeat. Spans over LONG bytes go through blake2b.
    """
    size = end - first
    h = mix64(size.astype(np.uint64) + SEED)
    eight = np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    at, left = np.flatnonzero(size <= LONG), size[size <= LONG]
    start = first[at]
    while len(at):
        short = left < 8
        block = eight[start]
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[at] = mix64((h[at] ^ block) + SEED)
        more = left > 8
        at, start, left = at[more], start[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[first[i] : end[i]].tobytes(), digest_size=8).digest())
    return h


@dataclass
class Segment:
    b: np.ndarray  # its bytes
    first: np.ndarray  # of each word, within b
    end: np.ndarray
    doc: np.ndarray  # row of each word, ascending

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words and each word's number among them."""
        return distinct_spans(self.b, self.first, self.end)


def segments(b: np.ndarray, offsets: np.ndarray, separator: np.ndarray, most: int = SEGMENT) -> Iterator[Segment]:
    """The words (runs of bytes that are no separators) of texts, segment by segment."""
    a, n = 0, len(b)
    while a < n:
        z = min(n, a + most)
        while z < n:  # the last separator before z, or the next one after it
            k = np.flatnonzero(separator[b[a:z]]) if z - a <= most else np.zeros(0, np.int64)
            at = offsets[np.searchsorted(offsets, z, "right") - 1]
            if len(k) or at > a:
                z = max(int(at), a + int(k[-1]) + 1 if len(k) else 0)
                break
            k = np.flatnonzero(separator[b[z : z + most]])
            stop = int(offsets[np.searchsorted(offsets, z, "right")])
            z = min(stop, z + int(k[0]) + 1 if len(k) else z + most)
            if len(k) or z == stop:
                break
        x = b[a:z]
        inside = ~separator[x]
        border = offsets[(offsets > a) & (offsets < z)] - a  # where a text begins inside the segment
        before = np.concatenate([[False], inside[:-1]])
        before[border] = False
        after = np.concatenate([inside[1:], [False]])
        after[border - 1] = False
        first = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        yield Segment(x, first, end, np.searchsorted(offsets, a + first, "right") - 1)
        a = z


def spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of flat (parts of given sizes, one after the other) chosen by `which`, and the ends of each."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)], ends
