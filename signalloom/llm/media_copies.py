"""Copies of images, cropped, resized, turned or edited, by local descriptors.

Corners (Harris response, local maxima, as many as the area asks for) are taken on the image and on smaller ones of it, in
steps of scale; each gets the direction of its intensity centroid, and a row of binary tests in a pattern turned to
that direction. Images of equal corners and descriptors are one from then on. The descriptor is cut into TABLES
parts; an equal part is a vote for the turn and the step of scale between its two corners. Every pair of images with enough
votes (`needed`) that agree within a window of turns and steps is a candidate: images are dealt into blocks of about
BLOCK, and each pair of blocks is one task, which holds their descriptors. It first pairs each image with the smallest
one of every part's bucket; then all pairs with enough votes that the links so far leave in different components, so
only these are enumerated. A task of two blocks leaves the pairs inside each to the block's own task, but for leaders of
crowds, whose links spare it pairs across. Candidates are verified: corners are matched by Hamming distance, and a similarity (shift,
turn, scale) must hold for MIN_INLIERS of the matches and MIN_PART of them. Only links that join two components leave
the task, fewer than its images; they are united into classes.

The driver's tables hold no media, so op2 renders the column itself: each embedding becomes a grey image, a
fixed random field per component weighted by its value, and every twentieth id gets a second, edited image:
cropped, brightened, with noise.

Edge cases: a null or unreadable image, a flat one or one smaller than a test pattern has no corners and is a
class of its own. Equal images with a corner are one class. Repeated ids are one node.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, release_memory, table, truncate_lineage
from .components import connected_components

#: Steps of scale, each by STEP, down to images that just hold a pattern; pixels a corner, at least LEAST corners.
STEP, PIXELS, LEAST = 2 ** (-1 / 3), 150, 20
BITS, TABLES = 192, 8
RADIUS, TURNS = 8, 72
#: Bytes of a corner: x, y, scale and turn as floats, then the descriptor.
CORNER = 16 + BITS // 8
#: Equal parts of a candidate that agree: VOTES, and one more for CHANCE pairs of corners, which smooth images share by chance.
VOTES, CHANCE, COPY = 4, 16_384, 32
#: Turns that agree: a window of WINDOW, one begins at every half of it. Steps of scale agree with one neighbour.
WINDOW, STEPS = 6, 64
NEAR_BITS, MIN_INLIERS, MIN_PART, REACH = 36, 6, 0.5, 2.5
#: Images a block, votes that a task counts together, and cells of their first count, few enough for a processor's cache.
BLOCK, CHUNK, CELLS = 10_240, 1 << 17, 1 << 19
#: An odd number that spreads pairs over cells; images of its own block that a leader must have for a pair of blocks to verify them.
SPREAD, CROWD = 0x9E3779B97F4A7, 16
SEED = 97
QUERY_EVERY = 20
FEATURES = T.StructType([T.StructField("n_corners", T.IntegerType()), T.StructField("data", T.BinaryType())])

_rng = np.random.default_rng(SEED)
_disc = np.array([(x, y) for x in range(-6, 7) for y in range(-6, 7) if x * x + y * y <= 36])
_tests = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)


def _turned() -> np.ndarray:
    """The test pattern at each direction: TURNS x BITS x 2 points x (x, y), whole pixels."""
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(a), -np.sin(a)], 1), np.stack([np.sin(a), np.cos(a)], 1)], 1)
    return np.rint(np.einsum("tij,bpj->tbpi", turn, _tests)).astype(np.int64)


PATTERN = _turned()


# ---- images ------------------------------------------------------------------------------------------------


def grey_bytes(x: np.ndarray) -> bytes:
    """A grey image as binary PGM."""
    return f"P5 {x.shape[1]} {x.shape[0]} 255\n".encode() + x.astype(np.uint8).tobytes()


HEADER = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d{1,6})\s+(\d{1,6})\s+255\s")


def read_grey(data: bytes | None) -> np.ndarray | None:
    """Luminance of a binary PGM or PPM of 8 bits; None for anything else."""
    m = HEADER.match(data or b"")
    if not m:
        return None
    w, h, planes = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
    x = np.frombuffer(data, np.uint8, offset=m.end())
    if not w * h or len(x) < w * h * planes:
        return None
    x = x[: w * h * planes].reshape(h, w, planes).astype(np.float32)
    return x[..., 0] if planes == 1 else x @ np.array([0.299, 0.587, 0.114], np.float32)


# ---- descriptors -------------------------------------------------------------------------------------------


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)^2 pixels of a stack of images, edges repeated."""
    p = np.pad(x, ((0, 0), (r, r), (r, r)), mode="edge")
    rows = sum(p[:, i : i + x.shape[1]] for i in range(2 * r + 1))
    return sum(rows[:, :, i : i + x.shape[2]] for i in range(2 * r + 1)) / (2 * r + 1) ** 2


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image number, y and x of the strongest corners of each image of a stack, one for PIXELS pixels that can hold one."""
    gy, gx = np.gradient(x, axis=1), np.gradient(x, axis=2)
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    peak = r > 1.0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                peak[:, 1:-1, 1:-1] &= r[:, 1:-1, 1:-1] >= r[:, 1 + dy : r.shape[1] - 1 + dy, 1 + dx : r.shape[2] - 1 + dx]
    peak[:, :RADIUS] = peak[:, -RADIUS:] = False
    peak[:, :, :RADIUS] = peak[:, :, -RADIUS:] = False
    i, y, xx = np.nonzero(peak)
    order = np.lexsort((xx, y, -r[i, y, xx], i))
    i, y, xx = i[order], y[order], xx[order]
    first = np.searchsorted(i, np.arange(len(x)))
    most = max(LEAST, (x.shape[1] - 2 * RADIUS) * (x.shape[2] - 2 * RADIUS) // PIXELS)
    keep = np.arange(len(i)) - first[i] < most
    return i[keep], y[keep], xx[keep]


def _shrinking(n: int, m: int) -> np.ndarray:
    """m x n: each new pixel the mean of the old ones under a triangle of its width."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - at[:, None]) / max(1.0, n / m))
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For images of one size: image number, place (x, y, scale, turn), descriptor bytes of each corner."""
    number, place, bits = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.float32)], [np.zeros((0, BITS // 8), np.uint8)]
    h, w, level = *stack.shape[1:], 0
    while True:
        m, n = round(h * STEP**level), round(w * STEP**level)
        if min(m, n) <= 2 * RADIUS + 2:
            break
        x = stack if not level else np.einsum("ij,njk,lk->nil", _shrinking(h, m), stack, _shrinking(w, n), optimize=True)
        s = _box(x, 1)
        i, cy, cx = _corners(s)
        around = s[i[:, None], cy[:, None] + _disc[:, 1], cx[:, None] + _disc[:, 0]]
        angle = np.arctan2((around * _disc[:, 1]).sum(1), (around * _disc[:, 0]).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        p = PATTERN[turn]
        v = s[i[:, None, None], cy[:, None, None] + p[..., 1], cx[:, None, None] + p[..., 0]]
        number.append(i)
        place.append(np.stack([(cx + 0.5) * w / n, (cy + 0.5) * h / m, np.full(len(i), w / n), turn], 1).astype(np.float32))
        bits.append(np.packbits(v[..., 0] < v[..., 1], axis=1))
        level += 1
    return np.concatenate(number), np.concatenate(place), np.concatenate(bits)


def part_keys(bits: np.ndarray) -> np.ndarray:
    """The parts of descriptors (rows of bytes) as numbers, the table above the part's bits."""
    parts = bits.reshape(-1, TABLES, BITS // 8 // TABLES).astype(np.int32)
    return sum(parts[..., i] << (8 * (parts.shape[2] - 1 - i)) for i in range(parts.shape[2])) | (np.arange(TABLES, dtype=np.int32) << (8 * parts.shape[2]))


def poses(place: np.ndarray) -> np.ndarray:
    """Step of scale and turn of each corner as one number."""
    step = np.rint(np.log(place[:, 2]) / -np.log(STEP)).astype(np.int16)
    return step * np.int16(TURNS) + place[:, 3].astype(np.int16)


def features_of(images: list[bytes | None]) -> dict:
    read = [read_grey(d) for d in images]
    shapes: dict[tuple, list[int]] = {}
    for i, x in enumerate(read):
        if x is not None:
            shapes.setdefault(x.shape, []).append(i)
    n, data = np.zeros(len(images), np.int32), [b""] * len(images)
    for shape, at in shapes.items():
        step = max(1, (1 << 20) // (shape[0] * shape[1]))  # about a million pixels together
        for a in range(0, len(at), step):
            some = at[a : a + step]
            number, place, bits = describe(np.stack([read[i] for i in some]))
            for k, i in enumerate(some):
                mine = number == k
                n[i] = mine.sum()
                data[i] = place[mine].tobytes() + bits[mine].tobytes()
    return {"n_corners": n, "data": pa.array(data, pa.binary())}


# ---- geometric consensus -----------------------------------------------------------------------------------

def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // CORNER
    return np.frombuffer(data, np.float32, 4 * n).reshape(n, 4), np.frombuffer(data, np.uint8, offset=16 * n).reshape(n, -1)


#: Bounds of one comparison: distances made together, similarities that are tried, and those that are tried first.
TOGETHER, SIMILARITIES, FIRST = 1 << 22, 2048, 64


def nearest_bits(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of da the nearest row of db (the first of equals) and the bits between them; for each row of db the nearest
    of da. In slices, so memory doesn't grow with both."""
    a, b = (np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64) for x in (np.ascontiguousarray(da), np.ascontiguousarray(db)))
    j, bits = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    back, low = np.zeros(len(b), np.int64), np.full(len(b), 1 << 30)
    step = max(1, TOGETHER // len(b))
    for at in range(0, len(a), step):
        d = sum(np.bitwise_count(x[:, None] ^ y[None]).astype(np.int16) for x, y in zip(a[at : at + step].T, b.T))
        j[at : at + step] = best = d.argmin(1)
        bits[at : at + step] = d[np.arange(len(d)), best]
        up = d.argmin(0)
        least = d[up, np.arange(len(b))]
        closer = least < low
        back[closer], low[closer] = at + up[closer], least[closer]
    return j, bits, back


def inliers(a: bytes, b: bytes, decide: bool = False) -> tuple[int, int]:
    """How many matched corners agree on one similarity, and how many matches there are; to decide, as soon as they are a copy's.

    Two matches make a similarity. All pairs of matches are tried where they are SIMILARITIES at most, otherwise so many,
    drawn alike each time: of a true copy's matches more than MIN_PART are right, so about one pair in four or more is.
    """
    (pa_, da), (pb, db) = _unpack(a), _unpack(b)
    if not len(pa_) or not len(pb):
        return 0, 0
    j, bits, back = nearest_bits(da, db)
    i = np.flatnonzero((bits <= NEAR_BITS) & (back[j] == np.arange(len(da))))
    n = len(i)
    if n < 2:
        return n, n
    p, q = (x[:, 0] + 1j * x[:, 1] for x in (pa_[i], pb[j[i]]))
    if n * (n - 1) // 2 <= 16 * SIMILARITIES:
        u, v = np.triu_indices(n, 1)
    else:
        draw = np.random.default_rng(n)
        u, v = draw.integers(0, n, 16 * SIMILARITIES), draw.integers(0, n, 16 * SIMILARITIES)
    far = np.abs(p[u] - p[v]) > 4
    u, v = u[far], v[far]
    if not len(u):
        return 1, n
    turn = (q[u] - q[v]) / (p[u] - p[v])
    ok = (np.abs(turn) > 0.4) & (np.abs(turn) < 2.5)
    u, turn = u[ok], turn[ok]
    if not len(u):
        return 1, n
    if n * (n - 1) // 2 > 16 * SIMILARITIES:
        u, turn = u[:SIMILARITIES], turn[:SIMILARITIES]
    best, at, step = 0, 0, min(FIRST, max(1, TOGETHER // n)) if decide else max(1, TOGETHER // n)
    while at < len(u) and not (decide and enough_agree(best, n)):
        t, w = turn[at : at + step, None], u[at : at + step]
        best = max(best, int((np.abs(t * (p - p[w][:, None]) + q[w][:, None] - q) <= REACH).sum(1).max()))
        at, step = at + step, max(1, TOGETHER // n)
    return best, n


def enough_agree(good: int, matched: int) -> bool:
    return good >= MIN_INLIERS and good >= MIN_PART * matched


def is_copy(a: bytes, b: bytes) -> bool:
    return a == b or enough_agree(*inliers(a, b, decide=True))


def _sorted(keys: np.ndarray, at: np.ndarray, pose: np.ndarray, images: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image number, part and pose, each once, by part, image and pose: sorted as one number of at most 63 bits."""
    wide = 16 + images.bit_length()
    x = keys.astype(np.int64) << wide
    x |= at.astype(np.int64) << 16
    x |= pose
    x.sort()
    x = x[_changed(x)]
    return (x >> 16 & (1 << wide - 16) - 1).astype(np.int32), (x >> wide).astype(np.int32), (x & 0xFFFF).astype(np.int16)


def _joined(rows: list[tuple]) -> list[np.ndarray]:
    """The columns of rows of arrays, end to end; rows and each column's pieces are given up on the way."""
    columns = [list(c) for c in zip(*rows)]
    rows.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _parts(data: list[bytes]) -> list[np.ndarray]:
    """Image number, part and pose of every part that several images or poses have, by part and then image."""
    read = [_unpack(x) for x in data]
    keys = part_keys(np.concatenate([bits for _, bits in read]))
    pose = poses(np.concatenate([place for place, _ in read]))
    at = np.repeat(np.arange(len(data), dtype=np.int32), [len(bits) for _, bits in read])
    out = []
    for t in range(TABLES):  # the table is a part's highest bits
        a, k, p = _sorted(keys[:, t], at, pose, len(data))
        new = _changed(k)
        shared = ~(new & np.append(new[1:], True))
        out.append((a[shared], k[shared], p[shared]))
    return _joined(out)


def needed(corners_a, corners_b):
    """Equal parts, agreeing on a turn and a step of scale, that make two images with so many corners a candidate.

    What chance gives grows as the product of both counts, what a copy gives as the smaller one, so the latter bounds it: from
    some 2,000 corners on (images of about 400 x 400), unrelated images are candidates too, and verification alone parts them.
    """
    return VOTES + np.minimum(corners_a * corners_b // CHANCE, np.minimum(corners_a, corners_b) // COPY)


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place of a run-start mask, the start of its run."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _stable(x: np.ndarray) -> np.ndarray:
    """The stable order of small numbers, sorted as one number with their places."""
    k = x.astype(np.int64) << 32
    k |= np.arange(len(x))
    k.sort()
    k &= 0xFFFFFFFF
    return k.astype(np.int32)


def _changed(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def crowded(cell: np.ndarray) -> np.ndarray:
    """The places whose cell at least VOTES of them have; equal things have one cell, so none with VOTES is left out."""
    cell = cell & (CELLS - 1)
    return np.flatnonzero((np.bincount(cell, minlength=CELLS) >= VOTES)[cell])


def agreeing(pairs: np.ndarray, keys: np.ndarray, pose_a: np.ndarray, pose_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once and the most of its distinct equal parts that agree on a turn and a step of scale, most first.

    One row is one equal part of a pair. Only pairs with VOTES of them at least are given.
    """
    pose_a, pose_b = pose_a.astype(np.int64), pose_b.astype(np.int64)
    half, spans = WINDOW // 2, TURNS * 2 // WINDOW
    turn = (pose_a % TURNS - pose_b % TURNS) % TURNS // half
    step = pose_a // TURNS - pose_b // TURNS + STEPS
    bins = np.concatenate([(turn - t) % spans * (2 * STEPS) + step - z for t in (0, 1) for z in (0, 1)])
    pairs, keys = np.tile(pairs, 4), np.tile(keys, 4)
    some = crowded((pairs * SPREAD ^ bins * (SPREAD >> 20)) >> 20)
    pairs, keys, bins = pairs[some], keys[some], bins[some]
    order = np.lexsort((keys, bins, pairs))
    pairs, keys, bins = pairs[order], keys[order], bins[order]
    bin_ = _changed(pairs) | _changed(bins)
    once = bin_ | _changed(keys)
    pairs, bin_ = pairs[once], bin_[once]
    starts = np.flatnonzero(bin_)
    votes, pairs = np.diff(np.append(starts, len(pairs))), pairs[starts]
    pair = np.flatnonzero(_changed(pairs))
    votes, pairs = np.maximum.reduceat(votes, pair) if len(pair) else votes, pairs[pair]
    order = np.argsort(-votes, kind="stable")
    order = order[votes[order] >= VOTES]
    return pairs[order], votes[order]


def _voting(image: np.ndarray, by: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, keys: np.ndarray, pose: np.ndarray, width: int):
    """Pairs (image * width + other image) and their votes, where row i is image[i], by its part by[i], beside the n[i] parts from first[i] on.

    Rows of an image are consecutive, and counted in one chunk. What is kept of a vote is looked up for crowded cells only.
    """
    if not len(image):
        return
    cut = np.flatnonzero(_changed(image))
    group = np.flatnonzero(_changed(np.add.reduceat(n, cut, dtype=np.int64).cumsum() // CHUNK))
    base = (image.astype(np.int64) * width & (CELLS - 1)).astype(np.int32)
    for x, z in zip(cut[group], np.append(cut[group[1:]], len(image))):
        end = np.cumsum(n[x:z], dtype=np.int64)
        to = np.arange(end[-1], dtype=np.int32) + np.repeat((first[x:z] - (end - n[x:z])).astype(np.int32), n[x:z])
        some = crowded(np.repeat(base[x:z], n[x:z]) + at[to])
        if len(some):
            row, to = x + np.searchsorted(end, some, "right"), to[some]
            yield agreeing(image[row].astype(np.int64) * width + at[to], keys[by[row]], pose[by[row]], pose[to])


def _voted(parts: list[np.ndarray], comp: np.ndarray, side: np.ndarray | None, corners: np.ndarray):
    """All pairs (a, b) of images of different components, with sides of different ones too, with the votes they need, most
    votes first in each chunk. parts is emptied.

    Images are ranked by side, then by component. In a bucket an image meets what stands before it: with sides the ones of
    the first side, but for its component's; without them what is before its component.
    """
    at, keys, pose = parts
    parts.clear()
    size = np.bincount(comp, minlength=len(comp))[comp]
    order = np.lexsort((comp, -size) if side is None else (comp, -size, side))  # without sides the largest component enumerates nothing
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    comp = comp[order]
    then = None if side is None else side[order] != side[order[0]]  # of the second side
    if then is not None:
        both = np.isin(comp, comp[then]) & np.isin(comp, comp[~then])
        number = np.unique(np.stack([-size[order], comp]), axis=1, return_inverse=True)[1].ravel()  # components as they are ranked
    width = 8 * (BITS // 8 // TABLES)
    tables, done, out, met = np.searchsorted(keys, np.arange(TABLES + 1) << width), 0, [], []
    for x, z in zip(tables[:-1], tables[1:]):
        a, k, p = _sorted(keys[x:z], rank[at[x:z]], pose[x:z], len(order))
        bucket = _changed(k)
        first = _starts(bucket)
        if then is None:
            end = _starts(bucket | _changed(comp[a]))
            spans = [(np.arange(len(a)), first, end)]
        else:
            late = then[a]
            mid = first + np.add.reduceat(~late, np.flatnonzero(bucket), dtype=np.int64)[np.cumsum(bucket) - 1] if len(a) else first
            one, two = np.flatnonzero(late & ~both[a]), np.flatnonzero(late & both[a])
            early = np.flatnonzero(~late)
            code = lambda i: k[i].astype(np.int64) << 32 | number[a[i]]
            have, mine = code(early), code(two)
            own = [first[two] + np.searchsorted(have, mine, s) - np.searchsorted(have, mine >> 32 << 32) for s in ("left", "right")]
            spans = [(one, first[one], mid[one]), (two, first[two], own[0]), (two, own[1], mid[two])]
        for i, start, end in spans:
            some = np.flatnonzero(end > start)
            i, start, end = i[some], start[some], end[some]
            met.append((a[i], (i + done).astype(np.int32), (start + done).astype(np.int32), (end - start).astype(np.int32)))
        out.append((a, k, p))
        done += len(a)
    del a, k, p, bucket
    at, keys, pose = _joined(out)
    image, by, first, n = _joined(met)
    mine = _stable(image)
    for pairs, votes in _voting(image[mine], by[mine], first[mine], n[mine], at, keys, pose, len(order)):
        a, b = order[pairs // len(order)], order[pairs % len(order)]
        enough = votes >= needed(corners[a], corners[b])
        a, b = a[enough], b[enough]
        yield from zip(a.tolist(), b.tolist()) if side is None else zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist())


def _led(at: np.ndarray, keys: np.ndarray, pose: np.ndarray, corners: np.ndarray):
    """Pairs of a bucket's smallest image and another one with the votes they need; each pose of the smallest votes."""
    new = np.flatnonzero(_changed(keys)).astype(np.int32)
    bucket = np.repeat(new, np.diff(np.append(new, len(keys))))
    leads = at == at[bucket]
    poses_led = np.add.reduceat(leads, new, dtype=np.int32) if len(new) else new
    count = np.repeat(poses_led, np.diff(np.append(new, len(keys))))  # poses of the leader, at its bucket's start
    by = np.flatnonzero(~leads)
    by = by[_stable(at[by])]
    for pairs, votes in _voting(at[by], by, bucket[by], count[by], at, keys, pose, len(corners)):
        b, a = np.divmod(pairs, len(corners))
        enough = votes >= needed(corners[a], corners[b])
        yield a[enough], b[enough]


def joining_links(ids: np.ndarray, data: list[bytes], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join components, of all pairs with the votes they need; with sides, of those across them, and inside one
    of leaders with more than CROWD images there."""
    order = np.argsort(ids, kind="stable")
    ids, data, side = ids[order], [data[i] for i in order], None if side is None else side[order]
    parts = _parts(data)
    corners = np.array([len(x) // CORNER for x in data], np.int64)
    parent, out = list(range(len(ids))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def meet(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y and is_copy(data[a], data[b]):
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))

    a, b = (np.concatenate(x) for x in zip((np.zeros(0, int),) * 2, *_led(*parts, corners)))
    if side is not None:  # a block's own links are another task's; here they only save a crowd's pairs
        same = side[a] == side[b]
        some = ~same | (np.bincount(a[same], minlength=len(ids))[a] > CROWD)
        a, b = a[some], b[some]
    for x, y in zip(a.tolist(), b.tolist()):
        meet(x, y)
    comp = np.array([root(i) for i in range(len(ids))], np.int64)
    for a, b in _voted(parts, comp, side, corners):
        meet(a, b)
    return out


def group_copies(media: DataFrame, id_col: str = "media_id", image: str = "image") -> DataFrame:
    """One row per image: id, n_corners, class_id (smallest id reachable), kept."""
    src = media.select(F.col(id_col).alias("id"), F.col(image))

    def make():
        def run(b: pa.RecordBatch) -> dict:
            return {"id": b.column(0), **features_of(b.column(1).to_pylist())}

        return run

    features = map_batches(src, make, T.StructType([T.StructField("id", T.LongType()), *FEATURES.fields]))
    features = truncate_lineage(features.select("id", "n_corners", "data", F.when(F.col("n_corners") > 0, F.unhex(F.sha2("data", 256))).alias("same")))
    known = features.filter(F.col("id").isNotNull() & (F.col("n_corners") > 0))
    groups = truncate_lineage(known.groupBy("same").agg(F.min("id").alias("a"), F.count("*").alias("n")))
    several = known.join(groups.filter("n > 1"), "same").select("a", F.col("id").alias("b")).filter("a <> b")
    blocks = max(1, -(-groups.count() // BLOCK))
    one = known.join(groups.select("same", F.col("a").alias("id")), ["same", "id"], "left_semi").dropDuplicates(["same", "id"])
    block = F.pmod(F.xxhash64("id", "same"), F.lit(blocks)).cast("int")
    dealt = one.select("id", "data", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "data")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        side = g["block"].to_numpy() if g["i"].iat[0] != g["j"].iat[0] else None
        found = joining_links(g["id"].to_numpy(), g["data"].to_list(), side)
        release_memory()
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    links = dealt.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(compare, "a long, b long")
    labels = connected_components(links.unionByName(several))
    out = features.select("id", "n_corners").join(labels.withColumnRenamed("node", "id"), "id", "left")
    class_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_corners", class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"))


# ---- the media column of op2 -------------------------------------------------------------------------------

SIDE = 64


def fields(dim: int, side: int = SIDE) -> np.ndarray:
    """A fixed band-limited random field per component."""
    f = np.fft.fft2(np.random.default_rng((SEED, dim)).standard_normal((dim, side, side)))
    k = np.hypot(np.fft.fftfreq(side)[:, None], np.fft.fftfreq(side)[None])
    f *= (k > 1 / 20) & (k < 1 / 6)
    x = np.fft.ifft2(f).real
    return (x / x.std((1, 2), keepdims=True)).reshape(dim, -1)


def edited(x: np.ndarray, seed: int) -> np.ndarray:
    """Cropped by an eighth at two sides, brighter, with a little noise."""
    rng = np.random.default_rng((SEED, abs(seed)))
    cut = x.shape[0] // 8
    y, z = rng.integers(0, cut + 1, 2)
    x = x[y : y + x.shape[0] - cut, z : z + x.shape[1] - cut]
    return np.clip(x * 0.9 + 20 + rng.normal(0, 2, x.shape), 0, 255)


def render(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(media_id, image): 2 * id for each row, and 2 * id + 1, edited, for ids divisible by QUERY_EVERY."""
    src = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>"))

    def make():
        made: dict[int, np.ndarray] = {}

        def run(b: pa.RecordBatch) -> dict:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.array([c for c in v or [] if c is not None], float)
                norm = np.linalg.norm(x) if len(x) else 0.0
                picture = None
                if 0 < norm < np.inf:
                    if len(x) not in made:
                        made[len(x)] = fields(len(x))
                    picture = np.clip(128 + 40 * (x / norm) @ made[len(x)], 0, 255).reshape(SIDE, SIDE)
                ids.append(None if i is None else 2 * i)
                out.append(None if picture is None else grey_bytes(picture))
                if i is not None and i % QUERY_EVERY == 0:
                    ids.append(2 * i + 1)
                    out.append(None if picture is None else grey_bytes(edited(picture, i)))
            return {"media_id": pa.array(ids, pa.int64()), "image": pa.array(out, pa.binary())}

        return run

    return map_batches(src, make, T.StructType([T.StructField("media_id", T.LongType()), T.StructField("image", T.BinaryType())]))


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_copies(render(table(spark, sf_dir, "embeddings")))
