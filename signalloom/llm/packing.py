"""Packing token sequences into windows by non-negative least squares.

Documents are tokenised and cut: whole windows first, the rest into a run of whole cells (multiples of CELL
tokens) and a crumb shorter than a cell. Lengths then take few values, and one plan for the whole corpus is
made from their histogram alone, first of crumbs into cells, then of runs and filled cells into windows:
shallow combinations of lengths that fill a bin exactly are enumerated, non-negative least squares gives each
a repeat count, the counts are rounded down, and greedy patterns take the residue. Every piece learns its
place from its rank among the pieces of its length, so no task ever holds more than a slice of the corpus.

Edge cases: a null text counts as empty and gives one piece, the end id. Repeated rows are packed each. An
empty table gives no piece.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ForcedBoundaryBPE, Memory, WordSplitter, flat, pack
from .common import add_columns, map_batches, table, truncate_lineage
from .words import spread

WINDOW, CELL, END_ID = 4096, 64, 2
#: Most parts of an enumerated combination.
PARTS = 5
#: Pieces ranked together in one group, about.
SLICE = 1 << 13
PIECES = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])


# ---- the plan ----------------------------------------------------------------------------------------------


def combinations(total: int, parts: int, most: int | None = None) -> list[tuple[int, ...]]:
    """All ways to write total as a sum of at most `parts` positive lengths, largest first."""
    most = total if most is None else most
    out = [(total,)] if total <= most else []
    if parts > 1:
        for first in range(min(most, total - 1), -(-total // parts) - 1, -1):
            out += [(first, *rest) for rest in combinations(total - first, parts - 1, first)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > tol).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= tol
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300), initial=1.0)
            x[at] += step * (s - x[at])
            free[at[(x[at] <= tol) & bad]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def fill(histogram: np.ndarray, size: int, parts: int = PARTS, exact: bool = False) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Patterns ({length: how many}, repeats) for bins of `size`, and the lengths left over.

    histogram[n]: how many pieces of length n there are, n <= size. With exact, only bins filled to the brim.
    """
    left, plan = histogram.astype(np.int64).copy(), []

    def use(pattern: dict[int, int], most: int | None = None) -> None:
        n = min(int(left[k]) // m for k, m in pattern.items())
        n = n if most is None else min(n, most)
        if n > 0:
            plan.append((pattern, n))
            for k, m in pattern.items():
                left[k] -= m * n

    use({size: 1})
    if left.any():
        ways = [c for c in combinations(size, parts) if all(left[k] > 0 for k in c)]
        if ways:
            a = np.zeros((size, len(ways)))
            for j, c in enumerate(ways):
                for k in c:
                    a[k - 1, j] += 1
            x = nnls(a, left[1:].astype(float))
            for j in np.argsort(-x, kind="stable"):
                if x[j] >= 1:
                    use({k: ways[j].count(k) for k in sorted(set(ways[j]), reverse=True)}, int(x[j] + 1e-6))
    while left.any():
        pattern, room = {}, size
        for k in np.flatnonzero(left)[::-1].tolist():
            if m := min(room // k, int(left[k])):
                pattern[k] = m
                room -= m * k
        if exact and room:
            break
        use(pattern)
    return plan, left


@dataclass(frozen=True)
class Runs:
    """For one length: ranks from first[i] on go to bins from bin_[i] on, each[i] a bin, at offset[i] and after."""

    first: np.ndarray
    bin_: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def place(self, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.first, rank, "right") - 1
        r = rank - self.first[i]
        return self.bin_[i] + r // self.each[i], self.offset[i] + r % self.each[i] * length


def runs(plan: list[tuple[dict[int, int], int]], first_bin: int = 0) -> tuple[dict[int, Runs], int]:
    """The plan by length, and the number of the next bin."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    b = first_bin
    for pattern, n in plan:
        at = 0
        for k, m in pattern.items():
            rows.setdefault(k, []).append((used.get(k, 0), b, m, at))
            used[k] = used.get(k, 0) + m * n
            at += k * m
        b += n
    return {k: Runs(*(np.array(c, np.int64) for c in zip(*v))) for k, v in rows.items()}, b


@dataclass(frozen=True)
class Plan:
    """Where the piece of a given length and rank goes."""

    window: int
    cell: int
    whole: dict[int, Runs]  # by cells
    crumbs: dict[int, Runs]  # by tokens, into cells
    loose: dict[int, Runs]  # by tokens, into windows
    in_cells: dict[int, int]  # crumbs of each length that go to cells
    ones: int  # pieces of one cell; filled cells rank after them

    @staticmethod
    def make(counts: dict[int, int], window: int = WINDOW, cell: int = CELL) -> Plan:
        units = window // cell
        coarse, fine = np.zeros(units + 1, np.int64), np.zeros(cell + 1, np.int64)
        for n, c in counts.items():
            if n % cell:
                fine[n] = c
            else:
                coarse[n // cell] = c
        crumb_plan, left = fill(fine, cell, exact=True)
        crumbs, cells = runs(crumb_plan)
        ones = int(coarse[1])
        coarse[1] += cells
        whole, bins = runs(fill(coarse, units)[0])
        rest = np.zeros(window + 1, np.int64)
        rest[: cell + 1] = left
        loose, _ = runs(fill(rest, window, parts=1)[0], bins)
        return Plan(window, cell, whole, crumbs, loose, {k: int(fine[k] - left[k]) for k in range(1, cell)}, ones)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            r = rank[at]
            if n % self.cell == 0:
                s, o = self.whole[n // self.cell].place(r, n // self.cell)
                seq[at], off[at] = s, o * self.cell
                continue
            inner = r < self.in_cells[n]
            if inner.any():
                c, o = self.crumbs[n].place(r[inner], n)
                s, w = self.whole[1].place(self.ones + c, 1)
                seq[at[inner]], off[at[inner]] = s, w * self.cell + o
            if not inner.all():
                seq[at[~inner]], off[at[~inner]] = self.loose[n].place(r[~inner] - self.in_cells[n], n)
        return seq, off


# ---- the pieces --------------------------------------------------------------------------------------------


def cut(n: int, window: int, cell: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole windows, a run of cells, a crumb."""
    whole, rest = divmod(n, window)
    return [window] * whole + [x for x in (rest // cell * cell, rest % cell) if x]


class Cutter:
    """Pieces of one document from its ids as they come; only the last, open window of ids is kept."""

    def __init__(self, window: int, cell: int):
        self.window, self.cell, self.open, self.n, self.done = window, cell, np.zeros(0, np.uint32), 0, []

    def add(self, ids: np.ndarray) -> None:
        self.open = np.concatenate([self.open, ids])
        k = len(self.open) // self.window
        for i in range(k):
            self._emit(self.open[i * self.window : (i + 1) * self.window])
        self.open = self.open[k * self.window :].copy()

    def _emit(self, ids: np.ndarray) -> None:
        self.done.append((self.n, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
        self.n += len(ids)

    def close(self, end_id: int) -> list[tuple[int, int, int]]:
        self.add(np.array([end_id], np.uint32))
        a = 0
        for n in cut(len(self.open), self.window, self.cell):
            self._emit(self.open[a : a + n])
            a += n
        return self.done


def cut_documents(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", window: int = WINDOW, cell: int = CELL, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the id column, start, length, ids_crc32, doc_tokens."""
    src = docs.select(F.col(doc), F.col(text))

    def make():
        bpe = ForcedBoundaryBPE(path)
        split, known = WordSplitter(bpe), Memory(lambda fragment: pack(bpe.encode_whole(fragment)))

        def run(b: pa.RecordBatch) -> dict:
            pieces = [Cutter(window, cell) for _ in range(b.num_rows)]
            for s in split(b.column(1)):
                fragments, which = s.distinct()
                ids, ends = spread(*flat(known.many(fragments), "<u4"), which)
                rows, at = np.unique(s.doc, return_index=True)
                for d, i, j in zip(rows.tolist(), at.tolist(), [*at[1:].tolist(), len(s.doc)]):
                    pieces[d].add(ids[ends[i - 1] if i else 0 : ends[j - 1]])
            got = [p.close(end_id) for p in pieces]
            n = np.array([len(g) for g in got])
            start, length, crc = (np.array(c, np.int64) for c in zip(*(x for g in got for x in g))) if len(got) else (np.zeros(0, np.int64),) * 3
            row = np.repeat(np.arange(len(got)), n)
            return {doc: b.column(0).take(pa.array(row)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": np.array([p.n for p in pieces], np.int64)[row]}

        return run

    return map_batches(src, make, T.StructType([*src.schema.fields[:1], *PIECES.fields]))


def pack_documents(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", window: int = WINDOW, cell: int = CELL, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    cuts = cut_documents(docs, path, doc, text, window, cell, end_id)
    slices = max(1, -(-docs.count() // SLICE))
    # the row's own number deals equal rows to different slices; the checkpoint keeps it as it was
    cuts = truncate_lineage(cuts.withColumn("__slice", F.pmod(F.xxhash64(doc, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(slices))))
    per_slice = cuts.groupBy("__slice", "length").agg(F.count("*").alias("__n"))
    counts = {r["length"]: r["n"] for r in per_slice.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most 2 * window / cell lengths
    plan = docs.sparkSession.sparkContext.broadcast(Plan.make(counts, window, cell))
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select("__slice", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    among = Window.partitionBy("__slice", "length").orderBy(doc, "start", "ids_crc32")
    ranked = cuts.withColumn("__among", F.row_number().over(among).cast("long") - 1).join(base, ["__slice", "length"])
    ranked = ranked.select(doc, "start", "length", "ids_crc32", "doc_tokens", (F.col("__base") + F.col("__among")).alias("__rank"))

    def make():
        def run(length: pa.Array, rank: pa.Array) -> list[pa.Array]:
            s, o = plan.value.place(length.to_numpy(), rank.to_numpy())
            return [pa.array(s), pa.array(o)]

        return run

    out = add_columns(ranked, make, ["length", "__rank"], T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return out.drop("__rank")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
