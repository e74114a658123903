"""Near-duplicate embeddings by sorted projection passes.

Each pass gives every vector a key: its signs against random hyperplanes through the vectors' mean, most significant
first. Vectors are sorted by the key, so that near ones share long prefixes, and each meets the WINDOW vectors before
it, across the borders of partitions too. What is sorted is the key, the id and a sketch of further signs: only pairs
whose sketches agree as often as those of a pair at the threshold do (less four standard deviations) fetch their
vectors, once, and are verified in double precision. Verified pairs of all passes are united into components.

A row with more than CROWD such pairs gives its best one only; the ids of pairs held back meet again, now knowing
their components, and only pairs across components count. So near copies in thousands cost a few pairs each.

How dense vectors lie is measured, not assumed: a row and the ones WINDOW before and behind it share so many signs,
and one sign more leads to all its neighbours inside the window. A pair at the threshold shares it with a probability
that follows from how far the vector is from the mean. Where the passes together may miss such a pair with more
than OPEN, or crowds stay, the vectors go through another turn, with planes through their own mean; what is still
open then, or is at most EXACT vectors, is compared exactly, in tiles: work quadratic in the vectors of dense places.

A link can only lie inside a component, so the links of each vector are then counted exactly there: the
members of a component of more than one distinct vector are dealt into tiles of bounded size, and every pair
of tiles is one task's matrix product that yields counts, not pairs.

Equal vectors are one vector with a count from the start, so a hot vector costs one row.

Edge cases: null, empty, zero vectors and those with a null, NaN or infinite component link with nothing.
Vectors of different lengths never link. Repeated rows (equal ids too) count as separate vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_batches, table, truncate_lineage
from .components import connected_components, union_find
from .pairs import with_payloads

COSINE = 0.95
#: Signs a key, rows met before each, and pairs of a row that are all verified.
SIGNS, WINDOW, CROWD = 48, 2048, 16
#: Probability of missing a pair at the threshold: what passes are planned for, and from which a vector is open.
MISS, OPEN = 3e-5, 1e-3
#: Passes that are always made, if so many are needed, and those made where more are that cost as much as comparing all;
#: most words of a sketch, turns of passes, and open vectors that are always compared exactly.
PASSES, FEW, WORDS, TURNS, EXACT = 32, 3, 6, 3, 16_384
#: Rows that are compared together, and vectors of a tile.
BLOCK, TILE = 8192, 8192
SEED = 20240607
#: Steps a unit in which a row's squared distance from the mean is kept.
STEPS = 64


def agreement(square: np.ndarray | float, cosine: float = COSINE) -> np.ndarray:
    """Probability that two vectors at `cosine`, both at this squared distance from the mean or more, agree in a sign."""
    rho = np.clip(1 - (1 - cosine) / np.maximum(square, 1e-9), -1, 1)
    return 1 - np.arccos(rho) / np.pi


def level_of(n: int, window: int = WINDOW) -> int:
    """Signs of a prefix that leaves well under a window of n unrelated vectors."""
    return min(SIGNS, math.ceil(max(0.0, math.log2(max(1, n) / window))) + (n > window))


def passes_for(n: int, q: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes that leave a pair that agrees in a sign with probability q unmet with probability `miss`, among n vectors."""
    meets = max(1e-6, min(1 - miss, q ** level_of(n, window)))
    need = max(1, math.ceil(math.log(miss) / math.log1p(-meets)))
    return need if need <= max(PASSES, min(n // (2 * window), 30_000)) else FEW


def words_for(q: float) -> int:
    """Sketch words (64 bits each, 16 of all for other uses) that tell pairs at the threshold from unrelated ones."""
    bits = ((4 * math.sqrt(q * (1 - q)) + 2.75) / max(0.05, q - 0.5)) ** 2
    return min(WORDS, max(2, math.ceil((bits + 16) / 64)))


def packed(row: np.ndarray) -> bytes:
    """A vector as floats where that is exact, else as doubles, behind the size of one."""
    small = row.astype("<f4")
    return b"\x04" + small.tobytes() if (small == row).all() else b"\x08" + row.astype("<f8").tobytes()


def lengths(v: list[bytes]) -> np.ndarray:
    return np.array([(len(x) - 1) // x[0] for x in v], np.int64)


def units(v: list[bytes]) -> np.ndarray:
    """Unit rows of packed vectors of one length."""
    x = np.stack([np.frombuffer(x, "<f4" if x[0] == 4 else "<f8", offset=1).astype(np.float64) for x in v])
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(v: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the vectors of each length."""
    dim = lengths(v)
    for d in np.unique(dim).tolist():
        at = np.flatnonzero(dim == d)
        yield at, units([v[i] for i in at])


# ---- hashing -----------------------------------------------------------------------------------------------


class Hashes:
    """Keys and sketch of unit rows: signs against planes through a mean, made when first needed."""

    def __init__(self, passes: int, words: int, turn: int, means: dict[int, np.ndarray], signs: int = SIGNS):
        self.passes, self.words, self.turn, self.means, self.signs = passes, words, turn, means, signs
        self.made: dict[int, np.ndarray] = {}

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit rows of one length: keys, passes a row, the pass in the upper bits; sketches, words a row.

        The low 16 bits of the last word: steps of the squared distance from the mean, and the length modulo 251.
        """
        dim = x.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng((SEED, dim, self.turn))
            self.made[dim] = rng.standard_normal((dim, self.passes * self.signs + self.words * 64 - 16))
        y = x - self.means.get(dim, 0.0)
        bits = y @ self.made[dim] > 0
        cut = self.passes * self.signs
        key = (bits[:, :cut].reshape(len(x), self.passes, self.signs) * (np.int64(1) << np.arange(self.signs - 1, -1, -1, dtype=np.int64))).sum(2)
        key |= np.arange(self.passes, dtype=np.int64) << np.int64(SIGNS)
        low = np.zeros((len(x), 16), bool)
        step = np.minimum((y * y).sum(1) * STEPS, 255).astype(np.int64)
        low[:, :8] = (step[:, None] >> np.arange(7, -1, -1)) & 1
        low[:, 8:] = (dim % 251 >> np.arange(7, -1, -1)) & 1
        sketch = np.packbits(np.hstack([bits[:, cut:], low]), axis=1).view(">u8").astype(np.uint64)
        return key, sketch


def _means(vectors: DataFrame) -> tuple[dict[int, np.ndarray], float]:
    """The mean of the unit rows of each length (of the 64 commonest), and the mean square about it."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            out = [(x.shape[1], len(x), x.sum(0).tolist()) for _, x in by_length(b.column(1).to_pylist())]
            return dict(zip(("dim", "n", "x"), map(list, zip(*out)))) if out else {"dim": [], "n": [], "x": []}

        return run

    sums = map_batches(vectors.select("id", "v"), make, T.StructType([T.StructField("dim", T.LongType()), T.StructField("n", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    sums = sums.select("dim", "n", F.posexplode("x").alias("i", "x")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    common = sums.filter("i = 0").orderBy(F.desc("n")).limit(64).select("dim")
    found: dict[int, dict] = {}
    for r in sums.join(F.broadcast(common), "dim").collect():
        found.setdefault(r["dim"], {})[r["i"]] = (r["n"], r["x"])
    means = {d: np.array([got[i][1] / got[i][0] for i in range(d)]) for d, got in found.items()}
    many = {d: got[0][0] for d, got in found.items()}
    spread = sum(many[d] * (1 - float(m @ m)) for d, m in means.items()) / max(1, sum(many.values()))
    return means, spread


def _hashed(vectors: DataFrame, hashes: Hashes) -> DataFrame:
    """(id, keys, s0, s1, ...) of vectors (id, v)."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            ids, v = b.column(0).to_numpy(), b.column(1).to_pylist()
            key, sketch = np.zeros((len(v), hashes.passes), np.int64), np.zeros((len(v), hashes.words), np.uint64)
            for at, x in by_length(v):
                key[at], sketch[at] = hashes(x)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * hashes.passes, pa.int32()), pa.array(key.ravel()))
            return {"id": ids, "keys": keys} | {f"s{i}": sketch[:, i].view(np.int64) for i in range(hashes.words)}

        return run

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(f"s{i}", T.LongType()) for i in range(hashes.words))])
    return map_batches(vectors.select("id", "v"), make, schema)


# ---- the scan of sorted rows -------------------------------------------------------------------------------


class Limits:
    """By a row's low byte of distance: most differing bits of a sketch's first words, and the logarithm of missing at a level."""

    def __init__(self, words: int, cosine: float, signs: int = SIGNS):
        q = agreement((np.arange(256) + 0.0) / STEPS, cosine)
        bits = np.minimum(64 * np.arange(1, words + 1), 64 * words - 16)[:, None]
        self.most = np.floor(bits * (1 - q) + 4 * np.sqrt(bits * q * (1 - q))).astype(np.int64)  # words x steps
        self.miss = np.log1p(-np.minimum(q[:, None] ** np.arange(signs + 2), 1 - 1e-9))  # steps x levels
        self.miss[:, signs + 1] = 0.0  # not seen


def levels(ps: np.ndarray, keys: np.ndarray, window: int, signs: int) -> np.ndarray:
    """For sorted rows the signs by which a row's neighbours are all inside the window; signs + 1 where that isn't seen."""
    out = np.full(len(ps), -1)
    for step in (window, -window):  # behind and before
        i = np.arange(len(ps)) + step
        seen = (i >= 0) & (i < len(ps))
        i = np.clip(i, 0, len(ps) - 1)
        shared = np.where(seen, signs - np.frexp((keys ^ keys[i]).astype(np.float64))[1], signs)
        out = np.maximum(out, np.where(ps == ps[i], shared, -1))
    return out + 1


def near_pairs(rows: list[np.ndarray], old: int, limits: Limits, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows j >= old, i before them by `window` at most, and differing bits, for which sketches may be of a link.

    rows: key, id, component, then the words of the sketch. Of one pass, one length and two components.
    """
    key, _, comp, *words = rows
    n, k = len(key), len(words)
    low = words[-1] & np.uint64(0xFFFF)
    step, kind = (low >> np.uint64(8)).astype(np.intp), low & np.uint64(0xFF)
    ps = key >> np.int64(SIGNS)
    last = words[-1] & ~np.uint64(0xFFFF)
    most = limits.most
    first = most[0][step].max(initial=0)
    out = [np.zeros((3, 0), np.int64)]
    for d in range(1, min(window, n - 1) + 1):
        a = max(d, old)
        here = words[0][a:] ^ words[0][a - d : n - d]
        got = np.bitwise_count(here)
        at = np.flatnonzero(got <= first)
        if not len(at):
            continue
        bits, j = got[at].astype(np.int64), at + a
        i = j - d
        ok = (ps[j] == ps[i]) & (kind[j] == kind[i]) & (comp[j] != comp[i]) & (bits <= np.maximum(most[0][step[i]], most[0][step[j]]))
        for w in range(1, k):
            i, j, bits = i[ok], j[ok], bits[ok]
            x = last if w == k - 1 else words[w]
            bits = bits + np.bitwise_count(x[i] ^ x[j])
            ok = bits <= np.maximum(most[w][step[i]], most[w][step[j]])
        out.append(np.stack([j[ok], i[ok], bits[ok]]))
    return tuple(np.concatenate(out, 1))


def chosen(j: np.ndarray, i: np.ndarray, bits: np.ndarray, ids: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids a, b of the pairs to be verified, each once: all of a row with at most `crowd`, else its best; ids of the rest."""
    order = np.lexsort((bits, j))
    j, i = j[order], i[order]
    first = np.searchsorted(j, j)
    count = np.searchsorted(j, j, "right") - first
    keep = (count <= crowd) | (np.arange(len(j)) == first)
    a, b = ids[j], ids[i]
    pairs = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]), axis=1)
    return pairs[0], pairs[1], np.unique(np.concatenate([a[~keep], b[~keep]]))


PAIR, CROWDED, BORDER, MISSES = range(4)
FOUND = ("kind", "a", "b", "border", "side", "miss")


def _scan(rows: DataFrame, limits: Limits, window: int, expected: int, misses: bool, signs: int = SIGNS) -> DataFrame:
    """What sorted rows (key, id, comp, s0, ...) give: pairs to verify, ids of pairs held back, and, if asked, for rows
    whose neighbourhood is not known to be inside the window at level `expected`, how much likelier a pair is missed
    (the logarithm). Also across the borders of partitions.
    """
    names = rows.columns
    schema = "kind int, a long, b long, border int, side int, miss double, " + ", ".join(f"{c}_ long" for c in names)

    def record(kind: int, n: int, **columns) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "border": pa.int32(), "side": pa.int32(), "miss": pa.float64()} | {f"{c}_": pa.int64() for c in names}
        columns["kind"] = np.full(n, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def tell(found: tuple, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, held = chosen(*found, ids, CROWD)
        if len(a):
            yield record(PAIR, len(a), a=a, b=b)
        if len(held):
            yield record(CROWDED, len(held), a=held)

    def missed(rows: list, done: int, end: int) -> Iterator[pa.RecordBatch]:
        key, step = rows[0], ((rows[-1] >> np.uint64(8)) & np.uint64(0xFF)).astype(np.intp)
        level = levels(key >> np.int64(SIGNS), key & np.int64((1 << SIGNS) - 1), window, signs)[done:end]
        at = np.flatnonzero(level > expected)
        if len(at):
            s = step[done:end][at]
            yield record(MISSES, len(at), a=rows[1][done:end][at], miss=limits.miss[s, level[at]] - limits.miss[s, expected])

    def edge(rows: list, border: int, side: int) -> pa.RecordBatch:
        n = len(rows[0])
        return record(BORDER, n, border=np.full(n, border, np.int32), side=np.full(n, side, np.int32), **{f"{c}_": r.view(np.int64) for c, r in zip(names, rows)})

    def columns_of(batches: list) -> list[np.ndarray]:
        out = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(len(names))]
        return out[:3] + [x.view(np.uint64) for x in out[3:]]

    def run(batches):
        part, held, waiting, size, head, done = TaskContext.get().partitionId(), None, [], 0, None, 0

        def work(rows: list, new: int, last: bool):
            nonlocal done
            yield from tell(near_pairs(rows, len(rows[0]) - new, limits, window), rows[1])
            if misses:
                end = len(rows[0]) if last else max(done, len(rows[0]) - window)
                yield from missed(rows, done, end)
                done = end

        def advance(last: bool):
            nonlocal held, head, done, waiting, size
            fresh = columns_of(waiting) if waiting else None
            rows = [np.concatenate(x) for x in zip(held, fresh)] if held and fresh else fresh or held
            if rows is None:
                return
            yield from work(rows, len(fresh[0]) if fresh else 0, last)
            if head is None or len(head[0]) < window:
                head = [np.concatenate(x)[:window] for x in zip(head, fresh)] if head and fresh else [x[:window] for x in fresh] if fresh else head
            cut = max(0, len(rows[0]) - 2 * window)  # a row's level needs the window before it too
            held, done, waiting, size = [x[cut:] for x in rows], done - cut, [], 0

        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield from advance(False)
        yield from advance(True)
        if head is not None:
            yield edge(head, part, 1)
            yield edge([x[-window:] for x in held], part + 1, 0)

    def across(batches) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        for _, g in pa.Table.from_batches(batches).to_pandas().groupby("border") if batches else ():
            g = g.sort_values(["side", "key_", "id_"], kind="stable")
            x = [g[f"{c}_"].to_numpy() for c in names]
            x = x[:3] + [c.view(np.uint64) for c in x[3:]]
            yield from tell(near_pairs(x, int((g["side"] == 0).sum()), limits, window), x[1])

    found = truncate_lineage(rows.mapInArrow(run, schema))
    borders = found.filter(f"kind = {BORDER}")
    between = borders.repartition("border").mapInArrow(across, schema).select("kind", "a", "b", "miss")
    return truncate_lineage(found.filter(f"kind <> {BORDER}").select("kind", "a", "b", "miss").unionByName(between))


def _sorted(hashed: DataFrame, n: int, passes: int, window: int) -> DataFrame:
    """A row a pass, in key order by range, each partition many times the window where there is so much."""
    spark = hashed.sparkSession
    words = [c for c in hashed.columns if c.startswith("s")]
    comp = F.col("comp") if "comp" in hashed.columns else F.col("id")
    rows = hashed.select(F.explode("keys").alias("key"), "id", comp.alias("comp"), *words)
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * passes // 4_000_000)
    parts = max(1, min(most, n * passes // (8 * window)))
    return rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Those of the pairs (a, b) whose vectors link."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            v = [b.column(c).to_pylist() for c in (2, 3)]
            dim = [lengths(x) for x in v]
            ok = np.zeros(b.num_rows, bool)
            for d in np.unique(dim[0]).tolist():
                at = np.flatnonzero((dim[0] == d) & (dim[1] == d))
                if len(at):
                    x, y = (units([s[i] for i in at]) for s in v)
                    ok[at] = (x * y).sum(1) >= cosine
            keep = pa.array(np.flatnonzero(ok))
            return {"a": b.column(0).take(keep), "b": b.column(1).take(keep)}

        return run

    both = with_payloads(pairs, vectors.select("id", F.col("v").alias("data")))
    return truncate_lineage(map_batches(both, make, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))


def _turn(vectors: DataFrame, labels: DataFrame | None, n: int, turn: int, cosine: float, window: int) -> tuple[DataFrame, DataFrame]:
    """One turn of passes over n vectors (id, v): (links, ids that may have a link that none of them is).

    labels: (node, component) so far; pairs inside a component are left out.
    """
    means, spread = _means(vectors)
    q = float(agreement(spread, cosine))
    passes, words = passes_for(n, q, window), words_for(q)
    expected = level_of(n, window)
    limits = Limits(words, cosine)
    hashed = truncate_lineage(_hashed(vectors, Hashes(passes, words, turn, means)))
    rows = hashed if labels is None else _labelled(hashed, labels)
    found = _scan(_sorted(rows, n, passes, window), limits, window, expected, n > window)
    links = _verified(truncate_lineage(found.filter(f"kind = {PAIR}").select("a", "b").distinct()), vectors, cosine)
    crowded = truncate_lineage(found.filter(f"kind = {CROWDED}").select(F.col("a").alias("id")).distinct())
    more = crowded.count()
    if more and (more <= n // 2 or n <= window):  # crowds nearly everywhere would only meet again
        known = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        again = _labelled(hashed.join(crowded, "id", "left_semi"), connected_components(known))
        second = _scan(_sorted(again, more, passes, window), limits, window, expected, False)
        links = links.unionByName(_verified(truncate_lineage(second.filter(f"kind = {PAIR}").select("a", "b").distinct()), vectors, cosine))
        crowded = second.filter(f"kind = {CROWDED}").select(F.col("a").alias("id")).distinct()
    if n <= window:  # every vector met every other
        return links, truncate_lineage(crowded)
    step = F.shiftrightunsigned(F.col(f"s{words - 1}"), 8).bitwiseAND(F.lit(255))
    planned = F.get(F.array(*[F.lit(float(passes * x)) for x in limits.miss[:, expected]]), step.cast("int"))
    worse = found.filter(f"kind = {MISSES}").groupBy(F.col("a").alias("id")).agg(F.sum("miss").alias("worse"))
    missing = hashed.select("id", planned.alias("planned")).join(worse, "id", "left").filter(F.col("planned") + F.coalesce("worse", F.lit(0.0)) > math.log(OPEN))
    return links, truncate_lineage(missing.select("id").unionByName(crowded.select("id")).distinct())


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("id"), F.col("component").alias("__c")), "id", "left").withColumn("comp", F.coalesce("__c", "id")).drop("__c")


def joining_links(x: np.ndarray, ids: np.ndarray, comp: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> list[tuple[int, int]]:
    """Of the links between rows a and rows b, enough to join the components that they join."""
    names, comp = np.unique(comp, return_inverse=True)
    out = []
    for s in range(0, len(a), 512):
        some = a[s : s + 512]
        i, j = np.nonzero(((x[some] @ x[b].T) >= cosine) & (comp[some][:, None] != comp[b]))
        i, j = some[i], b[j]
        _, first = np.unique(np.minimum(comp[i], comp[j]) * len(names) + np.maximum(comp[i], comp[j]), return_index=True)
        i, j = i[first], j[first]
        out += zip(ids[i].tolist(), ids[j].tolist())
        to = np.arange(len(names))
        node, root = union_find(comp[i], comp[j])
        to[node] = root
        comp = to[comp]
    return out


def _tiles(n):
    """Tiles of n members: enough to keep some tasks busy, of TILE at most on average."""
    return F.greatest(F.ceil(n / TILE), F.least(F.lit(6), F.ceil(n / 512))).cast("int")


def _exact_links(members: DataFrame, n: int, cosine: float) -> DataFrame:
    """Links among n members (id, v, component) that join components, from all pairs of them, in tiles."""
    m = members.withColumn("tiles", _tiles(F.lit(n))).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    m = m.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "component", "v")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        out, ids, comp, tile = [], g["id"].to_numpy(), g["component"].to_numpy(), g["tile"].to_numpy()
        for at, x in by_length(g["v"].to_list()):
            a, b = (np.flatnonzero(tile[at] == g[c].iat[0]) for c in ("i", "j"))
            out += joining_links(x, ids[at], comp[at], a, b, cosine)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    k = max(-(-n // TILE), min(6, -(-n // 512)))
    return m.repartition(max(1, k * (k + 1) // 2), "i", "j").groupBy("i", "j").applyInPandas(compare, "a long, b long")


def _components(vectors: DataFrame, n: int, cosine: float, window: int) -> DataFrame:
    """(node, component) of n distinct vectors (id, v): turns of passes, then what they leave open, exactly."""
    left, links, labels = vectors, None, None
    for turn in range(TURNS):
        new, open_ = _turn(left, labels, n, turn, cosine, window)
        links = new if links is None else links.unionByName(new)
        labels = connected_components(links)
        before, n = n, open_.count()
        if n <= EXACT or n > before // 2:  # another turn would tell little more
            break
        left = truncate_lineage(vectors.join(open_, "id", "left_semi"))
    if n < 2:
        return labels
    members = _labelled(vectors.join(open_, "id", "left_semi"), labels).withColumnRenamed("comp", "component")
    if members.select("component").distinct().limit(2).count() < 2:
        return labels
    more = truncate_lineage(_exact_links(members, n, cosine))
    return connected_components(links.unionByName(more)) if more.take(1) else labels


def _links_inside(members: DataFrame, cosine: float) -> DataFrame:
    """(id, links): for members (component, id, n, v) the sum of n over the others within `cosine`."""
    sizes = members.groupBy("component").agg(_tiles(F.count("*")).alias("tiles"))
    sizes = truncate_lineage(sizes)  # apart from its grouping, so that the join of a hot component can be split
    m = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    m = m.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "n", "v")

    def count(g: pd.DataFrame) -> pd.DataFrame:
        out, ids, many, tiles = [], g["id"].to_numpy(), g["n"].to_numpy(), g["tile"].to_numpy()
        i, j = g["i"].iat[0], g["j"].iat[0]
        for at, x in by_length(g["v"].to_list()):
            n, tile = many[at], tiles[at]
            a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            links = np.zeros(len(at), np.int64)
            for s in range(0, len(a), 512):
                some = a[s : s + 512]
                near = (x[some] @ x[b].T) >= cosine
                if i == j:
                    near[np.arange(len(some)), np.arange(s, s + len(some))] = False
                    links[some] += near @ n[b]
                else:
                    links[some] += near @ n[b]
                    links[b] += near.T @ n[some]
            out.append(pd.DataFrame({"id": ids[at], "links": links}))
        return pd.concat(out)

    m = m.repartition("component", "i", "j")  # else the tiles of a component stay where the join by component put them
    return m.groupBy("component", "i", "j").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _sound(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, same): the packed vector and its fingerprint, null for a vector that links with nothing."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            lists, v = b.column(1), []
            flat = lists.flatten()
            bad = np.asarray(flat.is_null())
            x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            bad |= ~np.isfinite(x)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            for a, z in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                row = x[a:z]
                v.append(packed(row) if z > a and not bad[a:z].any() and row.any() else None)
            same = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in v]
            return {"id": b.column(0), "v": pa.array(v, pa.binary()), "same": pa.array(same, pa.binary())}

        return run

    src = rows.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull(), F.col(vector)).alias("x"))
    return map_batches(src, make, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("same", T.BinaryType())]))


def group_embeddings(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    bound_batches(rows.sparkSession)
    src = truncate_lineage(_sound(rows, id_col, vector))
    distinct = src.filter(F.col("same").isNotNull()).groupBy("same").agg(F.min(F.struct("id", "v")).alias("x"), F.count("*").alias("n"))
    distinct = truncate_lineage(distinct.select("same", "x.id", "x.v", "n"))
    # ids of several vectors: one node, whose vectors are compared apart
    labels = _components(distinct.select("id", "v"), distinct.count(), cosine, window)
    named = distinct.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = truncate_lineage(named)
    several = truncate_lineage(named.groupBy("component").agg(F.count("*").alias("c")).filter("c > 1").select("component"))
    links = _links_inside(named.join(several, "component").withColumn("id", F.xxhash64("same")), cosine)
    per_vector = named.select("same", "component", "n", F.xxhash64("same").alias("id")).join(links, "id", "left").select("same", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = src.select("id", "same").join(per_vector, "same", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_embeddings(table(spark, sf_dir, "embeddings"))
