"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find grouping.

SuperMinHash gives each element one random rank per step and a position from a permutation of its own, so
the values of one signature are correlated and vary less than independent ones; a document stops as soon as
its signature is full, since later steps can only bring larger values.

1. One pass over the texts: shingle set, its size and 128-bit fingerprint, signature, band keys.
2. Equal sets become one class, so exact copies never meet again.
3. In every band bucket all members are paired with the smallest one: as many pairs as rows, however large
   the bucket. Pairs are verified on full shingle sets; links give components.
4. In a bucket whose members are not all in its smallest member's component, each outsider meets the members of
   other components, in tiles of bounded size that hold the full sets: those whose signatures agree in MIN_AGREE
   of their places (at a similarity of 0.8 less is over four standard deviations off), the most similar first,
   each pair only in the first band it shares. A link found joins two components inside the tile, so their
   other pairs need no test; only such joining links leave the task, fewer than its rows.

Edge cases: documents without words (null or empty texts too) have 0 shingles and link with nothing; one word
gives one shingle. Repeated rows are copies of each other. A null id is never linked to by a smaller one; its
row is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_batches, mix64, table, truncate_lineage
from .components import connected_components
from .pairs import with_payloads
from .words import segments, separators, span_hashes, string_bytes

#: Words a shingle, and the least similarity of a link in hundredths.
SHINGLE, PERCENT = 2, 80
#: At a similarity of 0.8 a pair meets in none of the bands with probability (1 - 0.8**ROWS)**BANDS < 4e-5.
BANDS, ROWS = 26, 5
PLACES = BANDS * ROWS
#: Least part of equal places (8 bits each) for a pair of stage 4.
MIN_AGREE = 0.65
TILE = 1024
#: Bytes hashed together.
SEGMENT = 1 << 20
WORD_ENDS = separators([0x20, *range(0x09, 0x0E)])
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Elements whose permutations are held together.
CHUNK = 100_000

FEATURES = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("fp_a", T.LongType()), T.StructField("fp_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


@dataclass(frozen=True)
class Settings:
    shingle: int = SHINGLE
    percent: int = PERCENT


# ---- kernels -----------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, ascending within each document, and their n + 1 offsets."""
    b, offsets = string_bytes(texts)
    b = np.where((b >= 65) & (b <= 90), b | 0x20, b)
    n = len(texts)
    words, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s in segments(b, offsets, WORD_ENDS, SEGMENT):
        words.append(span_hashes(s.b, s.first, s.end))
        docs.append(s.doc)
    h, d = np.concatenate(words), np.concatenate(docs)
    count = np.bincount(d, minlength=n)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))  # fewer words: the whole sequence as one
    out = np.zeros(len(h), np.uint64)
    for i in range(k):  # word i of the shingle that begins at each word, while in the same document
        there = np.zeros(len(h), bool)
        there[: len(h) - i] = d[i:] == d[: len(d) - i]
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - i] = h[i:]
        out = np.where(there, mix64(out * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(i + 1)), out)
    first = np.cumsum(count) - count
    at = np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = out[at]
    ends = np.cumsum(size)
    for a, z in zip((ends - size).tolist(), ends.tolist()):
        out[a:z].sort()
    doc = np.repeat(np.arange(n), size)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))]).astype(np.int64)


def super_minhash(s: np.ndarray, offsets: np.ndarray, m: int = PLACES) -> np.ndarray:
    """Signatures, one row of m values per document: step number in the high half, random rank in the low one."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    sig = np.full((n, m), EMPTY)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // CHUNK)) + 1
    for docs in np.split(order, cuts) if len(order) else []:
        k = sizes[docs]
        at = np.repeat(offsets[docs] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        sig[docs] = _signatures(s[at], np.repeat(np.arange(len(docs)), k), len(docs), m)
    return sig


def _signatures(x: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    sig = np.full(n * m, EMPTY)
    perm = None
    for j in range(m):
        r = mix64(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.intp)
        rows = np.arange(len(x))
        if j == 0:
            place = pick
        else:
            place = perm[rows, pick].astype(np.intp)
        np.minimum.at(sig, doc * m + place, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
        open_ = (sig.reshape(n, m) == EMPTY).any(1)
        if not open_.any():
            break
        go = open_[doc]
        if perm is None:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(go.sum()), m)).copy()
            pick = pick[go]
            perm[np.arange(len(pick)), pick] = 0
        else:
            perm[rows, pick] = perm[:, j]
            perm = perm[go] if not go.all() else perm
        x, doc = x[go], doc[go]
    return sig.reshape(n, m)


def features_of(texts: pa.Array, k: int = SHINGLE) -> dict:
    s, offsets = shingle_sets(texts, k)
    sizes = np.diff(offsets)
    some = sizes > 0
    starts = offsets[:-1][some]
    fp = np.zeros((2, len(sizes)), np.uint64)
    if some.any():
        for i, c in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            fp[i, some] = np.add.reduceat(mix64(s * np.uint64(c) + np.uint64(i)), starts)
    sig = super_minhash(s, offsets)
    bands = np.zeros((len(sizes), BANDS), np.uint64)
    for i in range(ROWS):
        bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    low = (sig & np.uint64(255)).astype(np.uint8)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(bands[some].ravel().view(np.int64)))
    return {"n_shingles": sizes, "fp_a": fp[0].view(np.int64), "fp_b": fp[1].view(np.int64), "bands": lists, "sketch": pa.array([low[i].tobytes() if x else b"" for i, x in enumerate(some)], pa.binary())}


def verified(a: bytes, b: bytes, percent: int) -> bool:
    """Of two ascending sets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= percent * (len(z) - both)


# ---- stages ------------------------------------------------------------------------------------------------


def _features(docs: DataFrame, settings: Settings) -> DataFrame:
    def make():
        return lambda b: {"doc_id": b.column(0), **features_of(b.column(1), settings.shingle)}

    return map_batches(docs, make, T.StructType([T.StructField("doc_id", T.LongType()), *FEATURES.fields]))


def _sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, fp_a, fp_b, members: the set as bytes)."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            s, o = shingle_sets(b.column(1), settings.shingle)
            f = [np.zeros(b.num_rows, np.uint64) for _ in range(2)]
            some = np.diff(o) > 0
            for i, c in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
                if some.any():
                    f[i][some] = np.add.reduceat(mix64(s * np.uint64(c) + np.uint64(i)), o[:-1][some])
            return {"doc_id": b.column(0), "fp_a": f[0].view(np.int64), "fp_b": f[1].view(np.int64), "members": pa.array([s[x:z].tobytes() for x, z in zip(o[:-1], o[1:])], pa.binary())}

        return run

    return map_batches(docs, make, T.StructType([T.StructField("doc_id", T.LongType()), FEATURES.fields[1], FEATURES.fields[2], T.StructField("members", T.BinaryType())]))


#: Ids of documents to be fetched are broadcast up to this many (8 bytes each), joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def _sets_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """(id, data): the full sets of the class representatives `ids` (doc_id), from their whole texts."""
    wanted = truncate_lineage(ids.distinct())
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    keys = classes.select(F.col("rep").alias("doc_id"), "fp_a", "fp_b").join(near, "doc_id", "left_semi")
    sets = _sets(docs.join(near, "doc_id", "left_semi"), settings).join(keys, ["doc_id", "fp_a", "fp_b"], "left_semi")
    return truncate_lineage(sets.select(F.col("doc_id").alias("id"), F.col("members").alias("data")))


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Those of the (checkpointed) pairs (a, b) of class representatives that are links; a may be hot."""
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, classes, settings)

    def make():
        def run(b: pa.RecordBatch) -> dict:
            ok = [verified(x.as_py(), y.as_py(), settings.percent) for x, y in zip(b.column(2), b.column(3))]
            keep = pa.array(np.flatnonzero(ok))
            return {"a": b.column(0).take(keep), "b": b.column(1).take(keep)}

        return run

    return truncate_lineage(map_batches(with_payloads(pairs, sets), make, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).distinct())


def _near_size(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def joining_links(x: pd.DataFrame, y: pd.DataFrame, key: int, percent: int) -> list[tuple[int, int]]:
    """Links between outsiders x and members y of one bucket that join their components; see stage 4."""
    sx, sy = (np.frombuffer(b"".join(t["sketch"]), np.uint8).reshape(len(t), -1) for t in (x, y))
    bx, by = (np.array(t["bands"].to_list()) for t in (x, y))
    nx, ny, rx, ry = x["n"].to_numpy(), y["n"].to_numpy(), x["rep"].to_numpy(), y["rep"].to_numpy()
    cx, cy, dx, dy, out = x["comp"].to_numpy().copy(), y["comp"].to_numpy().copy(), x["data"].to_list(), y["data"].to_list(), []
    at = np.arange(len(y))
    for i in range(len(x)):
        first = (by == bx[i]).argmax(1)
        k = np.flatnonzero((cy != cx[i]) & (100 * np.minimum(ny, nx[i]) >= percent * np.maximum(ny, nx[i])) & (by[at, first] == key))
        if not len(k):
            continue
        agree = (sy[k] == sx[i]).mean(1)
        order = np.lexsort((ry[k], -agree))
        k = k[order[agree[order] >= MIN_AGREE]]
        while len(k):
            j, k = k[0], k[1:]
            if verified(dx[i], dy[j], percent):
                out.append((min(rx[i], ry[j]), max(rx[i], ry[j])))
                old, new = cx[i], cy[j]
                cx[cx == old] = new
                cy[cy == old] = new
                k = k[cy[k] != new]
    return out


def _open_links(members: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame | None:
    """Stage 4 for bucket members (key, rep, n, leader); None if no bucket is open."""
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("component").alias(name))
    m = members.join(of("rep", "__c"), "rep", "left").join(of("leader", "__l"), "leader", "left")
    m = m.select("key", "rep", "n", "leader", F.coalesce("__c", "rep").alias("comp"), F.coalesce("__l", "leader").alias("lcomp")).filter(F.col("rep") != F.col("leader"))
    m = truncate_lineage(m.select("key", "rep", "n", "comp", (F.col("comp") != F.col("lcomp")).alias("out")))
    sizes = m.groupBy("key").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.count("*").alias("n_all"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    sizes = sizes.filter("n_out > 0 AND c0 < c1").select("key", F.ceil(F.col("n_out") / TILE).cast("int").alias("lb"), F.ceil(F.col("n_all") / TILE).cast("int").alias("rb"))
    sizes = truncate_lineage(sizes)
    m = truncate_lineage(m.join(sizes, "key"))
    if not m.take(1):
        return None
    sets = _sets_of(m.select(F.col("rep").alias("doc_id")), docs, classes, settings)
    m = m.join(classes.select("rep", "sketch", "bands"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(every("lb"), lambda i: F.struct(i.alias("i"), block("rb").alias("j"), F.lit(False).alias("left")))
    as_outsider = F.transform(every("rb"), lambda j: F.struct(block("lb").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    m = m.withColumn("place", F.explode(F.concat(own, F.when(F.col("out"), as_outsider).otherwise(F.filter(as_outsider, lambda p: F.lit(False))))))
    m = m.select("key", "place.i", "place.j", "place.left", "rep", "n", "comp", "sketch", "bands", "data")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        links = joining_links(g[g["left"]], g[~g["left"]], g["key"].iat[0], settings.percent) if g["left"].any() else []
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return m.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def group_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, settings).drop("fp_a", "fp_b")


def _grouped(docs: DataFrame, settings: Settings) -> DataFrame:
    """group_near_duplicates with the fingerprint of each row's set."""
    docs = docs.select("doc_id", "text")
    features = truncate_lineage(_features(docs, settings))
    known = features.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = truncate_lineage(known.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    rows = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.count("*").alias("size")).filter("size > 1").select("key", F.col("low.rep").alias("leader"), F.col("low.n").alias("leader_n"))
    buckets = truncate_lineage(buckets)  # apart from its grouping, so that a hot bucket's join can be split
    members = truncate_lineage(rows.join(buckets, "key"))
    pairs = members.filter((F.col("rep") != F.col("leader")) & _near_size("n", "leader_n", settings.percent)).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = truncate_lineage(pairs)
    links = _verify(pairs, docs, classes, settings)
    labels = connected_components(links)
    more = _open_links(members, labels, docs, classes, settings)
    if more is not None:
        labels = connected_components(links.unionByName(more))
    grouped = classes.select("fp_a", "fp_b", "n_shingles", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.select("fp_a", "fp_b", "n_shingles", F.coalesce("component", "rep").alias("__component"))
    out = features.drop("bands", "sketch").join(grouped, ["fp_a", "fp_b", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("__component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "fp_a", "fp_b", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


PRINTS = T.StructType([T.StructField("__n", T.LongType()), T.StructField("__fp_a", T.LongType()), T.StructField("__fp_b", T.LongType())])


def _with_prints(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs with the size and fingerprint of each row's set."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            got = features_of(texts, settings.shingle)
            return [pa.array(got[c]) for c in ("n_shingles", "fp_a", "fp_b")]

        return run

    return add_columns(docs, make, ["text"], PRINTS)


def keep_one_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs (any columns) with one document of each group: the one with the smallest id, once.

    Rows that share an id are judged by their sets: each that is kept stays once.
    """
    rows = truncate_lineage(_grouped(docs, settings).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", F.col("n_shingles").alias("__n"), F.col("fp_a").alias("__fp_a"), F.col("fp_b").alias("__fp_b")).distinct())
    kept = truncate_lineage(rows.select("doc_id").distinct())
    chosen = docs.join(F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept, "doc_id", "left_semi").select(*docs.columns)
    copies = truncate_lineage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if copies.take(1):  # rows that share an id
        key = ["doc_id", *PRINTS.names]
        twice = _with_prints(chosen.join(copies, "doc_id", "left_semi").select(*docs.columns), settings).join(rows, key, "left_semi").dropDuplicates(key).select(*docs.columns)
        chosen = chosen.join(copies, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_duplicates(table(spark, sf_dir, "documents"))
