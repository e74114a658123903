"""Phrases that belong together, from word-id suffix arrays of shards.

Texts are cut into shards of about SHARD words, stored once in the shared folder as word numbers and each shard's words.
A shard's suffix array is sorted by numpy prefix doubling: ranks of one word, of two, of four, which is as far as a phrase
goes. Neighbouring suffixes share a number of words (LCP); each run that shares n or more is an LCP interval, one phrase of
n words with the interval's size as its count. Counts of all shards are merged by language and phrase.

A phrase of LEAST occurrences has only parts of so many, so three passes come before: hashes of words, of pairs of such
words, of triples of such pairs are counted, and the phrases of the suffix arrays that are known by these, or of four words
with both triples known, go into the merge. What a pass lets through reaches the tasks as a bitmap of hashes, of
up to MAP_BITS bits (32 MB) whatever the corpus. A bitmap only lets too much through, never too little, and the
final counts are by the phrases themselves, so results are exact at any size; beyond MAP_BITS / 8 frequent runs of one length
the passes merely carry more rows.

Scores compare a phrase with the two parts of each cut; the lowest counts. A part has at least the phrase's count, so all
parts are in the merged table. Parts that many phrases share are looked up by broadcast (`skew.lookup`). A
language's first TOP are found in slices by hash first, so that no task sorts a language.

Edge cases: null or empty text has no words; a null lang is `und`, together with documents that say so; a word is any
run of bytes without the separators, of any length; repeated rows count each; null and repeated ids don't matter; ties of
score and count go by the phrase's UTF-8 bytes, which no two phrases of a language share; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, mix64, release_memory, table, truncate_lineage
from .skew import lookup
from .words import distinct_spans, span_hashes, string_bytes

LEAST, TOP, LONGEST, SHARE = 30, 2000, 4, 80
#: Words of a shard; texts are never cut, so one shard can be longer by a text.
SHARD = 1 << 20
MAP_BITS = 1 << 28
#: Bits of a hash that is only to be counted, and hashes that a task gathers before it sends them.
HASH_BITS, PENDING = 48, 3 << 20
#: Phrases that one task ranks at first.
SLICE = 50_000
UND = "und"
#: Bytes that end a piece, and those between its words.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"

KIND = np.zeros(256, np.int8)
KIND[list(BLANKS)], KIND[list(PIECE_ENDS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SHARDS = T.StructType([T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("of", T.BinaryType()), T.StructField("ids", T.BinaryType())])


def word_runs(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, and of each occurrence its word, its text, and whether it follows on the one before
    in the same piece."""
    b, offsets = string_bytes(texts)
    b = LOWER[b]
    kind = KIND[b]
    edge = np.zeros(len(b) + 1, bool)  # texts end words and pieces too
    edge[offsets] = True
    inside = kind == 0
    before = np.concatenate([[False], inside[:-1]]) if len(b) else inside
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(b) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    words, code = distinct_spans(b, first, end)
    text = np.searchsorted(offsets, first, "right") - 1
    ends = np.concatenate([[0], np.cumsum(kind == 2)])
    follows = np.zeros(len(first), bool)
    follows[1:] = (text[1:] == text[:-1]) & (ends[first[1:]] == ends[first[:-1]])
    return words, code, text, follows


class Shard:
    """Words by language, numbered as they come, and the sequence of numbers with -1 between pieces."""

    def __init__(self):
        self.number: dict[tuple[str, bytes], int] = {}
        self.ids: list[np.ndarray] = []
        self.length = 0

    def add(self, langs: pa.Array, texts: pa.Array) -> None:
        words, code, text, follows = word_runs(texts)
        if not len(code):
            return
        coded = langs.fill_null(UND).dictionary_encode()
        names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()[text].astype(np.int64)
        keys, at = np.unique(lang * len(words) + code, return_inverse=True)
        own = np.array([self.number.setdefault((names[k // len(words)], words[k % len(words)]), len(self.number)) for k in keys.tolist()], np.int32)
        places = np.arange(len(code)) + np.cumsum(~follows)  # a break before each piece
        ids = np.full(int(places[-1]) + 1, -1, np.int32)
        ids[places] = own[at]
        self.ids.append(ids)
        self.length += len(code)

    def row(self) -> pa.RecordBatch:
        langs: dict[str, int] = {}
        of = np.array([langs.setdefault(lang, len(langs)) for lang, _ in self.number], np.int32)
        words = pa.array([w for _, w in self.number], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays([0, len(v)], v) for v in (pa.array(list(langs), pa.string()), words)]
        data = [pa.array([x.tobytes()], pa.binary()) for x in (of, np.concatenate([*self.ids, np.full(1, -1, np.int32)]))]
        return pa.RecordBatch.from_arrays([*lists, *data], names=SHARDS.names)


def shards_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    src = docs.select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").cast("string").alias("t"))
    bound_batches(docs.sparkSession)
    most = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            shard.add(b.column(0), b.column(1))
            if shard.length >= most:
                yield shard.row()
                shard = Shard()
        if shard.length:
            yield shard.row()
        release_memory()

    return src.mapInArrow(run, SHARDS)


def word_hashes(langs: pa.Array, words: pa.Array, of: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with its language."""
    parts = []
    for a in (words, langs):
        b, o = string_bytes(a)
        parts.append(span_hashes(b, o[:-1], o[1:]))
    return mix64(parts[0] + mix64(parts[1].copy())[of])


def gram_hashes(h: np.ndarray, ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, .. `longest` words from each place on; meaningless where one is missing."""
    out = [h[ids]]
    for n in range(1, longest):
        out.append(mix64(mix64(out[-1][:-1] + np.uint64(n)) ^ out[0][n:]))
    return out


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """langs, words, the language of each word, and the sequence of each shard."""
    for i in range(b.num_rows):
        of, ids = (np.frombuffer(b.column(k)[i].as_py(), np.int32) for k in (2, 3))
        yield b.column(0)[i].values, b.column(1)[i].values, of, ids


# --- what is frequent

COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("f", T.LongType())])


def language_sizes(shards: DataFrame) -> DataFrame:
    """(lang, n): all words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, _, of, ids in unpacked(b):
                n = np.bincount(of[ids[ids >= 0]], minlength=len(langs))
                yield pa.RecordBatch.from_arrays([langs, pa.array(n)], names=["lang", "n"])

    return shards.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def bitmap(spark: SparkSession, hashes: DataFrame, count: int):
    """A broadcast of bits at the hashes of a long column, 32 for each of `count` and MAP_BITS at most."""
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(16, (32 * count).bit_length()))
    place = F.col(hashes.columns[0]).bitwiseAND(bits - 1)
    parts = hashes.select(F.shiftright(place, 16).alias("part"), place.bitwiseAND(65535).cast("int").alias("bit"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        on = np.zeros(65536, bool)
        on[t.column("bit").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "on": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for part, on in parts.distinct().groupBy("part").applyInArrow(run, "part long, on binary").toLocalIterator():  # MAP_BITS / 8 bytes
        out[part * 8192 : (part + 1) * 8192] = np.frombuffer(on, np.uint8)
    return spark.sparkContext.broadcast(out)


def known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (keys_of(h) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


PACKED = T.StructType([T.StructField("part", T.LongType()), T.StructField("steps", T.BinaryType()), T.StructField("f", T.BinaryType())])


def keys_of(h: np.ndarray) -> np.ndarray:
    """The HASH_BITS highest bits of 64-bit hashes."""
    return h >> np.uint64(64 - HASH_BITS)


def narrowed(v: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest takes, behind that number."""
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(b: bytes) -> np.ndarray:
    v = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(v), 8), np.uint8)
    out[:, : b[0]] = v
    return out.view("<u8").ravel()


def summed(h: list[np.ndarray], f: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order with the sums of their counts."""
    h, f = np.concatenate(h), np.concatenate(f)
    by = np.argsort(h)
    h, f = h[by], f[by]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(f, first) if len(first) else f


def packed(h: np.ndarray, f: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes and counts in a row for each value of their `bits` highest bits: the first hash and the steps to the others."""
    part = (h >> np.uint64(HASH_BITS - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), part[1:] != part[:-1]]))
    edges = list(zip(first.tolist(), np.append(first[1:], len(h)).tolist()))
    steps = [narrowed(np.diff(h[a:z], prepend=part[a].astype(np.uint64) << np.uint64(HASH_BITS - bits))) for a, z in edges]
    return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(steps, pa.binary()), pa.array([narrowed(f[a:z]) for a, z in edges], pa.binary())], names=PACKED.names)


def frequent_hashes(shards: DataFrame, n: int, least: int, words: int, shorter=None) -> DataFrame:
    """(h): hashes of runs of n words, whose runs of n - 1 words are known, with `least` occurrences together.

    Counted by task, then by range of hashes; a range is sent as one packed row, and there are so many that one holds about a
    million of the corpus's words.
    """
    bits, most = max(8, (words >> 20).bit_length()), PENDING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, fs, size = [], [], 0
        for b in batches:
            for langs, vocabulary, of, ids in unpacked(b):
                grams = gram_hashes(word_hashes(langs, vocabulary, of), ids, n)
                sound = np.ones(len(grams[-1]), bool)
                for k in range(n):
                    sound &= ids[k : k + len(sound)] >= 0
                if n > 1:
                    at = np.flatnonzero(sound)
                    sound[at] = known(shorter.value, grams[-2][at]) & known(shorter.value, grams[-2][at + 1])
                found, f = np.unique(keys_of(grams[-1][sound]), return_counts=True)
                del grams
                hs, fs, size = [*hs, found], [*fs, f], size + len(found)
                if size >= most:
                    yield packed(*summed(hs, fs), bits)
                    hs, fs, size = [], [], 0
        if size:
            yield packed(*summed(hs, fs), bits)
        release_memory()

    def often(t: pa.Table) -> pa.Table:
        start = np.uint64(t.column("part")[0].as_py()) << np.uint64(HASH_BITS - bits)
        hs = [np.cumsum(widened(b), dtype=np.uint64) + start for b in t.column("steps").to_pylist()]
        h, f = summed(hs, [widened(b).astype(np.int64) for b in t.column("f").to_pylist()])
        return pa.table({"h": pa.array(h[f >= least].astype(np.int64))})

    return shards.mapInArrow(run, PACKED).groupBy("part").applyInArrow(often, "h long")


# --- suffix arrays


def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b) of numbers from -1 up."""
    _, at = np.unique((a.astype(np.int64) + 1) * (int(b.max(initial=-1)) + 2) + b + 1, return_inverse=True)
    return at


def behind(r: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([r[k:], np.full(min(k, len(r)), -1, r.dtype)])


def suffix_array(ids: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first `longest` words (a break ends them), and how many of these each shares with the
    one before; breaks are -1."""
    n, k, r = len(ids), 1, ids.astype(np.int64)
    while k < longest:
        r = ranks(r, np.where(r < 0, -1, behind(r, k)))
        if k == 1:
            r[ids < 0] = -1
        k *= 2
    sa = np.argsort(r, kind="stable")
    lcp, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for k in range(longest):
        w = behind(ids, k)[sa]
        same &= (w[1:] == w[:-1]) & (w[1:] >= 0)
        lcp[1:] += same
    return sa, lcp


def intervals(ids: np.ndarray, sa: np.ndarray, lcp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct phrase of n words, and its count."""
    first = np.flatnonzero(lcp < n)
    size = np.diff(np.append(first, len(sa)))
    at, whole = sa[first], np.ones(len(first), bool)
    for k in range(n):
        whole &= behind(ids, k)[at] >= 0
    return at[whole], size[whole]


def phrase_counts(shards: DataFrame, maps: list) -> DataFrame:
    """(lang, phrase, words, f) of each shard's phrases that may be frequent: known themselves, by maps[n - 1], up to
    len(maps) words, and of one word more where both shorter ones are."""
    longest = len(maps) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, words, of, ids in unpacked(b):
                grams = gram_hashes(word_hashes(langs, words, of), ids, longest - 1)
                linked = (ids[:-1] >= 0) & (ids[1:] >= 0)
                linked[linked] = known(maps[1].value, grams[1][linked])
                left, right = np.append(linked, False), np.concatenate([[False], linked])
                at = np.flatnonzero(left | right)  # the words of any known pair, with a break where two aren't one
                places = np.arange(len(at)) + np.cumsum(~right[at])
                kept, origin = np.full(int(places[-1]) + 2 if len(at) else 1, -1, np.int32), np.zeros(int(places[-1]) + 2 if len(at) else 1, np.int64)
                kept[places], origin[places] = ids[at], at
                sa, lcp = suffix_array(kept, longest)
                f = np.bincount(ids[ids >= 0], minlength=len(words))
                one = np.flatnonzero(known(maps[0].value, word_hashes(langs, words, of)))
                yield from phrase_rows(langs, of[one], words.take(pa.array(one)), 1, f[one])
                for n in range(2, longest + 1):
                    first, f = intervals(kept, sa, lcp, n)
                    k = min(n, longest - 1)
                    own = grams[k - 1][origin[first]]
                    sound = known(maps[k - 1].value, own)
                    if n > k:
                        sound &= known(maps[k - 1].value, grams[k - 1][origin[first] + 1])
                    first, f = first[sound], f[sound]
                    parts = [words.take(pa.array(kept[first + k])) for k in range(n)]
                    yield from phrase_rows(langs, of[kept[first]], pa.compute.binary_join_element_wise(*parts, " "), n, f)
        release_memory()

    return shards.mapInArrow(run, COUNTS)


def phrase_rows(langs: pa.Array, of: np.ndarray, phrases: pa.Array, n: int, f: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(f), most):
        k = len(f[a : a + most])
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(of[a : a + k])), phrases[a : a + k], pa.array(np.full(k, n, np.int32)), pa.array(f[a : a + k], pa.int64())], names=COUNTS.names)


# --- scores


def wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(table_: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words or more; table_: (lang, phrase, words, f) with all parts."""
    word = F.split("phrase", " ", -1)
    cut = lambda i: F.struct(
        i.alias("k"), F.array_join(F.slice(F.col("w"), F.lit(1), i), " ").alias("left"), F.array_join(F.slice(F.col("w"), i + 1, F.col("words") - i), " ").alias("right")
    )
    phrases = table_.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), word.alias("w"))
    cuts = phrases.select("lang", "phrase", "words", "a", F.inline(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)))
    f = table_.select("lang", "phrase", "f")
    cuts = truncate_lineage(lookup(cuts, f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]))
    cuts = lookup(cuts, f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(cast(a AS decimal(20,0)) * 2000000 AS decimal(38,0)) div cast(l + r AS decimal(38,0))")
    low = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(low).select("lang", "phrase", "words", "a", "low.l", "low.r", "low.score")


def contained(table_: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the greatest count of a longer phrase that holds the phrase, for those held by any."""
    w = F.split("phrase", " ", -1)
    longer = table_.filter("words > 2").select("lang", "f", "words", w.alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    parts = longer.select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    spark = docs.sparkSession
    shards = truncate_lineage(shards_of(docs, text, lang))
    total = truncate_lineage(language_sizes(shards))
    words = total.agg(F.sum("n")).first()[0] or 0
    maps: list = []
    for n in range(1, LONGEST):
        often = truncate_lineage(frequent_hashes(shards, n, least, words, maps[-1] if maps else None))
        maps.append(bitmap(spark, often, often.count()))
    phrases = phrase_counts(shards, maps).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    found = truncate_lineage(phrases.filter(F.col("f") >= least))
    held = contained(found)
    kept = scored(found).join(held, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * SHARE))
    kept = truncate_lineage(kept.drop("words", "longest"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    slices = max(16, min(kept.count() // SLICE, 512))
    best = kept.withColumn("__s", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__s").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    # one row for each language, by shuffle or broadcast as its size says
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
