"""Language identification by language-bitmask n-gram filters.

Each slot of one bit-sliced Bloom filter has a bit per language, in one word or, for more than 64 languages, in
several. Looking up a character trigram
ANDs the words at its hash positions, which gives all languages whose trigram set holds it at once. Per
language the set bits are counted over the whole text and corrected for the filter's false positives; the
largest corrected count decides.

Edge cases: a null text or one without a letter gives `und` and score 0; texts with letters always get a
learned language (ties: the first in sorted order), `und` only if nothing was learned. Repeated rows give
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACK_CHARS, add_columns, codepoints, fold_of, map_batches, share_of_hash, table, truncate_lineage

#: Expected training documents per language; a language with fewer gives them all.
TRAIN_DOCS = 2000
#: A trigram belongs to a language if it makes up this share of the language's trigrams, and this part of the
#: share in the language where it is commonest. The first bounds what is collected: 1 / MIN_SHARE a language.
MIN_SHARE = 2e-5
MIN_PART = 0.05
HASHES = 3
UND = "und"
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point to its lower-case letter; 32 for anything that is no letter."""
    global _letters
    if _letters is None:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the trigram round each character but the outer two, and whether its middle is a letter."""
    low = letters()[codepoints(text)].astype(np.uint64)
    h = low[:-2] * np.uint64(0x9E3779B97F4A7C15) + low[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + low[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, low[1:-1] != 32


def segments(texts: list[str | None], most: int = PACK_CHARS):
    """Lists of (row, piece): pieces of at most `most` characters and the two that a trigram needs besides.

    A text stands between double spaces, so its first and last letter have a trigram of their own.
    """
    out, size = [], 0
    for i, t in enumerate(texts):
        t = f"  {t or ''}  "
        for a in range(0, len(t) - 2, most):
            piece = t[a : a + most + 2]
            if out and size + len(piece) > most:
                yield out
                out, size = [], 0
            out.append((i, piece))
            size += len(piece)
    if out:
        yield out


def trigrams_of(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and letter flags of the pieces' trigrams, and where each piece begins; none that spans two pieces counts."""
    ends = np.cumsum([len(p) for _, p in pieces])
    h, ok = trigrams("".join(p for _, p in pieces))
    ok[ends[:-1] - 2] = ok[ends[:-1] - 1] = False
    return h, ok, np.concatenate([[0], ends[:-1]])


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    words: np.ndarray  # words a slot x a power of two of slots
    false_rate: np.ndarray  # per language, from the share of set bits

    @staticmethod
    def build(languages: list[str], grams: np.ndarray, language: np.ndarray) -> LanguageFilter:
        """Of pairs (trigram hash, index of its language)."""
        bits = max(12, math.ceil(math.log2(max(1, len(grams)) * 8)))
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(64, len(languages)) <= n)
        words = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), kind)
        for s in slots(grams, bits):
            np.bitwise_or.at(words, (language // 64, s), kind(1) << (language % 64).astype(kind))
        full = np.array([np.count_nonzero(words[i // 64] & (kind(1) << kind(i % 64))) for i in range(len(languages))], float) / (1 << bits)
        return LanguageFilter(tuple(languages), words, full**HASHES)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Bits of all languages that hold each trigram: words a slot x trigrams."""
        first, *rest = slots(h, int(self.words.shape[1]).bit_length() - 1)
        got = self.words[:, first]
        for s in rest:
            got &= self.words[:, s]
        return got

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        hits, total, has = np.zeros((n, max(1, k))), np.zeros(n), np.zeros(n, bool)
        for pieces in segments(texts):
            h, ok, starts = trigrams_of(pieces)
            rows = np.fromiter((i for i, _ in pieces), np.int64, len(pieces))
            total += np.bincount(rows, np.add.reduceat(ok, starts, dtype=np.int64), n)
            got = self.languages_of(h)
            got *= ok
            for j in range(k):
                hits[:, j] += np.bincount(rows, np.add.reduceat((got[j // 64] >> got.dtype.type(j % 64)) & got.dtype.type(1), starts, dtype=np.int64), n)
        has = total > 0
        if not k:
            return [UND] * n, np.zeros(n)
        fixed = (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)
        best = fixed.argmax(1)
        score = np.clip(fixed[np.arange(n), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if x else UND for b, x in zip(best, has)], np.where(has, score, 0.0)


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES positions by double hashing."""
    a, b = h, (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64((1 << bits) - 1)).astype(np.intp) for i in range(HASHES)]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageFilter:
    """Learn from the columns text and lang of docs; doc_id only chooses the sample.

    The sample is about train_docs documents of each language, by a hash of doc_id. Trigram counts are
    aggregated on the executors; at most 1 / MIN_SHARE trigrams a language come to the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilter.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    langs = sorted(counts)
    fraction = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, train_docs / counts[g]))])[F.col("lang")]
    sample = known.filter(share_of_hash("doc_id", fraction, 7)).select("lang", "text")

    def make():
        def count(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            ls, ts = np.array(b.column(0).to_pylist()), np.array(b.column(1).to_pylist(), object)
            for g in sorted(set(ls)):
                for pieces in segments(list(ts[ls == g])):
                    h, ok, _ = trigrams_of(pieces)
                    u, c = np.unique(h[ok], return_counts=True)
                    out["lang"] += [g] * len(u)
                    out["gram"].append(u.view(np.int64))
                    out["n"].append(c)
            return out | {k: np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("gram", "n")}

        return count

    grams = map_batches(sample, make, T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]))
    grams = truncate_lineage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")))  # read twice below
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter.build(langs, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    total = F.create_map(*[F.lit(x) for g in totals for x in (g, float(totals[g]))])[F.col("lang")]
    rows = grams.withColumn("share", F.col("n") / total).filter(F.col("share") >= MIN_SHARE).select("lang", "gram", "share").toPandas()
    top = rows.groupby("gram")["share"].transform("max")
    rows = rows[rows["share"] >= MIN_PART * top].sort_values(["lang", "gram"])
    where = {g: i for i, g in enumerate(langs)}
    return LanguageFilter.build(langs, rows["gram"].to_numpy().view(np.uint64), rows["lang"].map(where).to_numpy(np.int64))


def predict_language(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the share of trigrams that the language holds, false positives taken off)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(t: pa.Array) -> list[pa.Array]:
            lang, score = shared.value.predict(t.to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score)]

        return run

    return add_columns(docs, make, [text], OUT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of("doc_id", 3)
    model = fit(docs.filter(held != 1).select("doc_id", "text", "lang"))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
