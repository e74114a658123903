"""Byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so every such pair marks a
certain cut. White space pairs cut a whole text into chunks; inside a chunk the pre-tokenizer's pattern and
the forced pairs cut further. The fragments are encoded independently, remembered in a bounded memory, and
concatenated; the ids equal those of the tokenizers library.

Edge cases: a null text counts as empty and gives no ids, an empty decoded text and their digests. Special
token strings inside a text are matched on the raw text, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import add_columns, table
from .words import Segment, segments, separators, spread, string_bytes

#: Chunks remembered in each of two generations, and the longest one that is remembered.
MEMORY = 150_000
LONGEST = 64
#: The pattern of the byte-level pre-tokenizer where its file names none.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OUT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


class Memory:
    """fn's values by key; two generations of at most `most` keys, so that size is bounded and hot keys stay."""

    def __init__(self, fn: Callable, most: int = MEMORY):
        self.fn, self.most, self.new, self.old = fn, most, {}, {}

    def many(self, keys: list[bytes]) -> list:
        """The values of distinct keys."""
        if len(self.new) + len(keys) > self.most:
            self.new, self.old = {}, self.new
        new, old, fn = self.new, self.old.get, self.fn
        out = list(map(new.get, keys))
        for i, value in enumerate(out):
            if value is None:
                k = keys[i]
                value = old(k)
                if value is None:
                    value = fn(k.decode("utf-8", "surrogatepass"))
                out[i] = value
                if len(k) <= LONGEST:
                    new[k] = value
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """A BPE model read from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the library sets special strings apart before it normalises
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.folds = bool(spec["normalizer"])  # NFC, runs of white space to one space, lower case
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.pattern = regex.compile(next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL_PATTERN))
        self.byte_decoder = spec["decoder"] is not None
        self.letters = byte_letters()
        self.byte_of = {ch: b for b, ch in enumerate(self.letters)}
        self.joint = self._joint_pairs()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model  # merges a fragment that ends a word, or any if words have no end mark

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        """Merges by rank; read when a fragment is first merged here."""
        with open(self.path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        return {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(merges)}

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in {**self.vocab, **self.specials}.items()}

    def _joint_pairs(self) -> frozenset[str]:
        """The byte pairs that occur inside some vocabulary token, in byte letters; any other pair is a forced boundary."""
        inside = set()
        for t in self.vocab:
            t = t.removesuffix(self.suffix) if self.suffix else t
            inside.update(map(add, t, t[1:]))
        return frozenset(inside)

    def encode_fragment(self, s: str, ends: bool) -> list[int]:
        """Ids of one fragment in byte letters; `ends`: it ends a word."""
        if ends or not self.suffix:
            return [t.id for t in self.model.tokenize(s)]
        parts = list(s)
        parts = self._merge_short(parts) if len(parts) <= 100 else self._merge_long(parts)
        return [self.vocab[p] for p in parts]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """Merge the leftmost pair of the lowest rank until none is left; quadratic."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (r := min(ranks)) != none:
            i = ranks.index(r)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap over a linked list, for fragments without end."""
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, x, y = heappop(heap)
            j = after[i] if parts[i] == x else n
            if j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get((parts[i], parts[after[i]]))) is not None:
                    heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (r := get((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def fragments(self, s: str) -> list[str]:
        """A pretoken in byte letters cut at every forced boundary."""
        inside = self.joint.__contains__
        if all(map(inside, map(add, s, s[1:]))):
            return [s]
        cuts = [i + 1 for i, pair in enumerate(map(add, s, s[1:])) if not inside(pair)]
        return [s[i:j] for i, j in zip([0, *cuts], [*cuts, len(s)])]

    def pretokens(self, part: str) -> list[str]:
        """Pretokens in byte letters; the library's own normaliser and pattern wherever Unicode tables matter."""
        if self.folds and part.isalpha() and max(part) <= "\u00ff":
            part = part.lower()
            return [part if part.isascii() else "".join([self.letters[x] for x in part.encode()])]
        if part.isascii() and part.isprintable() and not (self.folds and " " in part):
            return [p.replace(" ", self.letters[32]) for p in self.pattern.findall(part.lower() if self.folds else part)]
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a stretch of text whose ends are certain cuts."""
        if self.folds and chunk.isascii() and chunk.isalpha():  # one plain word, most often without a forced boundary
            s = chunk.lower()
            if all(map(self.joint.__contains__, map(add, s, s[1:]))):
                return [t.id for t in self.model.tokenize(s)]
        ids: list[int] = []
        parts = self.special.split(chunk) if self.special and self.special.search(chunk) else [chunk]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.specials[part])
            elif part:
                for pretoken in self.pretokens(part):
                    *inner, last = self.fragments(pretoken)
                    for f in inner:
                        ids += self.encode_fragment(f, False)
                    ids += self.encode_fragment(last, True)
        return ids

    def encode_whole(self, chunk: str) -> list[int]:
        """The same ids without cutting pretokens further: the library's model merges each as a whole."""
        if self.folds and chunk.isascii() and chunk.isalpha():
            return [t.id for t in self.model.tokenize(chunk.lower())]
        if self.special and self.special.search(chunk):
            return self.encode_chunk(chunk)
        return [t.id for p in self.pretokens(chunk) for t in self.model.tokenize(p)]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens kept: without a decoder, tokens between single spaces."""
        if not self.byte_decoder:
            return " ".join([self.tokens[i] for i in ids])
        return bytes(self.byte_of[ch] for i in ids for ch in self.tokens[i]).decode("utf-8", "replace")


#: White space bytes; no vocabulary token of a model without white space holds one, so each is a certain cut.
BLANKS = separators([9, 10, 13, 32])


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


def forced_cuts(bpe: ForcedBoundaryBPE) -> np.ndarray:
    """256 x 256: pairs of ASCII bytes that no vocabulary token holds and between which a pretoken ends for certain.

    That is so between a letter and anything else, and beside a digit; between two other signs the pattern of
    contractions may reach across.
    """
    ch = [chr(c).lower() if bpe.folds else chr(c) for c in range(128)]
    cut = np.zeros((256, 256), bool)
    for x in range(33, 127):
        for y in range(33, 127):
            sure = ch[x].isalpha() != ch[y].isalpha() or ch[x].isdigit() or ch[y].isdigit()
            cut[x, y] = sure and ch[x] + ch[y] not in bpe.joint
    return cut.ravel()


class WordSplitter:
    """Segments of texts cut at every forced boundary, for models whose vocabulary has no white space."""

    def __init__(self, bpe: ForcedBoundaryBPE):
        if any(bpe.letters[32] in pair for pair in bpe.joint):
            raise ValueError("the vocabulary has tokens with a space inside; its texts can't be cut at spaces")
        self.cut, self.specials = forced_cuts(bpe), [t.encode() for t in bpe.specials]

    def __call__(self, texts: pa.Array) -> Iterator[Segment]:
        for s in segments(*string_bytes(texts), BLANKS):
            here = np.zeros(len(s.b), bool)
            here[1:] = self.cut[(s.b[:-1].astype(np.uint16) << 8) | s.b[1:]]
            here[s.first] = False  # no cut where a text or a word begins anyway
            data = s.b.tobytes()
            for t in self.specials:
                at = data.find(t)
                while at >= 0:
                    here[at + 1 : at + len(t)] = False
                    at = data.find(t, at + len(t))
            at = np.flatnonzero(here)
            which = np.searchsorted(s.first, at, "right")
            yield Segment(s.b, np.insert(s.first, which, at), np.insert(s.end, which - 1, at), np.insert(s.doc, which, s.doc[which - 1]))


def flat(parts: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """All parts as one array, and their sizes in items."""
    item = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.array(list(map(len, parts)), np.int64) // item


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and the digests of the ids and of the decoded text, for a model without white space."""

    def make():
        bpe = ForcedBoundaryBPE(path)
        split, tokens = WordSplitter(bpe), {i: f" {t}".encode() for i, t in bpe.tokens.items()}

        def encode(fragment: str) -> tuple[bytes, bytes]:
            """Ids, and the decoded text with a blank before each token: the model has no decoder."""
            ids = bpe.encode_chunk(fragment)
            return pack(ids), b"".join([tokens[i] for i in ids])

        known = Memory(encode)

        def run(texts: pa.Array) -> list[pa.Array]:
            n = np.zeros(len(texts), np.int64)
            ids_of, text_of = ([hashlib.sha256() for _ in range(len(texts))] for _ in range(2))
            for s in split(texts):
                chunks, which = s.distinct()
                got = known.many(chunks)
                ids, id_ends = spread(*flat([g[0] for g in got], "<u4"), which)
                out, out_ends = spread(*flat([g[1] for g in got], np.uint8), which)
                docs, at = np.unique(s.doc, return_index=True)
                for d, i, j in zip(docs.tolist(), at.tolist(), [*at[1:].tolist(), len(s.doc)]):
                    a, z = (id_ends[i - 1] if i else 0), id_ends[j - 1]
                    ids_of[d].update(ids[a:z])
                    x, y = (out_ends[i - 1] if i else 0), out_ends[j - 1]
                    if z > a:  # each fragment's text begins with a blank, which the first one of a document lacks
                        text_of[d].update(out[x + (n[d] == 0) : y])
                    n[d] += z - a
            return [pa.array(n), pa.array([h.hexdigest() for h in ids_of], pa.string()), pa.array([h.hexdigest() for h in text_of], pa.string())]

        return run

    return add_columns(docs, make, [text], OUT)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
