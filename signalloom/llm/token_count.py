"""Token counts by a compiled finite-state transducer.

Two deterministic transducers work one behind the other. The first is the pre-tokenizer's pattern over character
classes; its transitions say where a pretoken begins (at the current or, after a look ahead, at the previous
character). Text is cut into chunks of equal length; each chunk's map from entry state to exit state is computed
for all states at once, the maps are composed by a parallel prefix scan, and a second pass from the known entry
states emits the boundaries.

The second reads the bytes of a pretoken, from its start state, and its transitions carry the change of the number
of tokens: BPE merges compiled into states. The last token of a prefix's encoding is the one token that ends there
and may follow the encoding before it, which two neighbouring tokens decide alone: they may if no merge across
their border has its turn before the merges that make the two. So a state is the longest end of the bytes read
that a token can still grow from, with the last token and the relative count at every place inside it: finitely
many. States are made when first reached and kept in a bounded table; no library merges anything. Counts of whole
pretokens are remembered (bounded) and added up by document.

Edge cases: a null text counts as empty: no bytes, no tokens. Special token strings inside a text count as one
token, as the library does by default. Very long texts are cut between two letters' words, where a boundary is
certain. Repeated rows give equal results; an empty table gives an empty one; columns of the names of new ones are
replaced.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ForcedBoundaryBPE, Memory
from .common import add_columns, codepoints, packs, table
from .words import distinct_spans

LIMIT = 1024
CHUNK = 256
MOST = 2 << 20
OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

#: Character classes: other, number, blank, other white space, apostrophe, letters by their part in the
#: contractions 's 't 'm 'd, 're 've, 'll; border of texts; first and further characters of a special token.
OTHER, NUMBER, BLANK, WHITE, QUOTE, LETTER, L_STMD, L_RV, L_E, L_L, BORDER, SPECIAL, SPECIAL_REST = range(13)
WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTERS = (LETTER, L_STMD, L_RV, L_E, L_L)
#: States: between tokens; in a run of letters, numbers or symbols; after an apostrophe that may begin a
#: contraction, and then r or v, or l; in white space, of one or more characters, the last a blank or not; in a
#: special token.
START, IN_LETTERS, IN_NUMBERS, IN_SYMBOLS, APOSTROPHE, APOSTROPHE_RV, APOSTROPHE_L, ONE_BLANK, ONE_WHITE, MORE_BLANK, MORE_WHITE, IN_SPECIAL = range(12)
STATES, CLASSES = 12, 13


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """next state and emission (1: a token begins here, 2: one began at the previous character) at class * STATES + state."""
    nxt, emit = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)
    begin = {OTHER: IN_SYMBOLS, NUMBER: IN_NUMBERS, BLANK: ONE_BLANK, WHITE: ONE_WHITE, QUOTE: APOSTROPHE, BORDER: START, SPECIAL: IN_SPECIAL, SPECIAL_REST: IN_SPECIAL} | dict.fromkeys(LETTERS, IN_LETTERS)
    for c in range(CLASSES):
        for s in range(STATES):
            to, out = begin[c], 1
            symbol, white = c in (OTHER, QUOTE), c in (BLANK, WHITE)
            if s == IN_SPECIAL and c == SPECIAL_REST:
                out = 0
            elif s == IN_LETTERS and c in LETTERS or s == IN_NUMBERS and c == NUMBER:
                out = 0
            elif s in (IN_SYMBOLS, APOSTROPHE) and symbol:
                to, out = IN_SYMBOLS, 0
            elif s == APOSTROPHE and c in (L_STMD, L_RV, L_L):
                to, out = {L_STMD: START, L_RV: APOSTROPHE_RV, L_L: APOSTROPHE_L}[c], 0
            elif s == APOSTROPHE_RV and c == L_E or s == APOSTROPHE_L and c == L_L:
                to, out = START, 0
            elif s in (APOSTROPHE_RV, APOSTROPHE_L):  # no contraction: the letter before began a word
                out = 2 if c in LETTERS else 3
            elif s in (ONE_BLANK, ONE_WHITE, MORE_BLANK, MORE_WHITE) and white:
                to, out = (MORE_BLANK if c == BLANK else MORE_WHITE), 0
            elif s in (ONE_BLANK, MORE_BLANK) and c not in (BORDER, SPECIAL, SPECIAL_REST):  # the last blank joins what follows
                to, out = (IN_SYMBOLS if symbol else begin[c]), 2 * (s == MORE_BLANK)
            elif s == MORE_WHITE and c not in (BORDER, SPECIAL, SPECIAL_REST):
                out = 3
            nxt[c, s], emit[c, s] = to, out
    return nxt.ravel(), emit.ravel()


NEXT, EMIT = transducer()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        t = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                t[c] = LETTER if k == "L" else NUMBER
        t[WHITE_SPACE] = WHITE
        t[ord(" ")], t[ord("'")], t[ord("e")], t[ord("l")] = BLANK, QUOTE, L_E, L_L
        t[[ord(x) for x in "stmd"]] = L_STMD
        t[[ord(x) for x in "rv"]] = L_RV
        _classes = t
    return _classes


def emissions(cls: np.ndarray) -> np.ndarray:
    """True where a token begins, by chunk state maps and a prefix scan over them."""
    n = len(cls)
    k = -(-n // CHUNK)
    x = np.full((k, CHUNK), BORDER, np.intp)
    x.ravel()[:n] = cls
    x = np.ascontiguousarray(x.T) * STATES
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (k, STATES))
    for t in range(CHUNK):
        maps = NEXT.take(x[t][:, None] + maps)
    d = 1
    while d < k:  # maps[i] becomes the map of chunks 0 to i
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)])
        d *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.intp)
    out = np.empty((CHUNK, k), np.uint8)
    for t in range(CHUNK):
        at = x[t] + state
        out[t] = EMIT[at]
        state = NEXT[at].astype(np.intp)
    out = out.T.ravel()[:n]
    begins = (out & 1).astype(bool)
    begins[:-1] |= (out[1:] & 2).astype(bool)
    return begins


SAFE = re.compile("[A-Za-z] [A-Za-z]")


def pieces(text: str, most: int = MOST) -> list[str]:
    """A text cut between words where a token begins for certain, into pieces of little more than `most` characters."""
    out, a = [], 0
    while len(text) - a > most and (m := SAFE.search(text, a + most)):
        out.append(text[a : m.start() + 1])
        a = m.start() + 1
    return [*out, text[a:]]


NEVER = 1 << 62


class MergeTransducer:
    """Byte-pair merges as a transducer over bytes whose transitions carry the change of the token count.

    States are numbers. `keys` says what each stands for: the bytes that a token can still grow from, and (last token,
    tokens less those by now) at each place inside. A transition is looked up at state * 256 + byte and holds the next
    state times 256 and the change plus 128, so tables hold numbers only.
    """

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], most: int = 100_000):
        self.ranks, self.most = ranks, most
        self.halves = {x + y: (x, y) for x, y in ranks}
        if len(self.halves) < len(ranks):
            raise ValueError("two merges make the same token; which one did is no matter of neighbours")
        self.tokens = {*self.halves, *(bytes([i]) for i in range(256))}
        self.open = {t[:i] for t in self.halves for i in range(1, len(t))}
        self._forget()

    def _forget(self) -> None:
        self.spines: tuple[dict, dict] = ({}, {})
        self.may: dict[bytes, bool] = {}
        self.ending: dict[bytes, tuple[tuple, int]] = {}
        self.keys: list[tuple] = [(b"", b"", 0)]
        self.states = {self.keys[0]: 0}
        self.table: dict[int, int] = {}

    def _ending(self, s: bytes) -> tuple[tuple, int]:
        """The tokens at the end of s with their places, longest first, and where what a token can grow from begins."""
        got = self.ending.get(s)
        if got is None:
            b = 0
            while b < len(s) and s[b:] not in self.open:
                b += 1
            got = self.ending[s] = tuple([(a, t) for a in range(len(s)) if (t := s[a:]) in self.tokens]), b
        return got

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token at one of its borders, smallest first, and the rank of the merge that takes each in."""
        got = self.spines[side].get(token)
        if got is None:
            got, t = [(token, NEVER)], token
            while t in self.halves:
                pair = self.halves[t]
                t = pair[side]
                got.append((t, self.ranks[pair]))
            got.reverse()
            self.spines[side][token] = got
        return got

    def follows(self, x: bytes, y: bytes) -> bool:
        """Whether token y may stand behind token x: the bytes of both give just these two. Anything may stand first."""
        if not x:
            return True
        left, right, i, j, ranks = self._spine(x, 1), self._spine(y, 0), 0, 0, self.ranks.get
        while True:
            (p, taken), (q, taken_) = left[i], right[j]
            rank = ranks((p, q), NEVER)
            if rank < taken and rank <= taken_ and rank != NEVER:  # of equal merges the one further left is first
                return False
            if taken == taken_ == NEVER:
                return True
            if taken <= taken_:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> int:
        """The transition of a state under a byte, compiled."""
        key = self.keys[state]
        ends = key[1:]  # of each place a token and a count
        s = key[0] + bytes((byte,))
        tokens, b = self._ending(s)
        for a, token in tokens:
            before = ends[2 * a]
            pair = b"%d %s%s" % (len(before), before, token)
            ok = self.may.get(pair)
            if ok is None:
                ok = self.may[pair] = self.follows(before, token)
            if ok:
                break
        change = ends[2 * a + 1] + 1
        kept = list(ends[2 * b :])
        for i in range(1, len(kept), 2):
            kept[i] -= change
        new = (s[b:], *kept, token, 0)
        to = self.states.get(new)
        if to is None:
            to = self.states[new] = len(self.keys)
            self.keys.append(new)
        got = self.table[state << 8 | byte] = to << 8 | change + 128
        return got

    def count(self, text: bytes) -> int:
        """Tokens of one pretoken."""
        if len(self.keys) >= self.most or max(len(self.may), len(self.ending), len(self.table) // 2) >= 8 * self.most:
            self._forget()
        at, n, get = 0, 0, self.table.get
        for c in text:
            got = get(at | c)
            if got is None:
                got = self._step(at >> 8, c)
            at = got & -256
            n += got & 255
        return n - 128 * len(text)


class TokenCounter:
    def __init__(self, path: str):
        self.bpe = ForcedBoundaryBPE(path)
        plain = lambda t: bytes([self.bpe.byte_of[c] for c in t])
        self.merges = MergeTransducer({(plain(x), plain(y)): r for (x, y), r in self.bpe.ranks.items()})
        self.known = Memory(self._compile)

    def _compile(self, pretoken: str) -> int:
        """Tokens that the transducers emit for this pretoken."""
        return 1 if pretoken in self.bpe.specials else self.merges.count(pretoken.encode("utf-8", "surrogatepass"))

    def _pack(self, texts: list[str]) -> np.ndarray:
        whole = "\n".join(texts) + "\n"
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        borders = np.cumsum(sizes + 1) - 1
        cls = classes()[codepoints(whole)]
        cls[borders] = BORDER
        if self.bpe.special:
            for m in self.bpe.special.finditer(whole):
                cls[m.start()] = SPECIAL
                cls[m.start() + 1 : m.end()] = SPECIAL_REST
        begins = emissions(cls)
        begins[borders] = True
        first = np.flatnonzero(begins)
        end = np.concatenate([first[1:], [len(cls)]])
        keep = cls[first] != BORDER
        first, end = first[keep], end[keep]
        b = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        lead = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
        pretokens, which = distinct_spans(b, lead[first], lead[end])
        counts = np.array(self.known.many(pretokens), np.int64)
        return np.bincount(np.searchsorted(borders, first), counts[which] if len(which) else None, len(texts)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
        rows, strings = [i for i, _ in parts], [p for _, p in parts]
        got = [self._pack(strings[a:z]) for a, z in packs(strings, MOST)]
        return np.bincount(rows, np.concatenate(got), len(texts)).astype(np.int64) if got else np.zeros(0, np.int64)


@lru_cache(1)
def counter(path: str) -> TokenCounter:
    """The worker's counter, kept for its later tasks."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than `limit` tokens) for a byte-level model."""

    def make():
        count = counter(path).count

        def run(texts: pa.Array) -> list[pa.Array]:
            ts = [t or "" for t in texts.to_pylist()]
            n = count(ts)
            return [pa.array([len(t.encode()) for t in ts], pa.int64()), pa.array(n), pa.array(n > limit)]

        return run

    return add_columns(docs, make, [text], OUT)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
