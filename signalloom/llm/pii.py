"""Personal data with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it stands. Then a cascade of transducers
normalises disguises - look-alike characters and invisible ones, character references, spelled digits, bracketed
and spelled at and dot - while each normalised character keeps the source span it came from. The same detectors
run over the normalised text and their spans are mapped back; a span is added unless a base span of its kind
holds it already. Base spans always stay.

n_email, n_ip, n_card and n_phone count the base spans; `spans` lists base and added ones.

A spelled address needs a spelled dot of the language of its at, a first domain label that is no article or
pronoun, and a last one of letters that is no other small word: `look at the dot on it` is prose. Behind a spelled
at alone the last label is a common or a country's one, in the case of the first: `at home.Then` is prose too.

Edge cases: a null text counts as empty: no spans, the digest of the empty string. All scans are linear in the
text, whatever it repeats. Offsets are code points, ends exclusive. Repeated rows give equal results; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import add_columns, table

KINDS = ("email", "ip", "card", "phone")
OUT = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])
Span = tuple[int, int]

# ---- detectors ---------------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(t: str) -> list[Span]:
    """Leftmost non-overlapping; each candidate hangs on one @, so none is tried twice."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        head = t[free:at]
        start = free + len(head.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(t, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # no local part reaches over an @
        at = t.find("@", free)
    return out


def ips(t: str) -> list[Span]:
    """In a run of numbers between dots, each four numbers in turn."""
    out = []
    for m in DOTTED.finditer(t):
        parts = m.group().split(".")
        a = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            z = a + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
                out.append((a, z))
            a = z + 1
    return out


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def cards(t: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(t) if 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d)]


def phones(t: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(t) if 8 <= sum(map(str.isdigit, m.group())) <= 15]


def identifiers(t: str) -> dict[str, list[Span]]:
    digits = DIGIT.search(t) is not None
    return {
        "email": emails(t) if "@" in t else [],
        "ip": ips(t) if digits else [],
        "card": cards(t) if digits else [],
        "phone": phones(t) if digits and "+" in t else [],
    }


# ---- transducers -------------------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏьгпΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνικατυγıɑɡ",
        "ABESIJKMHOPCTYXaesijopcyxdqwhlbrnABEZHIKMNOPTYXopvikatuyiag",
    )
)
# Invisible characters; dashes; dots; at signs.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
DASHES = "‐‑‒–—―−﹘﹣"
DOTS = "․。｡·∙⋅⸱"
BLANKS = "               　"


def _characters() -> dict[str, str]:
    """Each disguised character and what it stands for: the fixed look-alikes, and all characters that Unicode
    gives a decimal value or decomposes, for compatibility, to one ASCII character."""
    t = {}
    for c in range(0x80, 0x1FC00):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or ch in "ªº²³¹":
            continue
        plain = unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch).startswith("<") else ""
        if (d := unicodedata.decimal(ch, None)) is not None:
            t[ch] = str(d)
        elif len(plain) == 1 and "!" <= plain <= "~":
            t[ch] = plain
    return t | LOOK_ALIKES | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(DASHES, "-") | dict.fromkeys(DOTS, ".") | dict.fromkeys(BLANKS, " ")


CHARACTERS = _characters()


def _class(chars: set[str]) -> str:
    """A character class of ranges."""
    out, codes = [], sorted(map(ord, chars))
    a = 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(f"{re.escape(chr(codes[a]))}-{re.escape(chr(codes[i - 1]))}")
            a = i
    return "[" + "".join(out) + "]"


DISGUISED = re.compile(_class(set(CHARACTERS)))
# Spelled digits and signs.
_numbers = (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
)
DIGITS = {w: str(i) for row in _numbers for i, w in enumerate(row.split())} | {"zwo": "2", "fuenf": "5"}
# Spelled at signs with the dots of their languages.
AT_DOTS = {"at": ("dot", "punkt", "punto"), "arroba": ("punto", "dot"), "arobase": ("point", "dot")}
AT_WORDS, DOT_WORDS = r"(?:arroba|arobase|at)", r"(?:dot|punto|point|punkt)"
# Last labels behind an undisguised dot, beside all of two letters.
GENERIC = frozenset("com org net edu gov mil int info biz name app dev shop xyz online site test example invalid local".split())
# Words that begin no domain, and words that end none unless a country has them as its name.
ARTICLES = frozenset("the a an one this that these those each every any some no his her its my your our their which what all el la los las un una le les une des der die das ein eine".split())
SMALL_WORDS = frozenset("the an and or of on was were with for from that this these those not but if so then than when where who which what his her their its our your my are has had have will would can could may i he she we they you".split())

REFERENCE = re.compile(r"&#0*64;|&#[xX]0*40;|&commat;|%40|&#0*46;|&#[xX]0*2[eE];|&period;")
_word = "|".join(sorted(DIGITS, key=len, reverse=True))  # `uno` before `un`
_element = rf"(?:{_word}|[0-9]++)"
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|más)[ -])?{_element}(?:[ ,()-]{{1,2}}(?:{DOT_WORDS}[ -])?{_element}){{3,}}(?![A-Za-z0-9])", re.I)
SPELLED_PART = re.compile(rf"(?:plus|más)[ -]|[ ,()-]{{1,2}}(?:{DOT_WORDS}[ -])?|{_word}|[0-9]+", re.I)
BRACKETED = re.compile(rf"[\[({{<][ \t]*+(?:(?P<at>{AT_WORDS}|@)|{DOT_WORDS}|\.)[ \t]*+[\])}}>][ \t]*+", re.I)
DOT_BETWEEN_NUMBERS = re.compile(rf"(?<=[0-9])[ \t]++{DOT_WORDS}[ \t]++(?=[0-9])", re.I)
#: A spelled or spaced at; behind it labels with spelled and other dots between them; the dots inside those.
SPELLED_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ \t]++(?:{AT_WORDS}[ \t]++|@[ \t]*+)|_{AT_WORDS}_|-{AT_WORDS}-|@[ \t]*+)", re.I)
LABELS = re.compile(rf"[A-Za-z0-9-]++(?:(?:[ \t]++{DOT_WORDS}[ \t]++|_{DOT_WORDS}_|\.)[A-Za-z0-9-]++)*+", re.I)
LABEL_DOT = re.compile(rf"[ \t]++{DOT_WORDS}[ \t]++|_{DOT_WORDS}_|-{DOT_WORDS}-(?=[A-Za-z0-9])|\.", re.I)
LOCAL_PART, BLANK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789%+-"), " \t"


class Mapped:
    """A text whose every character knows the source span it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32) if start is None else start
        self.end = self.start + 1 if end is None else end

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With each [a, z) replaced; edits ascend and don't overlap."""
        if not edits:
            return self
        text, at = [], 0
        for a, z, new in edits:
            text += [self.text[at:a], new]
            at = z
        text.append(self.text[at:])
        first, last = (np.array([e[i] for e in edits]) for i in (0, 1))
        n = np.array([len(e[2]) for e in edits])
        gone = np.zeros(len(self.text) + 1, np.int8)
        gone[first] += 1
        gone[last] -= 1
        kept = np.cumsum(gone[:-1], dtype=np.int8) == 0
        put = np.repeat(first - (np.cumsum(last - first) - (last - first)), n)  # among the characters that stay
        start, end = (np.insert(x[kept], put, np.repeat(v, n)) for x, v in ((self.start, self.start[first]), (self.end, self.end[last - 1])))
        return Mapped("".join(text), start, end)

    def source(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.end[span[1] - 1])


def _characters_of(m: Mapped) -> list[tuple[int, int, str]]:
    return [] if m.text.isascii() else [(x.start(), x.end(), CHARACTERS[x.group()]) for x in DISGUISED.finditer(m.text)]


def _references_of(m: Mapped) -> list[tuple[int, int, str]]:
    return [(x.start(), x.end(), "@" if "4" in x.group() and "46" not in x.group() or "comm" in x.group() else ".") for x in REFERENCE.finditer(m.text)]


def _spelled_digits_of(m: Mapped) -> list[tuple[int, int, str]]:
    """Spelled digits of a row become digits, and the blanks between two of them go."""
    out = []
    for x in SPELLED.finditer(m.text):
        parts = [(p.start() + x.start(), p.end() + x.start(), p.group().lower()) for p in SPELLED_PART.finditer(x.group())]
        if not any(p[2] in DIGITS for p in parts):
            continue
        for i, (a, z, p) in enumerate(parts):
            if p in DIGITS:
                out.append((a, z, DIGITS[p]))
            elif p.startswith(("plus", "más")):
                out.append((a, z, "+"))
            elif not p.isdigit():
                if p.strip(" ,()-"):
                    out.append((a, z, "."))
                elif parts[i - 1][2] in DIGITS and parts[i + 1][2] in DIGITS:
                    out.append((a, z, ""))
    return out


def _brackets_of(m: Mapped) -> list[tuple[int, int, str]]:
    t, out, free = m.text, [], 0
    for x in BRACKETED.finditer(t):
        a, z = x.span()
        while a > free and t[a - 1] in BLANK:
            a -= 1
        free = z
        if a and z < len(t) and t[a - 1].isalnum() and t[z].isalnum():
            out.append((a, z, "@" if x["at"] else "."))
    return out


def _number_dots_of(m: Mapped) -> list[tuple[int, int, str]]:
    return [(x.start(), x.end(), ".") for x in DOT_BETWEEN_NUMBERS.finditer(m.text)]


def _dots_before(t: str, a: int, low: int) -> list[tuple[int, int, str]]:
    """Spelled dots of the local part that ends at a, back to `low`: word, blanks, dot, blanks, word, and so on."""
    out = []
    while True:
        i = a
        while i > low and t[i - 1] in LOCAL_PART:
            i -= 1
        z = i
        while z > low and t[z - 1] in BLANK:
            z -= 1
        b = z
        while b > low and z - b < 6 and t[b - 1].isalpha():  # a longer word is no dot
            b -= 1
        a = b
        while a > low and t[a - 1] in BLANK:
            a -= 1
        if i == z or a == b or t[b:z].lower() not in ("dot", "punto", "point", "punkt") or a <= low or t[a - 1] not in LOCAL_PART:
            return out[::-1]
        out.append((a, i, "."))


def _spelled_at_of(m: Mapped) -> list[tuple[int, int, str]]:
    """A spelled or spaced at with a domain behind it (see the module's text), and spelled dots before it."""
    t, out, free = m.text, [], 0
    until, spans = 0, []  # where the labels last looked at end, and the dots among them
    for x in SPELLED_AT.finditer(t):
        a, z = x.span()
        if a < free:
            continue
        if z >= until:
            if not (found := LABELS.match(t, z)):
                continue
            until, spans = found.end(), [d.span() for d in LABEL_DOT.finditer(t, z, found.end())]
            starts = [d[0] for d in spans]
        dots = spans[bisect_right(starts, z) :]  # a label comes first
        if not dots:
            continue
        said = x.group().strip(" \t_-").lower()
        spelled = [d for d in dots if t[d[0]] != "."]
        if not spelled and (said == "@" and x.group() == "@" or t[a] in "_-"):  # nothing disguised, or a name with `-at-` in it
            continue
        if any(t[b:e].strip(" \t_-").lower() not in AT_DOTS.get(said, AT_DOTS["at"]) for b, e in spelled):
            continue
        first, last = t[z : dots[0][0]].lower(), t[dots[-1][1] : until].lower()
        if not (last.isascii() and last.isalpha() and 2 <= len(last) <= 24 or last.startswith("xn--")) or last in SMALL_WORDS or first in ARTICLES:
            continue
        if not spelled and said != "@" and (len(last) > 2 and last not in GENERIC or t[dots[-1][1]].isupper() and t[z].islower()):
            continue  # `at home.Then`, a sentence's end without its blank
        out += _dots_before(t, a, free)
        out.append((a, z, "@"))
        out += [(b, e, ".") for b, e in spelled]
        free = until
    return out


CASCADE = (_characters_of, _references_of, _spelled_digits_of, _brackets_of, _number_dots_of, _spelled_at_of)


def normalised(text: str) -> Mapped:
    m = Mapped(text) if len(text) else Mapped("", np.zeros(0, int), np.zeros(0, int))
    for step in CASCADE:
        m = m.rewritten(step(m))
    return m


class _Lazy:
    """The source text until the first edit; offsets are only built then."""

    def __init__(self, text: str):
        self.text = text


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added ones (kind, start, end), each by kind as listed, then start."""
    text = text or ""
    base = identifiers(text)
    first = [(k, a, z) for k in KINDS for a, z in base[k]]
    m: Mapped | _Lazy = _Lazy(text)
    for step in CASCADE:
        if edits := step(m):
            m = (m if isinstance(m, Mapped) else Mapped(text)).rewritten(edits)
    added = []
    if isinstance(m, Mapped):
        for k, spans in identifiers(m.text).items():
            starts = [a for a, _ in base[k]]
            for s in spans:
                a, z = m.source(s)
                i = bisect_right(starts, a) - 1
                if i < 0 or base[k][i][1] < z:
                    added.append((k, a, z))
    return first, added


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{z}" for k, a, z in order)


def detect_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts by kind, the digest of the base spans and all spans."""

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans, extra = [], [], []
            for t in texts.to_pylist():
                base, added = find(t)
                kinds = [k for k, _, _ in base]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + added))
                extra.append(len(added))
            return [*(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]

        return run

    return add_columns(docs, make, [text], OUT)


def redacted(text: str | None) -> str | None:
    """The text with every span, base or added, replaced by its kind in capitals; spans that meet become one."""
    if text is None:
        return None
    base, added = find(text)
    if not base and not added:
        return text
    out, at = [], 0
    for a, z, k in sorted((a, z, k) for k, a, z in base + added):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; all columns stay."""
    names = docs.columns

    def make():
        return lambda texts: [pa.array([redacted(t) for t in texts.to_pylist()], pa.string())]

    out = add_columns(docs.withColumnRenamed(text, "__text"), make, ["__text"], T.StructType([T.StructField(text, T.StringType())]))
    return out.select(*names)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect_pii(docs).select("doc_id", *(f.name for f in OUT.fields))
