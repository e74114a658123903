"""Per-document operators beside the libraries and plain versions, on odd and very long texts."""

import collections
import hashlib
import os
import random
import re
import time
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalloom.llm import bpe, language_id, pii, quality_crf, token_count, words

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "Σίσυφος ΟΔΟΣ", "I'm 'S don't  x'll'd''s they're 'r 'v 'l 'lx x'rx\n's  's   \n 't", "'", "''r", "!s", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
    "日本語 テキスト 123٣½", "é  x y\x1cz\x85q​w", "İstanbul ǅ ﬁ", "👩‍👩‍👧 ok!!", "", "   ", "\n\t\r a\r\nb", None, "the,the.the", "qxzj" * 40, "a" * 5000, "ab" * 3000, "가 한글", "x\u0000y �", " " * 1000 + "x",
]
rnd = random.Random(1)
ODD += ["".join(rnd.choice(["'", "s", "re", "l", "v", " ", "  ", "\n", "1", "!", "x", "<|endoftext|>", "é", " "]) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
ODD += ["".join(chr(rnd.choice([32, rnd.randrange(32, 127), rnd.randrange(0x80, 0x600), rnd.randrange(0x900, 0x3000)])) for _ in range(60)) for _ in range(200)]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_bpe_equals_the_library(spark, documents):
    texts = ODD + [r.text for r in documents.select("text").collect()]
    tk = Tokenizer.from_file(WORD)
    got = bpe.encode_decode(frame(spark, texts, n_tokens=9, extra="x"), WORD).toPandas().sort_values("doc_id")
    assert list(got.columns) == ["doc_id", "text", "extra", "n_tokens", "ids_sha256", "decoded_sha256"]
    for t, r in zip(texts, got.itertuples()):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_merging_short_and_long_agree():
    b = bpe.ForcedBoundaryBPE(WORD)
    for _ in range(200):
        s = [rnd.choice("thernigo") for _ in range(rnd.randrange(1, 90))]
        assert b._merge_short(list(s)) == b._merge_long(list(s))


def test_whole_and_cut_encoding_agree():
    b = bpe.ForcedBoundaryBPE(WORD)
    for t in ODD:
        for c in (t or "").split():
            assert b.encode_whole(c) == b.encode_chunk(c)


def test_segments_of_any_size():
    a = pa.array(ODD)
    b, o = words.string_bytes(a)
    want = [re.findall(rb"[^\x09\x0a\x0d\x20]+", (t or "").encode()) for t in ODD]
    for most in (5, 37, 1 << 20):
        got = [[] for _ in ODD]
        for s in words.segments(b, o, bpe.BLANKS, most):
            for d, i, j in zip(s.doc, s.first, s.end):
                got[d].append(s.b[i:j].tobytes())
        assert got == want


def test_span_hashes_differ():
    b = np.frombuffer(b"abc abd ab a abcdefgh abcdefghi abcdefgh " + b"x" * 300 + b" " + b"x" * 301 + b" abc", np.uint8)
    ends = np.append(np.flatnonzero(b == 32), len(b))
    first = np.concatenate([[0], ends[:-1] + 1])
    h = words.span_hashes(b, first, ends)
    by_word = {b[i:j].tobytes(): int(x) for i, j, x in zip(first, ends, h)}
    assert len(by_word) == len(set(by_word.values())) == 8 and h[0] == h[-1] and h[4] == h[6]
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    for n in (8, 64, 256, 512, 1024):  # words that polynomials modulo 2**64 can't tell apart
        pair = ["".join("ab"[x ^ y] for x in thue[:n]) for y in (0, 1)]
        h = words.span_hashes(np.frombuffer("".join(pair).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]


def test_memory_is_bounded():
    m = bpe.Memory(len, most=10)
    for i in range(100):
        assert m.many([b"%d" % i, b"x"]) == [len(str(i)), 1]
    assert len(m.new) <= 10 and len(m.old) <= 10


def test_token_counts_equal_the_library(spark, documents, monkeypatch):
    texts = ODD + [r.text for r in documents.select("text").collect()]
    want = [len(Tokenizer.from_file(BYTE).encode(t or "", add_special_tokens=False).ids) for t in texts[:1]]
    tk = Tokenizer.from_file(BYTE)
    want = [len(tk.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_count.count_tokens(frame(spark, texts), BYTE).toPandas().sort_values("doc_id")
    assert got["n_tokens"].tolist() == want
    assert got["n_bytes"].tolist() == [len((t or "").encode()) for t in texts]
    assert (got["over_limit"] == (got["n_tokens"] > 1024)).all()
    monkeypatch.setattr(token_count, "MOST", 50)
    monkeypatch.setattr(token_count.pieces, "__defaults__", (40,))
    assert token_count.TokenCounter(BYTE).count([t or "" for t in texts[:300]]).tolist() == want[:300]


def test_token_counts_of_every_code_point():
    known = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(known[a : a + 400]) + "x'" + "".join(known[a : a + 400]) for a in range(0, len(known), 400)]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert token_count.TokenCounter(BYTE).count(texts).tolist() == want


@pytest.mark.parametrize("most", [40, 100_000])
def test_merge_transducer_equals_the_library(most):
    """All of the vocabulary (a part where states are forgotten all the time), tokens in a row, repeated and random bytes."""
    b = bpe.ForcedBoundaryBPE(BYTE)
    plain = lambda t: bytes(b.byte_of[c] for c in t)
    merges = token_count.MergeTransducer({(plain(x), plain(y)): r for (x, y), r in b.ranks.items()}, most)
    tokens = sorted(b.vocab)[:: 1 if most > 1000 else 50]
    words_ = tokens + ["".join(rnd.choices(tokens, k=rnd.randrange(1, 5))) for _ in range(2000)]
    words_ += [rnd.choice("aAe=-") * n for n in range(1, 90)] + ["".join(rnd.choices("abnthesring", k=rnd.randrange(1, 40))) for _ in range(3000)] + ["".join(rnd.choices(b.letters, k=9)) for _ in range(2000)]
    for w in words_:
        assert merges.count(plain(w)) == len(b.model.tokenize(w)), w
    assert len(merges.keys) <= most + 400 and merges.count(b"") == 0


def test_token_count_edges(spark):
    docs = frame(spark, ["a b", "a b", None, "", "x" * 300_000], n_tokens="clash", extra=1)
    got = token_count.count_tokens(docs, BYTE).toPandas().sort_values("doc_id")
    assert got["n_tokens"].iloc[:4].tolist() == [2, 2, 0, 0] and set(got.columns) == {"doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"}
    assert got["over_limit"].tolist() == [False] * 4 + [True]
    for op in (lambda d: token_count.count_tokens(d, BYTE), lambda d: bpe.encode_decode(d, WORD), pii.detect_pii):
        assert op(docs.limit(0)).count() == 0
    assert quality_crf.score_quality(docs.limit(0), quality_crf.LineCRF(np.zeros(48), np.zeros((2, 2)), (1.0, 0.0))).count() == 0


def plain_pii(t):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, r in rules.items():
        for m in re.finditer(r, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(p) > 255 for p in m.group().split(".")) or k == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_are_the_plain_rules():
    for _ in range(5000):
        t = "".join(rnd.choice(["1", "25", "300", "0", ".", "@", "a", "b-c", "+", " ", "(", ")", "-", "4111111111111111", "é"]) for _ in range(rnd.randrange(1, 30)))
        assert pii.find(t)[0] == plain_pii(t)


@pytest.mark.parametrize("kind,text", [
    ("email", "bob [at] example [dot] com"), ("email", "john dot smith at mail dot example dot org"), ("email", "jane(at)mail3.example.com"), ("email", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "bоb@exаmple.com"), ("email", "b​ob@ex​ample.com"), ("email", "bob&#64;example.com"), ("email", "bob_at_example_dot_com"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "４１１１ １１１１ １１１１ １１１１"), ("phone", "plus one four one five five five five two six seven one"),
    ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "192[.]168[.]1[.]1"), ("ip", "192 dot 168 dot 1 dot 1"),
])
def test_disguises_map_back(kind, text):
    source = f"the hand, é {text} and"
    base, added = pii.find(source)
    assert [(k, source[a:z]) for k, a, z in added] == [(kind, text)]
    assert text not in pii.redacted(source) and f"[{kind.upper()}]" in pii.redacted(source)


@pytest.mark.parametrize("kind,text", [
    ("card", "cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno"), ("card", "quatre un un un un un un un un un un un un un un un"), ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ("phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete"), ("phone", "plus trois trois un deux trois quatre cinq six sept huit zéro"), ("phone", "Plus vier neun drei null fünf sechs SIEBEN acht neun zwo"),
    ("email", "jane at host dot nz"), ("email", "bob at example dot shop"), ("email", "a dot b dot c at d dot museum"), ("email", "jane arroba host punto gr"), ("email", "jane [at] host [dot] co [dot] za"), ("email", "jane at host punkt ua"),
])
def test_disguises_of_other_languages_and_countries(kind, text):
    test_disguises_map_back(kind, text)


def test_clean_texts_have_no_spans(documents):
    for t in ("look at the thing. And", "one two of nine", "meet at noon dot the i", "stared at the dot on it", "looked at one point in time", "stay at home.Then", "was at home.It was", "name-at-home.com", *(re.sub(r"[0-9@+]", "", r.text) for r in documents.select("text").collect())):
        assert pii.find(t) == ([], [])


def test_spelled_dots_far_before_the_at():
    t = "dot ".join(f"n{i} " for i in range(300)) + "at host dot org"
    assert pii.find(t) == ([], [("email", 0, len(t))])


def test_added_spans_are_those_of_a_plain_mapper():
    """Pieces whose plain form is known; plain rules over the whole plain text, mapped back character by character."""
    pieces = [("a", "a"), ("\u0430", "a"), ("\uff42", "b"), ("\u200b", ""), ("&#64;", "@"), ("&commat;", "@"), ("\uff20", "@"), ("\u2024", "."), ("&period;", "."), (".", "."), ("\u0661", "1"), ("2", "2"), ("\uff0b", "+"), ("\u2010", "-"), ("!", "!"), ("4111111111111111", "4111111111111111"), ("c", "c")]
    some = 0
    for _ in range(8000):
        text, plain, at = "", "", []
        for source, said in rnd.choices(pieces, k=rnd.randrange(1, 30)):
            at += [(len(text) + (i if len(said) == len(source) else 0), len(text) + (i + 1 if len(said) == len(source) else len(source))) for i in range(len(said))]
            text, plain = text + source, plain + said
        base = plain_pii(text)
        mapped = [(k, at[a][0], at[z - 1][1]) for k, a, z in plain_pii(plain)]
        want = [s for s in mapped if not any(k == s[0] and a <= s[1] and s[2] <= z for k, a, z in base)]
        assert pii.find(text) == (base, want), text
        some += len(want)
    assert some > 500


@pytest.mark.parametrize("part", [" ", "a-at-b", "a at ", "[ ", "a [at] b ", "one ", "+1 (", "&#0", "dot ", "x.", "@"])
def test_pii_is_linear(part):
    def seconds(n):
        began = time.process_time()
        pii.find(part * (n // len(part)))
        return time.process_time() - began

    assert seconds(1_000_000) < 6  # a quadratic scan takes minutes


def test_pii_query_edges(spark):
    got = pii.detect_pii(frame(spark, [None, "", "a@b.co 4111 1111 1111 1111", "1" * 200_000, "@" * 50_000], spans=1)).toPandas().sort_values("doc_id")
    assert got["n_email"].tolist() == [0, 0, 1, 0, 0] and got["n_card"].tolist() == [0, 0, 1, 0, 0]
    assert got["base_sha256"].iat[0] == hashlib.sha256(b"").hexdigest() and got["spans"].iat[2] == "email:0:6,card:7:26"


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.op7_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(0, "the hand of the", "en"), (1, "le pain et la", "fr"), (2, None, "fr"), (3, "", None), (4, "12 !", "en"), (5, "the", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict_language(docs.withColumn("score", F.lit("x")), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "fr", "und", "und", "und", "en"] and got[2].score == 0
    none = language_id.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in language_id.predict_language(docs, none).collect()} == {"und"}
    assert language_id.predict_language(docs.limit(0), model).count() == 0


def test_language_pieces_of_long_texts(monkeypatch):
    f = language_id.LanguageFilter.build(["a", "b"], np.arange(10, dtype=np.uint64), np.arange(10) % 2)
    text = "the hand of rend and 12 threl " * 50
    whole = f.predict([text, "x", None])
    monkeypatch.setattr(language_id.segments, "__defaults__", (17,))
    parts = f.predict([text, "x", None])
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_bitmask_filter_has_no_false_negatives():
    grams = np.random.default_rng(0).integers(0, 1 << 62, 3000).astype(np.uint64)
    lang = np.arange(3000) % 5
    f = language_id.LanguageFilter.build(list("abcde"), grams, lang)
    assert ((f.languages_of(grams)[0] >> lang.astype(np.uint8)) & 1).all() and (f.false_rate < 0.05).all()


def test_many_languages():
    names = [f"l{i:03}" for i in range(150)]
    texts = ["".join(chr(0x4E00 + 40 * i + k % 37) for k in range(60)) for i in range(150)]
    grams = [np.unique(language_id.trigrams(f"  {t}  ")[0]) for t in texts]
    f = language_id.LanguageFilter.build(names, np.concatenate(grams), np.repeat(np.arange(150), [len(g) for g in grams]))
    got, score = f.predict(texts + ["", None])
    assert f.words.shape[0] == 3 and got == names + ["und", "und"] and (score[:150] > 0.9).all()


def plain_trigrams(text):
    """Trigrams round each letter, of lower-case letters with a blank for anything else."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in f"  {text}  "]
    low = [c if unicodedata.category(c)[0] == "L" else " " for c in low]
    return ["".join(low[i - 1 : i + 2]) for i in range(1, len(low) - 1) if low[i] != " "]


def test_language_equals_plain_counts(spark, documents):
    """The filter beside sets of trigrams: the same trigrams, the same language wherever one is clearly ahead, ties by name."""
    rows = [r for r in documents.select("text", "lang").collect() if r.text] + [("the the the", "en"), ("the the the", "xx")]
    sets = collections.defaultdict(set)
    for text, lang in rows:
        if lang:
            sets[lang].update(plain_trigrams(text))
    names = sorted(sets)
    code = {g: i for i, g in enumerate(sorted(set.union(*sets.values())))}
    for text, _ in rows[:50] + [("Éa1'b ß Σ İx", None)]:
        h, ok = language_id.trigrams(f"  {text}  ")
        assert len(set(plain_trigrams(text))) == len(set(h[ok].tolist())) and ok.sum() == len(plain_trigrams(text))
    hashed = {g: int(language_id.trigrams(g)[0][0]) for g in code}
    pairs = [(hashed[g], i) for i, n in enumerate(names) for g in sorted(sets[n])]
    f = language_id.LanguageFilter.build(names, np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))
    texts = [r[0] for r in rows] + ["the the", "1 2", None]
    got, score = f.predict(texts)
    for t, g, p in zip(texts, got, score):
        grams = plain_trigrams(t or "")
        share = [sum(x in sets[n] for x in grams) / max(1, len(grams)) for n in names]
        best = max(share)
        if not grams:
            assert (g, p) == ("und", 0)
        else:
            assert abs(p - best) < 0.02 and share[names.index(g)] >= best - 0.02
    one, two = (language_id.LanguageFilter.build(n, np.repeat(f_, 2), np.tile([0, 1], len(f_))) for n, f_ in ((["b", "c"], np.array([hashed["the"]], np.uint64)), (["a", "b"], np.array([hashed["the"]], np.uint64))))
    assert one.predict(["the"])[0] == ["b"] and two.predict(["the"])[0] == ["a"]  # ties


def brute_marginals(unary, trans):
    n = len(unary)
    total = np.zeros((n, 2))
    for m in range(1 << n):
        y = [(m >> i) & 1 for i in range(n)]
        p = np.exp(sum(u * s for u, s in zip(unary, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total[np.arange(n), y] += p
    return total[:, 1] / total.sum(1)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 6, 4])
    unary, trans = rng.normal(0, 2, 14), rng.normal(size=(2, 2))
    got, pairs = quality_crf.forward_backward(unary, trans, lines)
    at = np.cumsum(lines) - lines
    assert np.allclose(got, np.concatenate([brute_marginals(unary[a : a + n], trans) for a, n in zip(at, lines)]))
    assert np.isclose(pairs.sum(), (lines - 1).sum())


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = quality_crf.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good = got[got["quality"] == 1]
    assert (got["predicted"] == got["quality"]).mean() > 0.93 and good["predicted"].mean() > 0.97 and got["score"].between(0, 1).all()


def test_quality_edges(spark):
    docs = frame(spark, [None, "", "\n\n", "a b c. " * 20_000, "x\n" * 3000], score="s", predicted=None)
    flat = quality_crf.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_crf.score_quality(docs, flat).collect()} == {0.5}
    some = quality_crf.fit(docs, spark.createDataFrame([(3, 1), (4, 0), (4, 0), (1, None)], "doc_id long, quality int"))
    got = quality_crf.score_quality(docs, some).toPandas().sort_values("doc_id")
    assert got["score"].between(0, 1).all() and got["score"].iat[0] == got["score"].iat[1]
