"""Archives, k-means and collocations beside brute force and edge cases."""

import collections
import gzip
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from signalloom.llm import collocations, lloyd, skew, warc
from signalloom.llm.registry import ORACLES, QUERIES


def plain(rows):
    return sorted((tuple("-" if v is None else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", ["op11_warc", "op12_lloyd", "op13_collocations"])
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in "documents embeddings pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = QUERIES[name](spark, data)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert want and plain(got.select(*cols).collect()) == plain(want)


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, v int")
    got = {r.i: r.v for r in skew.lookup(left, right, ["k"]).collect()}
    assert len(got) == 301 and got == {i: 1 if i % 3 and i != 999 else 2 if i == 3 else None for i in got}


# --- archives



def arc(version, records):
    body = b"%d 0 Someone\n%s\n" % (version, warc.FIELDS[version].encode())
    extra = b" 200 - - 0 old.arc" if version == 2 else b""
    out = b"filedesc://old.arc 0.0.0.0 19970801 text/plain%s %d\n%s" % (extra, len(body), body)
    for url, date, mime, block in records:
        out += b"\n%s 10.0.0.1 %s %s%s %d\n%s" % (url, date, mime, b" 200 abc - 17 f.arc" if version == 2 else b"", len(block), block)
    return out + b"\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_header_lines_of_both_versions(version, packed):
    http = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nbody\nhttp://in.body 1.1.1.1 19990101000000 text/html 5\n"
    data = arc(version, [(b"http://a/b c", b"199901021530", b"text/html; charset=x", http), (b"dns:a", b"99999999999999", b"text/dns", b"1.2.3.4"), (b"http://empty/", b"20000101000000", b"no-type", b"")])
    got = list(warc.arc_records(gzip.compress(data[:40]) + gzip.compress(data[40:]) if packed else data))
    assert [(r.url, r.date, r.mime, r.block) for r in got[1:]] == [
        ("http://a/b c", "1999-01-02T15:30:00Z", "text/html; charset=x", http),
        ("dns:a", "1970-01-01T00:00:00Z", "text/dns", b"1.2.3.4"),
        ("http://empty/", "2000-01-01T00:00:00Z", "no-type", b""),
    ]
    assert all(data[r.offset :].startswith(r.url.encode()) for r in got) and all(r.whole for r in got)
    broken = data.replace(b"\ndns:a", b"\nno header line at all\ndns:a")[:-12]  # the last header line is cut
    assert [r.url for r in warc.arc_records(broken)][1:] == ["http://a/b c", "dns:a"]
    cut = list(warc.arc_records(data[: data.index(b"1.2.3.4") + 3]))
    assert cut[-1].block == b"1.2" and not cut[-1].whole


def test_converted_records():
    http = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\n" + b"p" * 20
    data = arc(2, [(b"http://a/", b"20010203040506", b"text/html", http), (b"ftp://f", b"20010203040506", b"text/plain", b"file")])
    at = [r.offset for r in warc.arc_records(data)]
    out = b"\r\n\r\n".join(warc.converted("x.arc", data, {at[1]: "<urn:uuid:1> 2000-01-01T00:00:00Z http://b/ c"}))
    kinds = [(f["warc-type"], b) for f, b in warc.warc_records(out)]
    assert [k for k, _ in kinds] == ["warcinfo", "revisit", "resource"] and kinds[1][1] == http[:-20] and kinds[2][1] == b"file"
    fields = [f for f, _ in warc.warc_records(gzip.compress(out))]
    assert fields[1]["warc-refers-to"] == "<urn:uuid:1>" and fields[1]["warc-refers-to-target-uri"] == "http://b/ c" and fields[1]["warc-date"] == "2001-02-03T04:05:06Z"
    assert len({f["warc-record-id"] for f in fields}) == 3 and [f["warc-record-id"] for f in fields] == [f["warc-record-id"] for f, _ in warc.warc_records(b"\r\n\r\n".join(warc.converted("x.arc", data, {})))]


def archived(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS content", "1 AS archive", "2 AS id").repartition(3)
    warc.write_arc(pages, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    return warc.resolved(warc.read_warc(spark, f"{tmp_path}/warc"))


def test_copies_become_revisits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)  # several files of both versions a task
    r, same, other = random.Random(3), "é" * 500, "x" * 1000
    rows = [(i, f"http://h/{i} \n", same if i % 3 == 0 else other if i % 3 == 1 else "\r\n\r\n" + "y" * r.randrange(3000)) for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (302, "u", ""), (303, "u", "s" * 999), (304, "u", "s" * 999), (None, "n", same), (None, "n", "only" * 400)]
    got = archived(spark, rows, tmp_path).collect()
    groups = collections.defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        top = max(groups[t or ""])
        again = len(b) >= 1000 and (-1 if i is None else i) != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert plain((x["rank"], x["payload_bytes"], x["payload_digest"], x["type"], x["refers_to"]) for x in got) == plain(want)
    files = [f for _, _, fs in os.walk(f"{tmp_path}/arc") for f in fs if f.endswith(".gz")]
    heads = [gzip.open(f"{tmp_path}/arc/{f}").read(200).split(b"\n")[1][:1] for f in files]
    assert len(files) > 4 and set(heads) == {b"1", b"2"}


def test_files_are_packed_at_their_level(spark, tmp_path):
    r = random.Random(5)
    text = " ".join(r.choice(["archive", "record", "payload", "digest", "revisit"]) + str(r.randrange(999)) for _ in range(40_000)).encode()
    warc.write_files(spark.createDataFrame([(bytearray(text),)], warc.CONTENT), f"{tmp_path}/x", "\n")
    packed = next(p for p in (tmp_path / "x").iterdir() if p.name.endswith(".gz")).read_bytes()
    fast, usual = len(gzip.compress(text, 1)), len(gzip.compress(text, 6))
    assert gzip.decompress(packed) == text + b"\n" and abs(len(packed) - fast) < abs(len(packed) - usual)


def test_archive_edges(spark, tmp_path):
    twice = [(7, "a", "z" * 2000)] * 3
    got = archived(spark, twice, tmp_path / "a").collect()
    assert sorted((x["type"], x["refers_to"], x["payload_bytes"]) for x in got) == [("response", None, 2000), ("revisit", 7, 2000), ("revisit", 7, 2000)] or sorted(x["type"] for x in got) == ["response", "revisit", "revisit"]
    assert archived(spark, [], tmp_path / "b").count() == 0


# --- k-means


def brute_lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * np.float64(v))) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [e for _, e in by_hash[:k]]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, e in kept:
            of[nearest(e)[1]].append(e)
        for j, es in of.items():
            centroids[j] = [sum(x) // len(es) for x in zip(*es)]
    out = [(i, *nearest(e)[::-1]) for i, e in kept]
    most = (1 << 63) - 1
    total = collections.Counter()
    for _, j, d in out:
        total[j] += min(d, most)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, min(d, most), min(total[j], most), min(sum(total.values()), most), names[j]) for i, j, d in out]


@pytest.mark.parametrize("kind", ["spread", "equal", "few", "huge", "grid"])
def test_lloyd_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(lloyd, "BLOCK", 100)
    r = np.random.default_rng(len(kind))
    x = r.normal(size=(20, 64))[r.integers(0, 20, 600)] + r.normal(size=(600, 64)) * r.choice([0.01, 0.2, 1])
    if kind == "equal":
        x[100:400] = x[7]
    if kind == "huge":
        x[::50] *= 1e12
        x[3] *= 1e25
    if kind == "grid":
        x = r.integers(0, 2, (600, 64)) * 1.0
        x[:, 2:] = 0
    x = x[:9] if kind == "few" else x
    rows = [(i if i % 40 else i // 80, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63), (None, [0.25] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'q' AS cluster", "0 AS x", "1 AS i").repartition(3)
    assert plain(lloyd.lloyd(df).collect()) == plain(brute_lloyd(rows))


def test_lloyd_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert lloyd.lloyd(df).count() == 0 and lloyd.lloyd(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_walk_prunes_and_covers():
    r = np.random.default_rng(5)
    x = np.floor(64 * (r.normal(size=(40, 64))[r.integers(0, 40, 1500)] + 0.02 * r.normal(size=(1500, 64))))
    t = lloyd.cover_tree(x, lloyd.LEAF)
    for i in range(len(t.centre)):
        own = t.order[t.first[i] : t.first[i] + t.size[i]]
        assert lloyd._distances(x[own], x[t.centre[i]]).max() <= t.radius[i] + 1e-9
    assert sorted(t.order) == list(range(1500))
    x, t.centre = x[t.order], np.argsort(t.order)[t.centre]
    centroids = x[::150].copy()
    centroids[4] = centroids[2]
    nodes, to, leaves = lloyd.walk(x, t, centroids, lloyd.cover_tree(centroids, 1))
    assert t.size[nodes].sum() + sum(t.size[i] for i, _ in leaves) == 1500
    assert len(nodes) < 1000 and 4 not in to  # whole nodes go to one centroid, and equal ones to the first


# --- collocations


def brute_phrases(docs, least=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    rows = []
    often = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    held = collections.Counter()
    for (lang, g), c in often.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                held[lang, g[i : i + k]] = max(held[lang, g[i : i + k]], c)
    for (lang, g), a in often.items():
        if 100 * held[lang, g] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out, rank = [], collections.Counter()
    for lang, s, a, g, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], g.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_collocations_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(collocations, "SHARD", 700)
    monkeypatch.setattr(collocations, "SLICE", 20)
    r = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "Ünd", "w" * 300, "don't", "A", "B", "x y"]
    docs = [(None, None), ("en", ""), ("en", None), ("und", "a b a b"), ("xx", "A" * 5)]
    for _ in range(400):
        words = [r.choice(vocabulary[: r.randrange(2, len(vocabulary))]) for _ in range(r.randrange(60))]
        words += ["one", "Two", "three", "four"] * r.randrange(3) + ["z"] * r.randrange(9)
        docs.append((r.choice(["en", "de", None, "und"]), "".join(w + r.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for w in words)))
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS rank", "2 AS f", "3 AS h", "'q' AS phrase").repartition(4)
    for top in (2000, 3):
        want = brute_phrases(docs, top=top)
        assert len(want) > 4 and plain(collocations.collocations(df, top=top).collect()) == plain(want)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "lang string, text string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0


def test_suffix_array_and_intervals():
    r = np.random.default_rng(1)
    ids = r.integers(-1, 4, 500).astype(np.int32)
    ids[-1] = -1
    sa, lcp = collocations.suffix_array(ids)
    assert sorted(sa) == list(range(500))
    for n in (2, 3, 4):
        want = collections.Counter(tuple(ids[i : i + n].tolist()) for i in range(500 - n + 1) if (ids[i : i + n] >= 0).all())
        at, f = collocations.intervals(ids, sa, lcp, n)
        assert dict(zip((tuple(ids[i : i + n].tolist()) for i in at), f.tolist())) == want
