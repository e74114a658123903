"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score uses its own features and those of the line before and
after; a transition weight links neighbouring labels. Forward-backward gives each line's marginal; the mean
of the marginals, weighted by line length, is the document's raw quality, and a two-parameter logistic
fitted on the training documents turns it into a score.

Only document labels exist, so in training each line first bears its document's label; then, for documents
labelled bad, lines that the first model holds to be surely good are released (relabelled), as good lines
also occur in bad documents.

Edge cases: a null text counts as empty; an empty text is one empty line and gets a score. A document's
lines are scored together, so memory is linear in the longest document. Without any labelled row every
score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fold_of, map_batches, mix64, packs, share_of_hash, table

#: Expected number of labelled training documents, and the most lines that one gives to the fit: a longer one gives a
#: stretch of so many, of which its number of lines says where it begins. Both bound the fit's memory on the driver.
TRAIN_DOCS = 4000
TRAIN_LINES = 120
KEEP_AT = 0.3
OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

#: Byte classes.
SPACE, LOWER, UPPER, DIGIT, STOP, SYMBOL, BREAK = range(7)
FEATURES = ("bias", "length", "upper", "symbols", "digits", "word_length", "stutter", "repeated", "ended", "empty", "short", "stops", "long_words", "variety", "lone_symbols", "marked")


def _classes() -> np.ndarray:
    t = np.full(256, LOWER, np.uint8)  # bytes of other letters count as lower case
    for c in range(128):
        s = chr(c)
        t[c] = BREAK if s == "\n" else SPACE if s.isspace() or c < 32 else UPPER if s.isupper() else LOWER if s.islower() else DIGIT if s.isdigit() else STOP if s in ".,;:'\"?()-" else SYMBOL
    return t


CLASS = _classes()
WEIGHT = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes with the break, and the number of lines of each text."""
    raw = [(t + "\n").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    kind = CLASS[b]
    # an upper-case letter of two bytes: C3 80 to C3 9E
    two = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
    kind[two] = UPPER
    kind[two - 1] = UPPER
    ends = np.flatnonzero(kind == BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    lines = np.add.reduceat(kind == BREAK, np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]), dtype=np.int64)

    def per_line(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts, dtype=np.int64).astype(float)

    upper, lower, symbol, digit, stop = (per_line(kind == k) for k in (UPPER, LOWER, SYMBOL, DIGIT, STOP))
    inside = (kind != SPACE) & (kind != BREAK)
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    n = len(ends)
    out = np.zeros((n, len(FEATURES)))
    words = stutter = longs = lone = np.zeros(n)
    variety = np.ones(n)
    if len(first):
        at = np.searchsorted(ends, first)
        pos = (np.arange(len(b)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(b)]]))) + 1).astype(np.uint64)
        h = (WEIGHT[b] + pos * np.uint64(0x9E3779B97F4A7C15)) * WEIGHT[(pos & np.uint64(255)).astype(np.uint8)]
        h *= inside
        h = mix64(np.add.reduceat(h, first) + (last - first).astype(np.uint64))
        words = np.bincount(at, minlength=n).astype(float)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (at[1:] == at[:-1])])
        stutter = np.bincount(at, same, n)
        longs = np.bincount(at, (last - first) >= 24, n)
        lone = np.bincount(at, (last == first) & (kind[first] == SYMBOL), n)
        order = np.lexsort((h, at))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])])
        variety = np.bincount(at[order], new, n) / np.maximum(words, 1)
        variety[words == 0] = 1
        spread = np.bincount(at, (h >> np.uint64(12)).astype(float) * (1 + np.arange(len(h)) - first_of(at)), n)
    else:
        spread = np.zeros(n)
    doc = np.repeat(np.arange(len(texts)), lines)
    key = spread + words
    order = np.lexsort((np.arange(n), key, doc))
    dup = np.zeros(n, bool)
    dup[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (size[order][1:] == size[order][:-1]) & (size[order][1:] > 1)
    visible = np.maximum(upper + lower + symbol + digit + stop, 1)
    out[:, 0] = 1
    out[:, 1] = np.log1p(size) / 6
    out[:, 2] = upper / np.maximum(upper + lower, 1)
    out[:, 3] = symbol / visible
    out[:, 4] = digit / visible
    out[:, 5] = np.minimum(visible / np.maximum(words, 1) / 10, 5)
    out[:, 6] = stutter / np.maximum(words, 1)
    out[:, 7] = dup
    out[:, 8] = np.isin(b[np.maximum(ends - 1, 0)], list(b".!?")) & (size > 1)
    out[:, 9] = words == 0
    out[:, 10] = size <= 30
    out[:, 11] = stop / visible * 5
    out[:, 12] = longs / np.maximum(words, 1)
    out[:, 13] = variety
    out[:, 14] = np.minimum(1, 3 * lone / np.maximum(words, 1))
    out[:, 15] = symbol > 0.04 * visible
    return out, size, lines


def first_of(at: np.ndarray) -> np.ndarray:
    """For ascending group numbers, the index at which each item's group begins."""
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, then the previous and the next line's (zeros beyond the document)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(lines)
    before[ends[:-1]] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after])


def forward_backward(unary: np.ndarray, trans: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of `good` for each line; expected counts of each label pair, all documents together.

    unary: log-odds of good for each line. Documents run side by side, longest first, so that each step works
    on the documents that still have a line.
    """
    starts = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    s, sizes = starts[order], lines[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    e = np.exp(trans - trans.max())
    psi = np.stack([np.exp(np.minimum(0, -unary)), np.exp(np.minimum(0, unary))], 1)
    alpha, beta = np.empty((len(unary), 2)), np.ones((len(unary), 2))
    scale = np.ones(len(unary))
    for t in range(steps):
        k = s[: alive[t]] + t
        a = psi[k] if t == 0 else (alpha[k - 1] @ e) * psi[k]
        scale[k] = z = a.sum(1)
        alpha[k] = a / z[:, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        k = s[: alive[t]] + t
        f = psi[k] * beta[k] / scale[k, None]
        beta[k - 1] = f @ e.T
        pairs += e * (alpha[k - 1].T @ f)
    m = alpha * beta
    return m[:, 1] / m.sum(1), pairs


@dataclass(frozen=True)
class LineCRF:
    weights: np.ndarray
    trans: np.ndarray
    calibration: tuple[float, float]

    def raw(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        good, _ = forward_backward(np.clip(with_neighbours(x, lines) @ self.weights, -30, 30), self.trans, lines)
        starts = np.cumsum(lines) - lines
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        p = np.clip(raw, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(a * np.log(p / (1 - p)) + b, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        return np.concatenate([np.zeros(0), *(self.calibrated(self.raw(*line_features(texts[a:b]))) for a, b in packs(texts))])


def fit_lines(x: np.ndarray, y: np.ndarray, lines: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam on the gradient: observed less expected features and label pairs."""
    z = with_neighbours(x, lines)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines) - lines] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    params, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for i in range(1, rounds + 1):
        w, tr = params[:-4], params[-4:].reshape(2, 2)
        good, pairs = forward_backward(np.clip(z @ w, -30, 30), tr, lines)
        g = np.concatenate([z.T @ (y - good), (seen - pairs).ravel()]) / len(y) - ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def fit_logistic(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic of log-odds by Newton's steps, lightly held to slope 1."""
    p = np.clip(raw, 1e-4, 1 - 1e-4)
    u = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        h = (u * (q * (1 - q))[:, None]).T @ u + 0.5 * np.eye(2)
        w = w + np.linalg.solve(h, u.T @ (y - q) - 0.5 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> LineCRF:
    """Learn from docs (doc_id, text) and labels (doc_id, quality); doc_id only joins and chooses the sample.

    About train_docs labelled documents by a hash of doc_id, at most TRAIN_LINES lines of each; line features are
    computed on the executors, over whole texts, and reach the driver as bytes of floats: at most 72 a line.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    flat = LineCRF(np.zeros(3 * len(FEATURES)), np.zeros((2, 2)), (1.0, 0.0))
    if not n:
        return flat
    chosen = known.filter(share_of_hash("doc_id", min(1.0, train_docs / n), 1))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def make():
        def run(b: pa.RecordBatch) -> dict:
            ys, ts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            out: dict[str, list] = {"y": ys, "size": [], "x": []}
            for a, z in packs(ts):
                x, size, lines = line_features(ts[a:z])
                ends = np.cumsum(lines)
                for end, m in zip(ends.tolist(), lines.tolist()):
                    first = end - m + (m % (m - TRAIN_LINES + 1) if m > TRAIN_LINES else 0)
                    stretch = slice(first, min(end, first + TRAIN_LINES))
                    out["size"].append(size[stretch].astype("<i8").tobytes())
                    out["x"].append(x[stretch].astype("<f4").tobytes())
            return out

        return run

    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("size", T.BinaryType()), T.StructField("x", T.BinaryType())])
    rows = sorted((r["y"], bytes(r["size"]), bytes(r["x"])) for r in map_batches(sample, make, schema).collect())
    if not rows:
        return flat
    size = np.frombuffer(b"".join([r[1] for r in rows]), "<i8")
    lines = np.array([len(r[1]) // 8 for r in rows])
    x = np.frombuffer(b"".join([r[2] for r in rows]), "<f4").reshape(-1, len(FEATURES)).astype(float)
    doc_y = np.array([r[0] for r in rows], float)
    del rows
    y = np.repeat(doc_y, lines)
    w, tr = fit_lines(x, y, lines)
    alone, _ = forward_backward(np.clip(with_neighbours(x, lines) @ w, -30, 30), np.zeros((2, 2)), lines)
    w, tr = fit_lines(x, np.where(alone > 0.6, 1.0, y), lines)
    model = LineCRF(w, tr, (1.0, 0.0))
    return LineCRF(w, tr, fit_logistic(model.raw(x, size, lines), doc_y))


def score_quality(docs: DataFrame, model: LineCRF, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher is better) and predicted (score >= KEEP_AT)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(t: pa.Array) -> list[pa.Array]:
            s = shared.value.score(t.to_pylist())
            return [pa.array(s), pa.array((s >= KEEP_AT).astype(np.int32))]

        return run

    return add_columns(docs, make, [text], OUT)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of("doc_id", 5)
    model = fit(docs, table(spark, sf_dir, "labels").filter(held != 0).select("doc_id", "quality"))
    out = score_quality(docs, model)
    return out.select("doc_id", F.coalesce(held == 0, F.lit(False)).alias("held_out"), "score", "predicted")
