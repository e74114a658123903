"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Native: features, training histograms and scores are DataFrame expressions. URLs that a rule decides are the
labelled ones. Boosting runs over a bounded sample of their rows, binned and counted by distinct bins; each level of
each tree is one grouped sum of gradients by (leaf, feature, bin), of bounded size, from which the splits are
chosen. Every suffix of the sample has a statistic; a training row gets it from the folds that it is not in. One
fold is held out: trees are added until its loss stops falling. The finished trees are one arithmetic expression and
the statistics two broadcast tables of the sample's size at most, so scoring needs no shuffle whatever hosts are hot.

Edge cases: a null URL or one without `://` has empty host and path, fits no rule and is judged by the trees.
Without labelled URLs every verdict outside the rules is `allow`. Repeated rows are judged alike, an empty table
gives an empty one, a tie of the score (0.5) is `allow`; of rules, the longer wins, of equally long ones the later.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_of_hash, table, truncate_lineage

#: (rule, verdict); a rule is a host suffix and a path prefix.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Expected labelled rows to train on, chosen by a hash of the whole row; most trees, trees between looks at the
#: held-out loss, their depth, bins a feature, learning rate, ridge.
TRAIN_ROWS = 20_000
TREES, LOOK, DEPTH, BINS, RATE, RIDGE = 40, 8, 2, 16, 0.3, 40.0
#: Folds, the first of which is held out, and rows that the mean of all counts for in a suffix's statistic.
FOLDS, PRIOR = 5, 10.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "host_suffix", "file_suffix")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def fits(rule: str, host: Column, path: Column) -> Column:
    h, slash, p = rule.partition("/")
    return ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)


def by_rule(rules: tuple, host: Column, path: Column, value: int) -> Column:
    """The rule (value 0) or verdict (value 1) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one is tested first
        out = F.when(fits(r[0], host, path), F.lit(r[value])).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda acc, c: acc - F.when(F.length(c) > 0, ((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n) * F.log2(F.greatest(F.length(url) - F.length(F.replace(url, c, F.lit(""))), F.lit(1)) / n)).otherwise(0.0),
    )
    return {
        "length": F.length(url).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": digits / n,
        "entropy": entropy,
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
        "host_labels": F.size(F.split(host, "\\.")).cast("double"),
    }


def host_suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(path, "\\.([A-Za-z0-9]{1,8})$", 1)


@dataclass
class Boosted:
    """Trees as nested (feature, edge, left, right) or leaf values, and the suffix statistics they read (tables s, v)."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: dict[str, DataFrame] = field(default_factory=dict)
    prior: float = 0.5
    #: Rows of the held-out fold, the share judged as labelled, and its log loss.
    held_out: tuple[int, float, float] = (0, 0.0, 0.0)

    def margin(self) -> Column:
        def grown(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            name, edge, left, right = t
            return F.when(F.col(f"__{name}") <= F.lit(edge), grown(left)).otherwise(grown(right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + grown(t)
        return out


def with_lexical(df: DataFrame) -> DataFrame:
    """df (with __url, __host, __path), one column __<feature> for each feature but the statistics, and the suffixes."""
    got = {f"__{k}": v for k, v in lexical(F.col("__url"), F.col("__host"), F.col("__path")).items()}
    return df.withColumns(got | {"__s_host": host_suffix(F.col("__host")), "__s_file": file_suffix(F.col("__path"))})


def with_statistics(df: DataFrame, model: Boosted) -> DataFrame:
    """df with the statistics of its suffixes; one that wasn't seen has the mean of all."""
    for kind in ("host", "file"):
        if kind in model.suffixes:
            t = model.suffixes[kind].select(F.col("s").alias(f"__s_{kind}"), F.col("v").alias(f"__{kind}_suffix"))
            df = df.join(F.broadcast(t), f"__s_{kind}", "left").withColumn(f"__{kind}_suffix", F.coalesce(f"__{kind}_suffix", F.lit(model.prior)))
        else:
            df = df.withColumn(f"__{kind}_suffix", F.lit(model.prior))
    return df


def _best(hist: dict[tuple[int, int], tuple[float, float]], edges: dict[int, list[float]]) -> tuple:
    """(gain, feature, edge number, value left, value right) of one leaf; gain 0 if no split helps."""
    g0 = h0 = 0.0
    for (f, _), (g, h) in hist.items():
        if f == 0:
            g0, h0 = g0 + g, h0 + h
    value = RATE * g0 / (h0 + RIDGE)
    best = (0.0, 0, 0, value, value)
    for f, e in edges.items():
        g = h = 0.0
        for k in range(len(e)):
            a, b = hist.get((f, k), (0.0, 0.0))
            g, h = g + a, h + b
            gain = g * g / (h + RIDGE) + (g0 - g) ** 2 / (h0 - h + RIDGE) - g0 * g0 / (h0 + RIDGE)
            if gain > best[0] + 1e-9:
                best = (gain, f, k, RATE * g / (h + RIDGE), RATE * (g0 - g) / (h0 - h + RIDGE))
    return best


def _statistics(sample: DataFrame, kind: str, prior: float) -> tuple[DataFrame, DataFrame]:
    """(s, v) over all of the sample; (s, fold, v) over the folds but that one. At most one row, and FOLDS, a suffix."""
    name = f"__s_{kind}"
    parts = truncate_lineage(sample.groupBy(F.col(name).alias("s"), F.col("__fold").alias("fold")).agg(F.count("*").alias("n"), F.sum("__y").alias("y")))
    whole = parts.groupBy("s").agg(F.sum("n").alias("all_n"), F.sum("y").alias("all_y"))
    value = lambda y, n: (y + PRIOR * prior) / (n + PRIOR)
    others = parts.join(F.broadcast(whole), "s").select("s", "fold", value(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n")).alias("v"))
    return truncate_lineage(whole.select("s", value(F.col("all_y"), F.col("all_n")).alias("v"))), others


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Boosted:
    """Boost over rows (__url, __host, __path, __y in 0, 1, __row: a hash of the row)."""
    total = labelled.agg(F.count("*").alias("n"), F.sum("__y").alias("y")).first()
    if not total["n"]:
        return Boosted(base=1.0, prior=1.0)
    prior = total["y"] / total["n"]
    model = Boosted(math.log((prior + 1e-3) / (1 - prior + 1e-3)), [], {}, prior)
    fold = F.pmod(F.xxhash64(F.lit(5), "__url"), F.lit(FOLDS)).cast("int")
    sample = truncate_lineage(with_lexical(labelled.filter(share_of_hash("__row", min(1.0, train_rows / total["n"]), 9))).withColumn("__fold", fold).drop("__url", "__path"))
    for kind in ("host", "file"):
        model.suffixes[kind], others = _statistics(sample, kind, prior)
        others = others.select(F.col("s").alias(f"__s_{kind}"), F.col("fold").alias("__fold"), F.col("v").alias(f"__{kind}_suffix"))
        sample = sample.join(F.broadcast(others), [f"__s_{kind}", "__fold"])
    cuts = sample.agg(*[F.percentile_approx(f"__{f}", [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in FEATURES]).first()
    edges = {i: sorted(set(cuts[f] or [])) for i, f in enumerate(FEATURES)}
    bins = [sum((F.when(F.col(f"__{f}") > e, 1).otherwise(0) for e in edges[i]), F.lit(0)).alias(f"b{i}") for i, f in enumerate(FEATURES)]
    rows = sample.select("__y", (F.col("__fold") == 0).alias("held"), *bins).groupBy("__y", "held", *[f"b{i}" for i in range(len(FEATURES))]).agg(F.count("*").alias("n"))
    rows = truncate_lineage(rows.withColumn("m", F.lit(model.base)).coalesce(2))
    if not rows.filter("held").take(1) or not rows.filter("NOT held").take(1):  # too few rows to hold some out
        rows = rows.withColumn("held", F.lit(False)).unionByName(rows.withColumn("held", F.lit(True)))
    best, grown = (math.inf, 0), []
    while len(model.trees) < TREES:
        margins = [F.col("m")]
        for _ in range(LOOK):
            raw, binned = _tree(rows.filter("NOT held"), margins[-1], edges)
            model.trees.append(raw)
            margins.append(margins[-1] + binned)
        # the loss of a row is log(1 + exp(-margin)), with the margin's sign turned for label 0
        loss = [F.sum(F.col("n") * F.log1p(F.exp(F.when(F.col("__y") == 1, -m).otherwise(m)))) / F.sum("n") for m in margins]
        right = [F.sum(F.when((m >= 0) == (F.col("__y") == 1), F.col("n")).otherwise(0)) / F.sum("n") for m in margins]
        seen = rows.filter("held").agg(F.sum("n"), *loss, *right).first()
        done = len(model.trees) - LOOK
        grown += [(seen[1 + i], done + i, seen[2 + LOOK + i]) for i in range(0 if not done else 1, LOOK + 1)]
        best = min(grown)
        model.held_out = (seen[0], best[2], best[0])
        if best[1] < len(model.trees):
            break
        rows = truncate_lineage(rows.withColumn("m", margins[-1]))
    del model.trees[best[1] :]
    return model


def _tree(rows: DataFrame, margin: Column, edges: dict[int, list[float]]) -> tuple:
    """The next tree over rows (__y, n, b0, b1, ...), as nested values and as a column of bins."""
    p = 1 / (1 + F.exp(-margin))
    shown = rows.withColumn("g", F.col("n") * (F.col("__y") - p)).withColumn("h", F.col("n") * p * (1 - p))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(FEATURES))]))
    leaf, splits = F.lit(0), {}
    for level in range(DEPTH):
        hist = shown.select(leaf.alias("leaf"), "g", "h", pairs.alias("p")).groupBy("leaf", "p.f", "p.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by_leaf: dict[int, dict] = {}
        for r in hist:
            by_leaf.setdefault(r["leaf"], {})[r["f"], r["b"]] = (r["g"], r["h"])
        right = F.lit(0)
        for k in sorted(by_leaf):
            splits[level, k] = s = _best(by_leaf[k], edges)
            if s[0] > 0:
                right = F.when((leaf == k) & (F.col(f"b{s[1]}") > s[2]), 1).otherwise(right)
        leaf = leaf * 2 + right

    def tree(level: int, k: int, value: float, raw: bool):
        s = splits.get((level, k)) if level < DEPTH else None
        if s is None or s[0] <= 0:
            return float(value) if raw else F.lit(float(value))
        left, right = (tree(level + 1, 2 * k + j, s[3 + j], raw) for j in (0, 1))
        return (FEATURES[s[1]], float(edges[s[1]][s[2]]), left, right) if raw else F.when(F.col(f"b{s[1]}") <= s[2], left).otherwise(right)

    root = splits.get((0, 0), (0.0, 0, 0, 0.0, 0.0))
    return tree(0, 0, root[3], True), tree(0, 0, root[3], False)


def judge_urls(pages: DataFrame, rules: tuple = RULES, url: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """pages with host, path, rule, verdict and score (the trees' probability of `allow`)."""
    new = {"host", "path", "rule", "verdict", "score"}
    src = pages.withColumn("__url", F.coalesce(F.col(url), F.lit("")))
    src = src.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    src = src.withColumn("__rule", by_rule(rules, F.col("__host"), F.col("__path"), 0)).withColumn("__given", by_rule(rules, F.col("__host"), F.col("__path"), 1))
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in pages.dtypes if not t.startswith("map")])
    labelled = src.filter(F.col("__given").isNotNull()).select("__url", "__host", "__path", (F.col("__given") == "allow").cast("int").alias("__y"), row.alias("__row"))
    model = train(labelled, train_rows)
    out = with_statistics(with_lexical(src), model).withColumn("__score", 1 / (1 + F.exp(-model.margin())))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    verdict = F.coalesce(F.col("__given"), F.when(F.col("__score") >= 0.5, "allow").otherwise("block"))
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__score").alias("score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
