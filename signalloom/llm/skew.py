"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is joined by broadcast: so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, which has one row for each key; null where there is none. Null keys find nothing.

    Both are read more than once. Keys that hold HOT_SHARE of left's rows or more, 10,000 at most, are broadcast with
    their rows of right; what is left has no key above that share and is joined by shuffle.
    """
    known = left.dropna(subset=keys)
    counts = known.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
    total = known.count()
    hot = F.broadcast(counts.filter(F.col("__n") >= total * HOT_SHARE).select(*keys, F.lit(True).alias("__hot")))
    new = [c for c in right.columns if c not in keys]
    found = right.select(*keys, F.struct(*new).alias("__found"))
    warm = F.broadcast(found.join(hot, keys).drop("__hot"))
    marked = left.join(hot, keys, "left")
    some = marked.filter("__hot").drop("__hot").join(warm, keys, "left")
    rest = marked.filter("__hot IS NULL").drop("__hot").join(found, keys, "left")
    out = some.unionByName(rest)
    return out.select(*left.columns, *[F.col(f"__found.{c}").alias(c) for c in new])
