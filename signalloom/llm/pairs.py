"""Fetching what two ends of many pairs need, where the first end may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import truncate_lineage

#: Pairs of one first end that share a copy of its payload.
SALT = 64


def with_payloads(pairs: DataFrame, payload: DataFrame, salt: int = SALT) -> DataFrame:
    """Pairs (a, b) with payload (id, data) of both: a, b, data_a, data_b.

    b's side is joined by b; a's payload is repeated once per `salt` of its pairs and joined by (a, salt), so a
    first end with very many pairs spreads over tasks.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / salt).cast("int").alias("salts"))
    salts = truncate_lineage(salts)  # apart from its grouping, so that the join of a hot end can be split
    first = payload.join(salts, payload["id"] == salts["a"]).select("a", F.col("data").alias("data_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    second = pairs.join(salts, "a").join(payload, pairs["b"] == payload["id"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("data").alias("data_b"))
    return second.join(first, ["a", "salt"]).select("a", "b", "data_a", "data_b")
