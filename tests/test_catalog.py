"""Every registered query of the signal engine beside its SQL, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from signalloom.catalog import ORACLES, QUERIES

TABLES = "events embeddings supplier pages".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple("-" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rendered_blocks(spark):
    from signalloom.functions import samples as S
    from signalloom.operators import windows as W

    s = spark.createDataFrame([("a", i, float(i)) for i in range(7)], "stream_id string, pos long, x double")
    got = W.rendered(s, 3, 4).withColumn("wide", S.widened(F.col("data"), 2)).orderBy("seq").collect()
    assert [r["data"] for r in got] == [[0, 1, 2], [3, 4, 5], [6, 0, 0], [0, 0, 0]] and [r["underrun"] for r in got] == [0, 0, 2, 3]
    assert got[0]["wide"] == [0, 0, 1, 1, 2, 2]
    assert [r["underrun"] for r in W.rendered(s, 4).orderBy("seq").collect()] == [0, 1]


def test_long_dc_block_beyond_its_sql(spark, tmp_path):
    """From 141,602 on the SQL's growing weights pass the largest double; the query goes on as the recursion does."""
    n = 150_000
    spark.range(n).selectExpr("id AS event_id", "CAST(id * 7919 % 397 AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["long_dc_block"](spark, str(tmp_path)).toPandas().sort_values("pos")
    want, before, y = [], 0.0, 0.0
    for i in range(n):
        x = i * 7919 % 397 / 397.0
        y, before = x - before + 0.995 * y, x
        want.append(y)
    assert list(got["pos"]) == list(range(n)) and (got["y"] - want).abs().max() < 5.1e-7
