"""The corpus pipeline: language, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents. Stages keep rows with null texts or ids wherever their operator's
rules do, pass extra columns through and accept empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalloom.llm import language_id, near_dup, packing, pii, quality_crf
from signalloom.llm.common import fold_of, remove_folder, shared_folder, table

#: A text whose trigrams belong to its language by less than this share is in none that is known.
LEAST_LANGUAGE = 0.35


def aside(docs: DataFrame, out: StructType) -> DataFrame:
    """docs with columns that an operator's output would replace under other names; given back by `restored`."""
    names = {f.name for f in out.fields}
    return docs.select(*[F.col(f"`{c}`").alias(f"__aside_{c}") if c in names else F.col(f"`{c}`") for c in docs.columns])


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows that came through an operator after `aside`."""
    return df.select(*[F.col(f"`__aside_{c}`").alias(c) if f"__aside_{c}" in df.columns else F.col(f"`{c}`") for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing lang is filled in with the predicted one."""
    model = language_id.fit(docs.filter(fold_of("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    out = language_id.predict_language(aside(docs, language_id.OUT), model).filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_LANGUAGE))
    return restored(out.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be good."""
    labels = table(spark, sf_dir, "labels").filter(fold_of("doc_id", 5) != 0).select("doc_id", "quality")
    model = quality_crf.fit(docs.select("doc_id", "text"), labels)
    return restored(quality_crf.score_quality(aside(docs, quality_crf.OUT), model).filter("predicted = 1"), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dup.keep_one_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Fitted models and merge tables can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet to the shared folder and read again.

    A stage's folder is removed once its successor is written; the last one stays for the rows that are returned.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
