"""From raw documents to packed sequences: language ID, near-duplicate removal, secret masking, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import bestfit_packing, langid, secret_crf, simhash
from tidewater.llm.common import materialize, tune

#: Documents whose language is less certain than this go, as do those without a letter.
LEAST_CERTAIN = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts and texts without a letter go."""
    return langid.recognised(docs, langid.train(docs, ~langid.held_out(F.col("doc_id"))), LEAST_CERTAIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id (null last); see simhash.keep_one."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text masked and n_chars counted anew where that changed it."""
    masked = secret_crf.mask(docs, secret_crf.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, and their places in sequences of at most 1024 tokens.

    Null texts count as empty, repeated rows have pieces each, and an empty table gives none.
    """
    return bestfit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), memory=200_000, with_ids=True)  # workers keep what other stages hold


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each reads what the one before it wrote. Rows are the pieces of packing.

    Null texts and texts without a letter go with the first stage, copies with the second; an empty table gives no rows.
    """
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can express neither the trained classifiers nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None
