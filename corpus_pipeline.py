"""The corpus pipeline: toxic documents go, then poor ones, then near-duplicates; the rest is mixed and tokenised.

Counted as part of the `llm` subpackage. A stage takes (spark, docs, sf_dir); its result is written as
Parquet in the shared folder and read again as the next stage's documents.

All stages take null and empty texts as texts without words, read long texts whole, treat rows and not
ids, so rows with one id or none are judged each, pass on columns whatever their names, and give no rows
for an empty table. What a stage does beyond that is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm import mixing, pieces, quality, simhash, toxicity
from sheafwork.llm.common import read_table, remove, shared_dir, sweep


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; a score at it counts as toxic. The model learns from the labels of the documents it gets, and without labels of both classes it rejects none. Texts without words stay."""
    return toxicity.clean(docs, read_table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Without labels of both classes all have the share of class 1, or 0.5. Repeated rows stand or fall together."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (null last), of rows that share it that with the smallest digest. All texts without words are one group."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated by epochs; at most one of each source is cut, at its budget's last word. Documents without words are not in it; a null source is a source. Ties of the hash key are ordered by id, then size."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix; repeated rows are encoded each."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("simhash near-dedup", without_copies),
    ("mixing", mixed),
    ("sentencepiece", tokenised),
]

#: Trained models and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote, and what it held in between, goes once the next one's result is written; the last written table stays, as the result reads it."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{n}")
        sweep(spark)
        if n:
            remove(spark, f"{folder}/{n - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{n}")
    return docs
