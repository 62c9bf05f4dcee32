"""The training-data pipeline: quality, near duplicates, repeats, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which the caller writes and reads again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightglass.llm import bagminhash, cnn_quality, crf_secrets, packing, recompression
from nightglass.llm.queries import BYTE_BPE
from nightglass.llm.shared import discard, materialise, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    net = cnn_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cnn_quality.score_quality(docs, net, passing=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: that with the least id."""
    return bagminhash.keep_one(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of all but the first document; a document of nothing else goes."""
    out = recompression.remove_repeats(docs, passing=("lang", "source", "n_chars"), with_text=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.filter("n_removed = 0 OR n_removed < n_words").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of each secret."""
    out = crf_secrets.find_secrets(docs, redacted=True, passing=("lang", "source", "n_chars"))
    found = F.col("n_assign") + F.col("n_access") + F.col("n_hex") + F.col("n_crf") > 0
    length = F.when(found, F.length("redacted")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", best_fit)]

#: SQL can't express the stages' models; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again.

    A stage's table is deleted when the next one is written; what the last
    stage's result reads stays.
    """
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    with scratch() as every:
        for name, stage in STAGES[:-1]:
            with scratch() as own:
                docs = materialise(stage(spark, docs, sf_dir), name)
                own.keep(docs)
            discard(*written)
            written = [docs]
        out = STAGES[-1][1](spark, docs, sf_dir)  # reads the documents once, here
        every.keep(*(table for table in every.tables if table is not docs))
    return out
