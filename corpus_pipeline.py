"""The corpus pipeline: stages one after another, each written as Parquet and read again.

All stages take empty tables, null ids, null, empty and very long texts, repeated rows
and further columns of any name; each says what becomes of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import cluster, decontam, jaccard_join, langid, packing, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go.

    Null, empty and letterless texts go. A very long text is judged whole. Repeated rows stay or go together.
    """
    return langid.known(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word n-grams, a similarity of 0.8 or more.

    The smallest doc_id stays, once if it is repeated. Texts that are null or without words stay, and so do rows without a doc_id.
    """
    return jaccard_join.keep_one(docs, k=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings of 200 bytes that stand in two places.

    No row goes; a text that repeats as a whole becomes empty. Null texts stay null, those under 200 bytes as they are.
    """
    return suffix_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; the others go.

    Null and empty texts hold none and stay; repeated rows stay or go together.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences.

    A null or empty text is one piece of its end mark; very long texts are cut into pieces; repeated rows are placed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The stages learn a model, follow links and pack: SQL can't express them.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted when the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{cluster.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
    return docs
