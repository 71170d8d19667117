"""A training-corpus pipeline: every stage works on all that the one before kept.

Each stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes every stage's result to the shared
folder and reads it back, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from papyrine.session import discard, scratch_path, scratch_scope

# Rows of long texts are large: few of them at a time between the JVM and Python, and small row groups in the files, so
# that a stage's memory follows from these and not from the number of rows that defaults of the session allow.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "parquet.block.size": str(16 << 20),
}

ORACLE_SQL = None  # a classifier, banded alignment and packing are beyond SQL; tests use brute force


def settle(spark: SparkSession) -> None:
    """Put the settings in force for the session: a stage's plan runs after its function has returned."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the convolutional classifier accepts; a null text counts as empty, repeated rows each by itself."""
    settle(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate component. Rows of one id stay
    or go together; rows without an id or without words stay."""
    settle(spark)
    return ngram_join.keep_one(docs)


def no_repeated_strings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that occur elsewhere."""
    settle(spark)
    return suffix_dedup.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Null and empty texts stay, and all do if there are no items."""
    settle(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of 4096 tokens, by lexical retrieval: one row per piece."""
    settle(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", no_repeated_strings),
    ("benchmark decontamination", no_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is removed when its result is stored."""
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            result = stage(spark, docs, folder)
            result.write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return docs
