"""Saved pages: web pages, Markdown pages, feeds, and file signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Attributes of feed links are read as _href, _type, _title; namespaces are ignored.
ENTRY = (
    "id string, title string, author array<struct<name:string>>, "
    "link array<struct<_href:string,_type:string,_title:string>>"
)
FEED = f"entry array<struct<{ENTRY.replace(' string', ':string').replace('author array', 'author:array').replace('link array', 'link:array')}>>"
PDF_SIGNATURE = b"%PDF-"


def read_texts(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """(path, content) of whole text files."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True, pathGlobFilter=pattern)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(key, path, content) of Markdown pages; the key is the file name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return read_texts(spark, path, "*.md").select(stem.alias("key"), "path", "content")


def parse_feed(df: DataFrame, column: str = "xml", out: str = "entries") -> DataFrame:
    """Parse a feed column into its entries."""
    return df.withColumn(out, F.from_xml(column, FEED, {"ignoreNamespace": "true"}).getField("entry")).drop(column)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of feed files, one row each."""
    return spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(ENTRY).load(path)


def file_signatures(
    spark: SparkSession, path: str, pattern: str = "*.pdf", signature: bytes = PDF_SIGNATURE
) -> DataFrame:
    """(file_name, bytes, valid): does each file start with the signature?

    Files are listed without their contents; only the first bytes of each are read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    size = len(signature)

    def heads(paths: pd.Series) -> pd.Series:
        from pyarrow import fs

        out = []
        for p in paths:
            system, place = fs.FileSystem.from_uri(p)
            with system.open_input_file(place) as f:
                out.append(f.read(size) == signature)
        return pd.Series(out, dtype=bool)

    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("bytes"),
        F.pandas_udf(heads, "boolean")(F.regexp_replace("path", "^file:/+", "file:///")).alias("valid"),
    )
