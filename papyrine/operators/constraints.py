"""Key, NULL and reference checks that plain Parquet tables do not enforce."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators.stats import duplicate_keys


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Number of keys that occur more than once."""
    return duplicate_keys(df, *keys).agg(F.count("*").alias("violations"))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("violations"))


def references(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing in the parent. Distinct keys are checked, then weighted with their count."""
    counted = df.groupBy(key).agg(F.count("*").alias("_n"))
    return counted.join(parent.select(key), key, "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")
    )


def report(checks: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """One row per (table, rule, check) with its number of violations."""
    rows = [
        check.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("violations").cast("long"))
        for table, rule, check in checks
    ]
    return reduce(DataFrame.unionByName, rows)
