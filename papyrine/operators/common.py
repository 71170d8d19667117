"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def maybe_limit(df: DataFrame, limit: int | None) -> DataFrame:
    """``None`` and 0 both mean no limit."""
    return df.limit(limit) if limit else df


def attach(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Put the columns of an ungrouped aggregate (exactly one row) next to every row."""
    return df.join(F.broadcast(totals))


def key_set(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, for the right side of semi and anti joins.

    The map-side combine leaves one row per key and task, so a key that holds a third of a log costs the join no
    more than any other.
    """
    return df.select(*keys).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``, which should tell all rows of a key apart.

    A rank filter: Spark keeps one row per key and task before the shuffle, so a hot key costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def spread_rank(
    df: DataFrame, keys: Sequence[str], digest: Column, out: str = "rank", digits: int = 3
) -> DataFrame:
    """Dense rank 1..n within ``keys`` in the order of ``digest``, a column of unique hex text.

    No group passes through one task: rows are numbered inside (keys, first ``digits`` of the digest), and the
    offsets of those buckets come from their counts, at most 16**digits rows per group.
    """
    work = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_digest")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = work.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    match = F.col("_bucket") == F.col("_b")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return (
        work.withColumn("_at", F.row_number().over(inside))
        .join(offsets, match)
        .withColumn(out, F.col("_before") + F.col("_at"))
        .select(*df.columns, out)
    )
