"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import materialise

EDGE = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star forest of each batch's edges: (node, smallest node of its tree)."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = flat[: len(u)], flat[len(u) :]
        root = np.arange(len(names))
        while True:  # hooking onto smaller labels with pointer jumping
            low = root.copy()
            np.minimum.at(low, root[a], root[b])
            np.minimum.at(low, root[b], root[a])
            while not np.array_equal(low, low[low]):
                low = low[low]
            new = low[root]
            if np.array_equal(new, root):
                break
            root = new
        child = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[root[child]])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every node of the edges (u, v): component is the smallest node reachable.

    Alternating large-star and small-star steps: every edge is moved onto the smallest neighbour of its node until
    all trees are stars, in O(log n) rounds or so. The edge count never grows, a step is an aggregate with map-side
    combine and a join (which adaptive execution splits where a hub is hot), and every round's edges are written to
    the shared folder, so a lost executor costs no more than a round. Nothing is collected but two numbers a round.
    Loops and repeated edges are harmless; an empty frame gives no rows.
    """
    e = materialise(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_forest, EDGE).distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        kept = large.groupBy("u").agg(F.min("v").alias("v"))
        e = materialise(small.unionByName(kept).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
