"""Near-duplicate vectors by a forest of random-projection trees with spill.

Trees are fitted on a bounded sample: a node splits its sample at the median of a random projection until few are
left, or until the overlap would send nearly all to both sides (a dense cluster, which stays one leaf). Every vector
descends every tree; at a node it goes both ways if its projection lies within the spill margin of the split. Vectors
that share a leaf are compared, in double precision, and those of a cosine of ``least`` or more link.

The margin follows from what is looked for: on a random direction in d dimensions, vectors of cosine ``least`` lie some
sqrt((2 - 2 least) / d) apart, and ``SPILL`` is a share of that. So a vector reaches about as many leaves in 768
dimensions as in 16. Vectors of a length that few have get no trees: all of that length are one leaf.

Equal vectors are one class from the start. A leaf of any size is cut into blocks, and each pair of blocks is a task,
so no leaf is held whole. A pair that shares several leaves counts in the smallest of them alone, which both vectors
know from their lists of leaves; so tasks return one count per vector and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.graph import components
from papyrine.llm.textual import partitions
from papyrine.session import materialise

TREES = 8
SAMPLE = 16384  # vectors that the trees are fitted on
LEAF = 24  # of the sample; a leaf of the whole table is larger in proportion
SPILL = 0.25  # margin on each side of a split, as a share of the distance on it of vectors that just link
FORESTS = 16  # lengths of vectors that get trees, those of most classes first
DENSE = 0.85  # a split that leaves this share of a node on one side is none
BLOCK = 1024  # vectors of a block
ROUNDING = 1e-12  # cosines are compared as doubles; the last bits depend on the order of addition


def unit(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Splits in one array each; children of node i are left[i] and left[i] + 1, leaves have left[i] = 0."""

    def __init__(self, sample: np.ndarray, seed: int, spill: float):
        rng = np.random.default_rng(seed)
        self.direction, self.split, self.left, self.spill = [], [], [], spill
        todo = [np.arange(len(sample))]
        while len(self.left) < len(todo):
            rows = todo[len(self.left)]
            d = rng.normal(size=sample.shape[1])
            d /= np.sqrt((d * d).sum())
            at, child = 0.0, 0
            if len(rows) > LEAF:
                p = sample[rows] @ d
                at = float(np.median(p))
                low, high = rows[p <= at + spill], rows[p > at - spill]
                if max(len(low), len(high)) <= DENSE * len(rows):
                    child = len(todo)
                    todo += [low, high]
            self.direction.append(d)
            self.split.append(at)
            self.left.append(child)
        self.direction = np.array(self.direction)

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``x`` that reach it)."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.left[node]:
                yield node, rows
                continue
            p = x[rows] @ self.direction[node]
            todo.append((self.left[node], rows[p <= self.split[node] + self.spill]))
            todo.append((self.left[node] + 1, rows[p > self.split[node] - self.spill]))


def margin(least: float, dim: int) -> float:
    return SPILL * np.sqrt(max(0.0, 2 - 2 * least) / dim)


def grow(sample: np.ndarray, trees: int = TREES, least: float = 0.95) -> list[Tree]:
    return [Tree(sample, 101 + t, margin(least, sample.shape[1])) for t in range(trees)]


def can_link() -> Column:
    """Never null: true for rows with an id and a vector of finite components that are not all zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0))))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, k1, k2) of the vectors that can link: components all finite, not all zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(can_link())
    # Scaled to a largest component of 1, so that squares neither overflow nor vanish; -0.0 becomes 0.0.
    top = F.array_max(F.transform(v, F.abs))
    scaled = F.transform(v, lambda c: c / top + 0.0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), scaled.alias("scaled"), F.size(v).alias("dim")).select(
        "vec_id", "scaled", "dim", F.xxhash64("v").alias("k1"), F.hash(F.reverse("v")).alias("k2")
    )


def placed(classes: DataFrame, forests: dict[int, list[Tree]]) -> DataFrame:
    """(dim, leaf, cid, size, leaves, v) for each class and leaf it reaches; leaves lists all of them."""
    sent = classes.sparkSession.sparkContext.broadcast({d: [(t.direction, t.split, t.left, t.spill) for t in trees] for d, trees in forests.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = {}
        for d, trees in sent.value.items():
            forest[d] = []
            for parts in trees:
                t = Tree.__new__(Tree)
                t.direction, t.split, t.left, t.spill = parts
                forest[d].append(t)
        for batch in batches:
            cid, size, dims = (batch.column(i).to_numpy() for i in range(3))
            vectors = batch.column(3).to_pylist()
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = unit([vectors[i] for i in own])
                codes: list[list[int]] = [[] for _ in own]
                base = 0
                if d not in forest:
                    codes = [[0] for _ in own]
                for t in forest.get(d, ()):
                    for leaf, rows in t.leaves(x):
                        for r in rows.tolist():
                            codes[r].append(base + leaf)
                    base += len(t.left)
                lists = [np.sort(np.array(c, np.int32)) for c in codes]
                at = np.repeat(np.arange(len(own)), [len(c) for c in lists])
                packed, raw = [c.tobytes() for c in lists], [v.tobytes() for v in x]
                for a in range(0, len(at), 1 << 14):
                    part = at[a : a + (1 << 14)]
                    codes_here = np.concatenate(lists)[a : a + (1 << 14)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), d, np.int32)), pa.array(codes_here), pa.array(cid[own][part]), pa.array(size[own][part]), pa.array([packed[i] for i in part], pa.binary()), pa.array([raw[i] for i in part], pa.binary())],
                        ["dim", "leaf", "cid", "size", "leaves", "v"],
                    )

    kind = "dim int, leaf int, cid long, size long, leaves binary, v binary"
    return materialise(classes.select("cid", "size", "dim", "scaled").mapInArrow(run, kind), "leaves")


def compare(rows: list[tuple], i: int, j: int, leaf: int, least: float) -> list[tuple[int, int | None, int]]:
    """Links of one pair of blocks: (class, None, linked vectors) and forest edges (class, root, 0)."""
    cid, size = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    block = np.array([r[8] for r in rows])
    x = np.array([np.frombuffer(r[7], np.float64) for r in rows])
    near = x @ x.T >= least - ROUNDING
    np.fill_diagonal(near, False)
    if i != j:
        near &= block[:, None] != block[None, :]
    # Pairs that share a smaller leaf are counted there.
    lists = [np.frombuffer(r[6], np.int32) for r in rows]
    earlier = [c[c < leaf] for c in lists]
    names, code = np.unique(np.concatenate(earlier), return_inverse=True) if any(len(c) for c in earlier) else (np.zeros(0), np.zeros(0, np.int64))
    if len(names):
        has = np.zeros((len(rows), len(names)), np.float32)
        has[np.repeat(np.arange(len(rows)), [len(c) for c in earlier]), code] = 1
        near &= (has @ has.T) == 0
    out = []
    total = near @ size
    for k in np.flatnonzero(total):
        out.append((int(cid[k]), None, int(total[k])))
    root = np.arange(len(rows))
    a, b = np.nonzero(np.triu(near))
    while len(a):
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low[root], root):
            break
        root = low[root]
    out += [(int(cid[k]), int(cid[root[k]]), 0) for k in np.flatnonzero(root != np.arange(len(rows)))]
    return out


def near_vectors(vectors: DataFrame, least: float = 0.95, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, all zero, or hold a null or non-finite component link with nothing; so do vectors of
    different lengths, and rows with a null vec_id, whose component_id and kept are null. Equal vectors link and
    count one by one; rows that share a vec_id are vectors of their own. Other columns are ignored; an empty table
    gives no rows. Links found have the cosine asked for; pairs that no tree brings together are missed, so recall
    is measured in the tests.
    """
    rows = materialise(usable(vectors.select("vec_id", "embedding")), "vectors")
    # Rows that share a vec_id can be different vectors, so a class has a number of its own.
    classes = rows.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("vid"), F.count("*").alias("size"), F.first("scaled").alias("scaled"))
    classes = materialise(classes.withColumn("cid", F.xxhash64("k1", "k2", "dim")), "classes")
    dims = [r.dim for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(FORESTS).collect()]
    forests = {}
    for d in dims:
        chosen = classes.where(F.col("dim") == d).select("cid", F.xxhash64("cid").alias("h")).orderBy("h", "cid").limit(sample)
        got = classes.where(F.col("dim") == d).join(F.broadcast(chosen.select("cid")), "cid").orderBy("cid").select("scaled").collect()
        forests[d] = grow(unit([r.scaled for r in got]), trees, least)
    at = placed(classes, forests)
    sizes = at.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    spread = (
        at.join(sizes.drop("n"), ["dim", "leaf"])
        .withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "cid", "size", "leaves", "v", "mine")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out = compare(rows, rows[0][2], rows[0][3], rows[0][1], least)
            columns = zip(*out, strict=True) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v", "n"])

        key, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key and group:
                    yield flush(group)
                    group = []
                key = row[:4]
                group.append(row)
        if group:
            yield flush(group)

    dealt = spread.repartition(partitions(vectors), "dim", "leaf", "i", "j").sortWithinPartitions("dim", "leaf", "i", "j", "cid")
    found = materialise(dealt.mapInArrow(run, "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("others"))
    joined = components(found.where("v is not null").select("u", "v"))
    numbered = (
        classes.select("k1", "k2", "dim", "cid", "size", "vid")
        .join(counts.withColumnRenamed("u", "cid"), "cid", "left")
        .join(joined.withColumnRenamed("id", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    numbered = materialise(numbered, "numbered")
    smallest = numbered.groupBy("component").agg(F.min("vid").alias("component_id"))
    named = numbered.join(smallest, "component").select(
        "k1", "k2", "dim", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = rows.select("vec_id", "k1", "k2", "dim").join(named, ["k1", "k2", "dim"]).select("vec_id", "n_links", "component_id")
    return complete(vectors, linked)


def complete(vectors: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows that cannot link, beside those that can."""
    out = vectors.where(~can_link())
    alone = out.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.col("vec_id") == F.col("component_id"))
