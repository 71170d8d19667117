"""Vectors that share ids, of many lengths, and the forest's recall and spill by dimension."""

import numpy as np
import pytest

from papyrine.llm import rp_forest
from tests.llm.test_others import found


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0]), (6, [1.0, 0.01]), (7, [1.0, 0.02]), (5, [0.0, 1.0]), (9, [0.0, -1.0]), (8, [0.01, -1.0])]
    got = found(rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == [(5, 0, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 1, 8, True), (9, 1, 8, False)]


def test_more_lengths_than_forests(spark, monkeypatch):
    """Every length has its links, with trees or without."""
    monkeypatch.setattr(rp_forest, "FORESTS", 2)
    rows = [(10 * d + k, [1.0 + (k == 1) * 1e-3] + [0.01 * k] * (d - 1) if k < 2 else [-1.0] + [0.0] * (d - 1)) for d in range(1, 12) for k in range(3)]
    got = {r[0]: r[1:3] for r in found(rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    for d in range(1, 12):
        assert got[10 * d] == (1, 10 * d) and got[10 * d + 1] == (1, 10 * d) and got[10 * d + 2] == (0, 10 * d + 2)


@pytest.mark.parametrize("dim", [16, 64, 256, 768])
def test_recall_and_leaves_by_dimension(dim):
    """Planted pairs of cosine 0.95 to 0.97, three times as many vectors as the sample: at most 20 leaves a vector."""
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(6000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.97, (len(a), 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    x = np.concatenate([a, b])
    trees = rp_forest.grow(x[rng.choice(len(x), 4096, replace=False)])
    together, leaves = np.zeros(len(a), bool), 0
    for tree in trees:
        for _, rows in tree.leaves(x):
            leaves += len(rows)
            mask = np.zeros(len(x), bool)
            mask[rows] = True
            together |= mask[: len(a)] & mask[len(a) :]
    assert together.mean() >= 0.95
    assert leaves / len(x) <= 20
