"""Blocks of extra-random trees hold ranks; what they add up is that of the values."""

import numpy as np
from pyspark.ml.linalg import Vectors

from quire.operators import random_trees as RT


def grown(seed, held, x, y, fold, levels):
    """A tree with random splits, some nodes of each level left as leaves."""
    rng, tree = np.random.default_rng(seed), RT.RandomTree(seed, held)
    for _ in range(levels):
        own = tree.start + np.flatnonzero(rng.random(tree.width) < 0.8)
        own = own if len(own) else np.array([tree.start])
        zero = np.zeros((len(own), 2))
        tree.grow(own, rng.integers(0, x.shape[1], len(own)), rng.choice(x.reshape(-1), len(own)), np.zeros(len(own)), zero, zero)
    return tree


def test_ranges_and_counts_of_ranked_blocks_equal_those_of_values():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 4)), 1)
    x[:, 3], x[0, 0], x[1, 1] = 0.0, np.finfo(float).max, -np.finfo(float).max
    y, fold = rng.integers(0, 2, 500), rng.integers(0, 3, 500)
    ranks, values = RT.ranked(x)
    assert ranks.dtype == np.uint16 and all((v[c] == col).all() for v, c, col in zip(values, ranks.T, x.T))
    for levels in (0, 1, 2, 5, 8):
        trees = [grown(s, held, x, y, fold, levels) for held in (0, 2, 7) for s in (1, 2)]
        group, size = RT.Group.of(trees, levels), sum(t.width for t in trees)
        low, high, counts = RT.value_ranges(group, ranks, y, fold, values)
        features, cuts = rng.integers(0, 4, (size, 2)), rng.choice(np.append(x.reshape(-1), [-99.0, 99.0]), (size, 2))
        left, base = RT.left_counts(group, features, cuts, ranks, y, fold, values), 0
        for t in trees:
            at = np.where(fold == t.held, -1, t.nodes(x) - t.start)
            for node in range(t.width):
                own, place = at == node, base + node
                assert counts[place].tolist() == [np.sum(y[own] == c) for c in (0, 1)]
                if own.any():
                    assert (low[place] == x[own].min(axis=0)).all() and (high[place] == x[own].max(axis=0)).all()
                for j in range(2):
                    under = own & (x[:, features[place, j]] <= cuts[place, j])
                    assert left[place, j].tolist() == [np.sum(y[under] == c) for c in (0, 1)]
            base += t.width


def test_more_values_than_two_bytes_count():
    x = np.arange(70_000, dtype=float)[::-1, None]
    ranks, values = RT.ranked(x)
    assert ranks.dtype == np.uint32 and (values[0][ranks[:, 0]] == x[:, 0]).all()


def test_kept_blocks_are_a_quarter_of_their_values(spark, monkeypatch):
    data = spark.createDataFrame([(Vectors.dense([(i * k) % 91 / 7 for k in range(1, 41)]), i % 2) for i in range(3000)], ["features", "label"])
    sizes = []
    grow = RT.RandomTrees._grow

    def seen(self, blocks, *args):
        sizes.append(blocks.map(lambda b: b[0].nbytes).sum())
        return grow(self, blocks, *args)
    monkeypatch.setattr(RT.RandomTrees, "_grow", seen)
    RT.RandomTrees(numTrees=2, maxDepth=2).fit(data)
    assert max(sizes) <= 3000 * 40 * 2
