"""Extra-random trees against a tree grown row by row, and selection by them."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from quire.operators import models as MD
from quire.operators import random_trees as RT


def table(spark, n=300, width=6, parts=5):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, width)), 2)
    x[:, 4] = 1.0
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n)) > 0).astype(int)
    rows = [(i, i % 3, int(y[i]), Vectors.dense(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "fold", "label", "features"]).repartition(parts), x, y


def brute(x, y, seed, number, path, level, depth, k):
    """The same tree, one node and one row at a time: nested (feature, threshold, left, right) or a share."""
    share = sum(y) / len(y)
    varying = [f for f in range(x.shape[1]) if min(x[:, f]) < max(x[:, f])]
    if level == depth or share in (0, 1) or not varying:
        return share

    def entropy(labels):
        return -sum(labels.count(c) * math.log(labels.count(c) / len(labels)) for c in set(labels))
    varying.sort(key=lambda f: RT.uniform(seed, number, path, f, 0)[0])
    best = None
    for f in varying[:k]:
        low, high = min(x[:, f]), max(x[:, f])
        cut = low + RT.uniform(seed, number, path, f, 1)[0] * (high - low)
        cut = cut if cut < high else low
        under = [v <= cut for v in x[:, f]]
        after = entropy([int(c) for c, u in zip(y, under) if u]) + entropy([int(c) for c, u in zip(y, under) if not u])
        if best is None or after < best[0] - 1e-9:
            best = (after, f, cut, np.array(under))
    _, f, cut, under = best
    return (f, cut, brute(x[under], y[under], seed, number, 2 * path + 1, level + 1, depth, k),
            brute(x[~under], y[~under], seed, number, 2 * path + 2, level + 1, depth, k))


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return tree.value[at]
    return (int(tree.feature[at]), float(tree.threshold[at]), nested(tree, tree.child[at]), nested(tree, tree.child[at] + 1))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return math.isclose(a, b, abs_tol=1e-12)
    return a[0] == b[0] and math.isclose(a[1], b[1]) and same(a[2], b[2]) and same(a[3], b[3])


def test_trees_equal_brute_force(spark):
    df, x, y = table(spark)
    model = RT.RandomTrees(numTrees=4, maxDepth=7, seed=9).fit(df)
    for t in model.trees:
        assert same(nested(t), brute(x, y, 9, t.number, 0, 0, 7, 2))


def test_folds_and_groups_do_not_change_trees(spark, monkeypatch):
    df, x, y = table(spark)
    monkeypatch.setattr(RT, "MAX_CELLS", 30)
    models = RT.RandomTrees(numTrees=3, maxDepth=5, seed=2).fit_folds(df, "fold", 3)
    fold = np.arange(len(x)) % 3
    for k, m in enumerate(models):
        for t in m.trees:
            assert same(nested(t), brute(x[fold != k], y[fold != k], 2, t.number, 0, 0, 5, 2))


def test_scores_and_importances(spark):
    df, x, y = table(spark)
    model = RT.RandomTrees(numTrees=100, maxDepth=8).fit(df)
    out = {r["id"]: r for r in model.transform(df).collect()}
    want = np.mean([t.value[t.nodes(x)] for t in model.trees], axis=0)
    assert max(abs(out[i]["probability"][1] - want[i]) for i in range(len(x))) < 1e-12
    assert np.mean([(out[i]["prediction"] == 1) == (y[i] == 1) for i in range(len(x))]) > 0.9
    assert model.importances.argmax() == 0 and model.importances[4] == 0 and math.isclose(model.importances.sum(), 1)
    kept, importances = RT.select_per_fold(df, "label", "fold", 3, trees=30, depth=4)[1]
    assert 0 in kept and 4 not in kept and len(importances) == 6


def test_odd_rows(spark):
    schema_rows = [(0, 0, 0, Vectors.dense([float("nan"), 1.0])), (1, 0, 1, Vectors.dense([2.0, 1.0])), (2, 1, None, Vectors.dense([3.0, 1.0]))]
    df = spark.createDataFrame(schema_rows, ["id", "fold", "label", "features"])
    model = RT.RandomTrees(numTrees=2, maxDepth=3).fit(df)
    assert [r["prediction"] for r in model.transform(df).orderBy("id").collect()] == [0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        RT.RandomTrees(numTrees=1).fit(df.where("label is null"))


def test_a_model_is_fitted_on_each_folds_kept_slice(spark):
    df, x, y = table(spark)
    kept = [[0, 1], [0], [4]]
    out = {r["id"]: r["pred"] for r in MD.oof_selected(df, "id", "label", "fold", kept, MD.logistic("label")).collect()}
    assert sorted(out) == list(range(len(x)))
    for k, own in enumerate(kept):
        sliced = MD.slice_features(df, own, "s").drop("features").withColumnRenamed("s", "features")
        model = MD.logistic("label")(0, sum(1 for i in range(len(x)) if i % 3 != k)).fit(sliced.where(f"fold <> {k}"))
        want = MD.positive_score(model.transform(sliced.where(f"fold = {k}"))).collect()
        assert model.coefficients.size == len(own) and all(abs(out[r["id"]] - r["pred"]) < 1e-6 for r in want)
    constant = {round(out[i], 9) for i in range(2, len(x), 3)}
    assert len(constant) == 1
