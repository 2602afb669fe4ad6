"""Properties of the fitted models."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quire.operators import models as MD
from quire.operators.boosting import HistogramBooster
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3)) * np.array([1.0, 20.0, 0.1])
    p = 1 / (1 + np.exp(-(x @ np.array([1.5, 0.05, 8.0]) - 0.3)))
    y = (rng.random(400) < p).astype(float)
    rows = [(f"k{i:03d}", float(y[i]), i % 5, x[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, y double, fold int, a array<double>")
    return df.select("key", "y", "fold", array_to_vector("a").alias("features")).cache(), x, y


def auc(s, y):
    order = np.argsort(np.argsort(s))
    n1 = int(y.sum())
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_ridge_is_the_closed_form(data):
    df, x, y = data
    model = MD.ridge("y", float(y.std()), alpha=3.0)(0, len(y)).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)


def test_logistic_stands_at_the_optimum_of_its_loss(data):
    df, x, y = data
    for c in (1.0, 0.01):
        model = MD.logistic("y", c)(0, len(y)).fit(df)
        w, b = model.coefficients.toArray(), model.intercept
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert np.abs(x.T @ (p - y) + w / c).max() < 0.05 * len(y) / 100 and abs((p - y).sum()) < 0.05


def test_l1_drops_weights(data):
    df, x, _ = data
    strong = MD.l1_logistic("y", alpha=0.05)(0, 400).fit(df).coefficients.toArray()
    weak = MD.l1_logistic("y")(0, 400).fit(df).coefficients.toArray()
    assert (strong == 0).sum() > (weak == 0).sum() and np.abs(strong).sum() < np.abs(weak).sum()


def test_out_of_fold_is_disjoint_and_complete(data, spark):
    df, _, y = data
    test = df.select(F.concat(F.lit("t"), "key").alias("key"), "features")
    sizes = []

    def make(seed, n):
        sizes.append(n)
        return MD.logistic("y")(seed, n)

    oof, tst = MD.oof_predict(df, test, "key", "y", "fold", 5, make)
    got = {r["key"]: (r["fold"], r["pred"]) for r in oof.collect()}
    assert len(got) == 400 and all(f == int(k[1:]) % 5 for k, (f, _) in got.items()) and sizes == [320] * 5
    assert auc(np.array([got[f"k{i:03d}"][1] for i in range(400)]), y) > 0.8
    one = df.where("fold <> 2")
    again = MD.positive_score(MD.logistic("y")(0, 320).fit(one).transform(df.where("fold = 2"))).collect()
    assert all(abs(got[r["key"]][1] - r["pred"]) < 1e-9 for r in again)
    assert tst.count() == 400 and {r["key"][0] for r in tst.collect()} == {"t"}


def test_bagging_averages_and_keeps_the_test_rows(data):
    df, _, y = data
    df = df.withColumn("fold", F.col("fold") % 2)

    def make(seed, n):
        return MD.logistic("y", c=float(seed))(seed, n)

    oof, tst = MD.bagged(df, df.select("key", "features"), "key", "y", "fold", 2, make, [1, 2])
    assert oof.count() == tst.count() == 400
    a, b = ({r["key"]: r["pred"] for r in MD.oof_predict(df, None, "key", "y", "fold", 2, make, s)[0].collect()} for s in (1, 2))
    assert all(abs(r["pred"] - (a[r["key"]] + b[r["key"]]) / 2) < 1e-6 for r in oof.collect())


@pytest.mark.parametrize("make", [MD.gbt_classifier("y", max_iter=8, depth=3), MD.random_forest("y", trees=20, depth=5),
                                  MD.mlp("y", 3, hidden=8, max_iter=60), MD.gbt_regressor("y", max_iter=8, depth=3)])
def test_models_learn(data, make):
    df, _, y = data
    got = {r["key"]: r["pred"] for r in MD.positive_score(make(3, 400).fit(df).transform(df)).collect()}
    assert auc(np.array([got[f"k{i:03d}"] for i in range(400)]), y) > 0.75


def test_early_stopping_builds_fewer_trees(data):
    df, _, _ = data
    flagged = df.withColumn("val", F.col("fold") == 0)
    stopped = MD.gbt_classifier("y", max_iter=60, depth=3, step=0.3, validation="val")(1, 400).fit(flagged)
    assert stopped.getNumTrees < 60


def first_tree(x, y, cuts, depth, penalty=1.0, least=1.0, step=0.05):
    """Margins after one round of logistic boosting from 0, row by row."""
    bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1)

    def grow(rows, d):
        g, h = (0.5 - y[rows]).sum(), 0.25 * len(rows)
        best = (0.0, None)
        for f in range(x.shape[1]) if d < depth else ():
            for b in range(32):
                low = rows[bins[rows, f] <= b]
                gl, hl = (0.5 - y[low]).sum(), 0.25 * len(low)
                if hl >= least and h - hl >= least:
                    gain = gl ** 2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g ** 2 / (h + penalty)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b))
        if best[1] is None:
            out[rows] = -step * g / (h + penalty)
            return
        f, b = best[1]
        grow(rows[bins[rows, f] <= b], d + 1)
        grow(rows[bins[rows, f] > b], d + 1)
    out = np.zeros(len(y))
    grow(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_first_round_is_the_best_tree(data, parts):
    df, x, y = data
    model = HistogramBooster(labelCol="y", maxIter=1, maxDepth=3).fit(df.repartition(parts))
    want = first_tree(x, y, model.cuts, 3)
    got = {r["key"]: r["margin"] for r in model.transform(df).collect()}
    assert len(model.cuts[0]) == 31 and np.allclose([got[f"k{i:03d}"] for i in range(400)], want, atol=1e-12)


def test_fold_models_are_those_of_single_fits(data):
    df, x, _ = data
    make = lambda: HistogramBooster(labelCol="y", maxIter=25, maxDepth=2, subsample=0.7, colsample=0.7, seed=4)
    runs = make().fit_runs(df, "fold", 5, [4, 9])
    again = make().fit_folds(df, "fold", 5)
    assert all(np.allclose(a.margin(x), b.margin(x)) for a, b in zip(runs[0], again))
    assert not np.allclose(runs[0][0].margin(x), runs[1][0].margin(x)) and not np.allclose(runs[0][0].margin(x), runs[0][1].margin(x))


def test_patience_keeps_the_best_round(data):
    df, x, _ = data
    flagged = df.withColumn("val", F.col("fold") == 0)
    make = lambda patience: HistogramBooster(labelCol="y", maxIter=90, maxDepth=3, stepSize=0.3, patience=patience,
                                             validationIndicatorCol="val").fit(flagged)
    stopped, full = make(12), make(1000)
    assert len(full.history) == 91 and np.allclose(stopped.history, full.history[:len(stopped.history)], rtol=1e-9)
    best = int(np.argmin(full.history))
    assert stopped.getNumTrees == full.getNumTrees == best and len(stopped.history) == best + 13 < 91
    assert np.allclose(stopped.margin(x), full.margin(x), atol=1e-9)


def test_tasks_run_side_by_side(spark):
    import threading
    import time
    gate = threading.Barrier(3, timeout=20)
    assert MD.concurrently(spark, [lambda i=i: (gate.wait(), i * i)[1] for i in range(3)]) == [0, 1, 4]
    inner = lambda: MD.concurrently(spark, [time.time, time.time])
    assert all(a <= b for a, b in MD.concurrently(spark, [inner, inner]))


def test_selected_slice_feeds_a_model(data, spark):
    df, _, y = data
    kept, importances = MD.importance_select(df, "y", ["a", "b", "c"], trees=30)
    assert kept and len(importances) == 3 and all(importances[i] >= sum(importances) / 3 for i in kept)
    sliced = MD.slice_features(df, kept).drop("features").withColumnRenamed("selected", "features")
    got = {r["key"]: r["pred"] for r in MD.positive_score(MD.logistic("y")(0, 400).fit(sliced).transform(sliced)).collect()}
    assert auc(np.array([got[f"k{i:03d}"] for i in range(400)]), y) > 0.6


def test_naive_bayes_rows_sum_to_one_and_cover_rows_without_terms(spark):
    weights = spark.createDataFrame([("a", "x", 2.0), ("b", "y", 1.0), ("c", "x", 1.0), ("z", "q", 1.0)], "k string, term string, weight double")
    labels = spark.createDataFrame([("a", "p"), ("b", "n"), ("c", "p"), ("d", "n"), ("e", None)], "k string, c string")
    got = {}
    for r in MD.multinomial_nb(weights, labels, "k", "c").collect():
        got.setdefault(r["k"], {})[r["c"]] = r["prob"]
    assert sorted(got) == list("abcd") and all(abs(sum(v.values()) - 1) < 1e-12 for v in got.values())
    # class p: x 3 of 3; class n: y 1 of 1; two terms, add-one smoothing
    p, n = 0.5 * (4 / 5) ** 2, 0.5 * (1 / 3) ** 2
    assert got["a"]["p"] == pytest.approx(p / (p + n)) and got["d"]["p"] == pytest.approx(0.5)


def test_svd_columns_are_orthogonal(spark):
    import __spark_entry__ as E
    rows = E.queries()["n9_truncated_svd"](spark, SF_SMALL).collect()
    m = np.array([[r[f"svd_{i}"] for i in range(15)] for r in rows])
    gram = m.T @ m
    off = np.abs(gram - np.diag(np.diag(gram))).max()
    assert off < 1e-3 * gram.max() and (np.diff(np.diag(gram)) <= 1e-6).all()


def test_queries_fit_the_published_sizes(spark, monkeypatch):
    from unittest.mock import MagicMock

    from quire.plans import q_models as Q
    made = {}

    class Fitted(Exception):
        pass

    def keep(make, **more):
        made["fit"], made["more"] = make(1, 100), more
        raise Fitted

    def size(fn):
        with pytest.raises(Fitted):
            fn(spark, SF_SMALL)
        fit = made["fit"]
        rounds = "numTrees" if fit.hasParam("numTrees") else "maxIter"
        return fit.getOrDefault(rounds), fit.getOrDefault("maxDepth")

    monkeypatch.setattr(Q, "model_tables", lambda *a: (MagicMock(), MagicMock(), ["a"]))
    monkeypatch.setattr(MD, "oof_predict", lambda *a, **k: keep(a[6]))
    monkeypatch.setattr(MD, "bagged", lambda *a, **k: keep(a[6], seeds=a[7]))
    assert size(Q.m8_gbt_classifier) == (200, 4)
    assert size(Q.m3_seed_bagging) == (200, 4)
    assert made["more"]["seeds"] == [111, 222, 333, 444, 555, 666, 777, 888, 999]
    monkeypatch.setattr(Q, "_fit_all", lambda s, d, factory, clip=False: keep(factory(None, ["a"])))
    assert size(Q.m9_gbt_regressor_clipped) == (700, 5) and size(Q.m10_random_forest) == (500, 18)
    real = MD.gbt_classifier
    monkeypatch.setattr(MD, "gbt_classifier", lambda *a, **k: keep(real(*a, **k)))
    assert size(Q.m14_early_stopping) == (4000, 4)
    monkeypatch.setattr(MD, "importance_select", lambda *a, **k: keep(MD.random_forest("y", depth=6), given=(a[3:], k)))
    with pytest.raises(Fitted):
        Q.m12_importance_select(spark, SF_SMALL)
    assert made["more"]["given"] == ((), {})
