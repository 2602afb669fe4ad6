"""Distributed models on Spark ML.

The driver only orchestrates: each fold's fit and transform are Spark jobs
over the partitioned data. The training table is written once before the
fold loop so the fits read materialised features instead of re-running the
feature plan; folds and seeds are fitted side by side from a bounded pool of
threads, boosted trees of all folds in the same jobs.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.boosting import HistogramBooster, mean_score
from quire.operators.joins import bounded, materialize
from quire.operators.random_trees import RandomTrees

#: Fits that run side by side.
THREADS = 8
#: Rows of a training table in one partition.
ROWS_PER_TASK = 20_000
#: Rows of one partition of a table for ``by_gradients``: every pass sends sums as large as the model from its partitions.
SPARSE_ROWS_PER_TASK = 200_000
_running = threading.local()

#: (seed, rows it is fitted on) -> estimator
EstimatorFactory = Callable[[int, int], Estimator]


def assemble(df: DataFrame, cols: list[str], out: str = "features", add_const: bool = False) -> DataFrame:
    """Ordered feature columns -> one vector; invalid values kept (NaN),
    optionally a constant 1.0 column appended (boosted-tree convention)."""
    cols = list(cols)
    if add_const:
        df = df.withColumn("_one", F.lit(1.0))
        cols.append("_one")
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def positive_score(model_output: DataFrame, out: str = "pred") -> DataFrame:
    """Probability of class 1 when the model has one, else the prediction."""
    if "probability" in model_output.columns:
        return model_output.withColumn(out, vector_to_array("probability")[1])
    return model_output.withColumn(out, F.col("prediction").cast("double"))


def oof_predict(train: DataFrame, test: DataFrame | None, key: str, label: str, fold_col: str,
                n_folds: int, make: EstimatorFactory, seed: int = 0,
                features: str = "features", is_written: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """M2: for each fold k fit on the other folds, predict fold k (out of
    fold) and the test rows. Returns (key, fold, pred) for the training rows
    and (key, pred) test predictions averaged over the fold models.

    Both tables are written once, as keys and vectors, so no fold computes
    features again; ``is_written`` says that the caller did so."""
    if not is_written:
        train, test = write_tables(train, test, key, label, fold_col, features)
    sizes = {r[fold_col]: r["n"] for r in train.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    fits = [make(seed, sum(sizes.values()) - sizes.get(k, 0)) for k in range(n_folds)]
    if isinstance(fits[0], HistogramBooster):
        return _scored([fits[0].fit_folds(train, fold_col, n_folds)], train, test, key, fold_col, features)

    def fold(k: int) -> tuple[DataFrame, DataFrame | None]:
        model = fits[k].fit(train.where(F.col(fold_col) != k))
        own = positive_score(model.transform(train.where(F.col(fold_col) == k))).select(key, fold_col, "pred")
        if test is None:
            return materialize(own, "oof"), None
        return materialize(own, "oof"), materialize(positive_score(model.transform(test)).select(key, F.lit(k).alias("_k"), "pred"), "oof")

    parts = concurrently(train.sparkSession, [partial(fold, k) for k in range(n_folds)])
    oof_df = reduce(DataFrame.unionByName, [p[0] for p in parts])
    if test is None:
        return oof_df, None
    return oof_df, reduce(DataFrame.unionByName, [p[1] for p in parts]).groupBy(key).agg(F.avg("pred").alias("pred"))


def _scored(runs, train, test, key, fold_col, features) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold and test scores of boosted fold models, averaged over the
    runs, in one pass over each table."""
    oof = materialize(train.select(key, fold_col, mean_score(runs, features, fold_col).alias("pred")), "oof")
    return oof, None if test is None else materialize(test.select(key, mean_score(runs, features).alias("pred")), "oof")


def concurrently(spark: SparkSession, tasks: list[Callable], threads: int = THREADS) -> list:
    """The results of ``tasks``, run from a bounded pool of threads that share
    the session, each in a scheduler pool of its own: small jobs of
    independent fits fill the executors together. Inside such a thread,
    further tasks run one after the other."""
    if getattr(_running, "inside", False) or len(tasks) < 2:
        return [t() for t in tasks]

    def run(i: int):
        _running.inside = True
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % threads}")
        try:
            return tasks[i]()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            _running.inside = False
    with ThreadPoolExecutor(min(threads, len(tasks))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), range(len(tasks))))


def write_tables(train: DataFrame, test: DataFrame | None, key: str, label: str, fold_col: str,
                 features: str = "features") -> tuple[DataFrame, DataFrame | None]:
    """The score tables (key, label, fold, vector) and (key, vector), written."""
    return (by_rows(materialize(train.select(key, label, fold_col, features))),
            None if test is None else by_rows(materialize(test.select(key, features))))


def by_rows(table: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A written table in as few partitions as its rows ask for: a fit runs
    hundreds of jobs over it, and each pays for every partition."""
    n = table.count()
    return table.coalesce(max(1, -(-n // rows)))


def by_gradients(table: DataFrame) -> DataFrame:
    """A written table for fits whose every pass returns sums of the model's
    own size (a dense gradient, the bins of all nodes of a level) from each
    partition: a partition for each core, more above SPARSE_ROWS_PER_TASK."""
    n, cores = table.count(), table.sparkSession.sparkContext.defaultParallelism
    return table.coalesce(max(1, -(-n // SPARSE_ROWS_PER_TASK), min(cores, -(-n // ROWS_PER_TASK))))


def bagged(train: DataFrame, test: DataFrame | None, key: str, label: str, fold_col: str, n_folds: int,
           make: EstimatorFactory, seeds: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """M3: (key, pred) out of fold and (key, pred) of the test rows, averaged
    over several seeds; the tables are written once for all seeds, and the
    seeds are fitted side by side."""
    train, test = write_tables(train, test, key, label, fold_col)
    first = make(seeds[0], train.count())
    if isinstance(first, HistogramBooster):
        oof, tst = _scored(first.fit_runs(train, fold_col, n_folds, seeds), train, test, key, fold_col, "features")
        return oof.select(key, "pred"), tst
    runs = concurrently(train.sparkSession, [partial(oof_predict, train, test, key, label, fold_col, n_folds, make, s, is_written=True)
                                             for s in seeds])

    def mean(parts):
        return reduce(DataFrame.unionByName, [p.select(key, "pred") for p in parts]).groupBy(key).agg(F.avg("pred").alias("pred"))
    return mean([r[0] for r in runs]), None if test is None else mean([r[1] for r in runs])


def label_column(label: str) -> str:
    return f"_labels_{label}"


def with_labels(weights: DataFrame, rows: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Term weights with, for each label, the list of its values in the rows
    of the key. Right after weights were worked out by key this join doesn't
    shuffle them; each ``multinomial_nb`` would shuffle them once more."""
    known = rows.groupBy(key).agg(*[F.collect_list(c).alias(label_column(c)) for c in labels])
    return weights.join(known, key)


def multinomial_nb(weights: DataFrame, labels: DataFrame, key: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """(key, label, prob), multinomial naive Bayes of long-form
    (key, term, weight) features, fitted on the rows of ``labels`` (key,
    label) and scored on them. Any vocabulary: every term's class weights are
    one grouped sum, no term is hashed, dropped or gathered on the driver.
    Weights that carry their keys' labels (``with_labels``) are not joined with them."""
    known = labels.where(F.col(label).isNotNull()).select(key, label)
    carried = label_column(label) in weights.columns
    labelled = (weights.select("term", "weight", F.explode(label_column(label)).alias(label)) if carried else weights.join(known, key))
    of_class = materialize(labelled.groupBy("term", label).agg(F.sum("weight").alias("w")))
    totals = of_class.groupBy(label).agg(F.sum("w").alias("total"))
    vocabulary = of_class.agg(F.countDistinct("term")).scalar()
    rows = known.agg(F.count(F.lit(1))).scalar()
    classes = (known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(totals, label, "left")
               .select(label, F.ln(F.col("n") / rows).alias("prior"),
                       F.ln(F.coalesce("total", F.lit(0.0)) + F.lit(smoothing) * vocabulary).alias("norm")))
    mass = known.join(weights.groupBy(key).agg(F.sum("weight").alias("mass")), key, "left").select(
        key, F.coalesce("mass", F.lit(0.0)).alias("mass"))
    # a term that a class never has counts ln(smoothing); the sum adds what present terms have beyond that
    extra = of_class.select("term", label, (F.ln(F.col("w") + smoothing) - math.log(smoothing)).alias("more"))
    found = (weights.join(bounded(extra), "term").groupBy(key, label)
             .agg(F.sum(F.col("weight") * F.col("more")).alias("more")))
    every = classes.agg(F.collect_list(F.struct(label, "prior", "norm"))).scalar()
    score = (mass.select(key, "mass", F.inline(every)).join(found, [key, label], "left")
             .withColumn("s", F.col("prior") + F.col("mass") * (math.log(smoothing) - F.col("norm"))
                         + F.coalesce("more", F.lit(0.0))))
    own = Window.partitionBy(key)
    score = score.withColumn("e", F.exp(F.col("s") - F.max("s").over(own)))
    return score.select(key, label, (F.col("e") / F.sum("e").over(own)).alias("prob"))


# ------------------------------------------------------------------ estimators
def logistic(label: str, c: float = 1.0) -> EstimatorFactory:
    """M4: L2 logistic regression; the penalty 1 / (2 c) on the sum of squares
    of the unscaled weights stands against the summed loss of the rows that
    are fitted, so Spark's regParam for mean loss is 1 / (c n)."""
    return lambda seed, n: LogisticRegression(labelCol=label, featuresCol="features", maxIter=200, tol=1e-9,
                                              standardization=False, regParam=1.0 / (c * max(n, 1)))


def l1_logistic(label: str, alpha: float = 0.0001) -> EstimatorFactory:
    """M5: L1 logistic regression with penalty ``alpha`` on mean loss and
    unscaled weights."""
    return lambda seed, n: LogisticRegression(labelCol=label, featuresCol="features", maxIter=100,
                                              standardization=False, regParam=alpha, elasticNetParam=1.0)


def ridge(label: str, y_std: float, alpha: float = 1.0) -> EstimatorFactory:
    """M7: ridge with penalty alpha on the sum of squares. Spark scales the
    label by its std, hence regParam = alpha / n * std(y)."""
    return lambda seed, n: LinearRegression(labelCol=label, featuresCol="features", solver="normal",
                                            elasticNetParam=0.0, standardization=False,
                                            regParam=alpha / max(n, 1) * y_std)


def gbt_classifier(label: str, max_iter: int = 200, depth: int = 4, step: float = 0.05,
                   validation: str | None = None, patience: int = 33, **more) -> EstimatorFactory:
    """Boosted trees of first and second derivatives on histograms;
    with ``validation`` the fit ends when the loss on the rows flagged by that
    column has not fallen for ``patience`` rounds, and keeps the trees of its
    best round."""
    return lambda seed, n: HistogramBooster(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=depth,
                                            stepSize=step, seed=seed, patience=patience, validationIndicatorCol=validation, **more)


def gbt_regressor(label: str, max_iter: int = 700, depth: int = 5, step: float = 0.03) -> EstimatorFactory:
    """M9: boosted regression trees (predictions clipped by the caller). A
    single model of many deep rounds is faster with Spark's own trees, whose
    levels cost no Python job."""
    return lambda seed, n: GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=depth,
                                        stepSize=step, seed=seed)


def extra_trees(label: str, trees: int = 1000, depth: int = 18) -> EstimatorFactory:
    """Extra-random trees, entropy, no bootstrap."""
    return lambda seed, n: RandomTrees(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)


def random_forest(label: str, trees: int = 500, depth: int = 18, impurity: str = "entropy") -> EstimatorFactory:
    """Random forest. Each row's nodes are kept from level to level:
    the same trees, but no level walks down from their roots."""
    return lambda seed, n: RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                                                  impurity=impurity, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True)


def mlp(label: str, n_features: int, hidden: int = 128, max_iter: int = 5) -> EstimatorFactory:
    """One hidden layer, L-BFGS."""
    return lambda seed, n: MultilayerPerceptronClassifier(labelCol=label, featuresCol="features",
                                                          layers=[n_features, hidden, 2], solver="l-bfgs",
                                                          maxIter=max_iter, seed=seed)


def importance_select(train: DataFrame, label: str, names: list[str], trees: int = 500,
                      depth: int = 6, seed: int = 0) -> tuple[list[int], list[float]]:
    """Indices of the features whose forest importance is at least the
    mean importance, and all importances (one small vector on the driver)."""
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                                   seed=seed).fit(by_gradients(train))
    imp = model.featureImportances.toArray().tolist()
    mean = sum(imp) / len(imp) if imp else 0.0
    return [i for i, v in enumerate(imp) if v >= mean], imp


def slice_features(df: DataFrame, indices: list[int], out: str = "selected") -> DataFrame:
    return VectorSlicer(inputCol="features", outputCol=out, indices=indices).transform(df)


def oof_selected(train: DataFrame, key: str, label: str, fold_col: str, kept: list[list[int]], make: EstimatorFactory,
                 seed: int = 0) -> DataFrame:
    """(key, fold, pred), each fold's rows scored by a model that is
    fitted on the other folds and on the features kept for that fold alone."""
    train, _ = write_tables(train, None, key, label, fold_col)

    def fold(k: int) -> DataFrame:
        sliced = slice_features(train, kept[k], "_kept").drop("features").withColumnRenamed("_kept", "features")
        others = sliced.where(F.col(fold_col) != k)
        model = make(seed, others.count()).fit(others)
        own = positive_score(model.transform(sliced.where(F.col(fold_col) == k)))
        return materialize(own.select(key, fold_col, "pred"), "oof")
    return reduce(DataFrame.unionByName, concurrently(train.sparkSession, [partial(fold, k) for k in range(len(kept))]))
