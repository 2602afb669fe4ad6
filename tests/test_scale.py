"""Work is spread over the cores, and side tables over the broadcast bounds stay in slices."""

import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quire.operators import boosting as BO
from quire.operators import embed as EM
from quire.operators import groups as G
from quire.operators import lexicon as LT
from quire.operators import models as MD
from quire.operators import ngrams as NG
from quire.operators import ordered as O
from quire.operators import random_trees as RT
from quire.plans import q_models as Q


def test_training_tables_fill_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(100)
    assert BO.partitions(table, 100 * BO.MIN_ROWS, 1) == cores
    assert BO.partitions(table, 10, 1) == 1
    assert BO.partitions(table, 10, 100 * BO.PARTITION_BYTES) == 100
    assert BO.spread(table.coalesce(1), 3).rdd.getNumPartitions() == 3
    assert RT.MIN_ROWS


def test_blocks_and_one_block_give_the_same_boosted_trees(spark, monkeypatch):
    rows = [(i, i % 3, int((i * 37) % 11 > 4), Vectors.dense([(i * 37) % 11, i % 7, (i * 13) % 5])) for i in range(300)]
    data = spark.createDataFrame(rows, ["id", "fold", "label", "features"])
    one = BO.HistogramBooster(maxIter=3).fit_folds(data, "fold", 3)
    monkeypatch.setattr(BO, "MIN_ROWS", 50)
    many = BO.HistogramBooster(maxIter=3).fit_folds(data, "fold", 3)
    for a, b in zip(one, many):
        for s, t in zip(a.trees, b.trees):
            assert s.feature.tolist() == t.feature.tolist() and s.weight == pytest.approx(t.weight)


def test_vectors_over_the_bound_are_broadcast_in_slices(spark):
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(40)], "word string, vec array<float>")
    tokens = spark.createDataFrame([(k, p, f"w{(k * 7 + p * 3) % 45}") for k in range(20) for p in range(6)], "k long, pos int, word string")
    want = sorted(map(tuple, EM.token_vectors(tokens, vectors, "k").selectExpr("k", "pos", "word", "vec[0]").collect()))
    spark.conf.set("quire.broadcast.maxRows", "20")
    try:
        out = EM.token_vectors(tokens, vectors, "k")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.selectExpr("k", "pos", "word", "vec[0]").collect()))
    finally:
        spark.conf.unset("quire.broadcast.maxRows")
    assert got == want and "BroadcastHashJoin" in plan


def test_places_without_a_phrase_stay_out_of_the_joins(spark):
    df = spark.createDataFrame([("1", "a b c d e f"), ("2", None)], "k string, t string")
    hits = LT.phrase_hits(df, "k", LT.phrase_words("t"), {"x": spark.createDataFrame([("b c",)], "phrase string")}).collect()
    assert sorted((r["k"], r["phrase"] or "") for r in hits) == [("1", ""), ("1", "b c"), ("2", "")]


def test_running_sum_over_short_runs(spark, monkeypatch):
    monkeypatch.setattr(O, "RUN_BITS", 3)
    pdf = pd.DataFrame({"k": range(500), "x": [(i * 37) % 5 for i in range(500)]})
    out = O.running_sum(spark.createDataFrame(pdf).repartition(3), [F.col("k")], "x", "c").toPandas().sort_values("k")
    assert out["c"].tolist() == pdf["x"].cumsum().tolist()


def test_filtered_weights_equal_the_filter_then_the_weights(spark):
    tc = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("b", "z", 3), ("c", "x", 1), ("c", "y", 1)], "k string, term string, tf long")
    n = F.lit(3)
    want = NG.tfidf(NG.df_filter(tc, n, 2, 0.9), "k", n).collect()
    assert sorted(map(tuple, NG.filtered_tfidf(tc, "k", n, 2, 0.9).collect())) == sorted(map(tuple, want))


def test_word_totals_of_several_groupings_come_from_one_count(spark):
    df = spark.createDataFrame([("p", "u", "a b a"), ("p", "v", "b"), (None, "u", "c a")], "g string, h string, t string")
    counts = G.word_counts(df, ["g", "h"], "t")
    assert [tuple(r) for r in G.group_word_totals(counts.where("g is not null"), "g", "c").collect()] == [("p", 4, 2)]
    assert {tuple(r) for r in G.group_word_totals(counts, "h", "c").collect()} == {("u", 5, 3), ("v", 1, 1)}


def test_gradient_tables_have_a_partition_for_each_core_at_most(spark, monkeypatch):
    monkeypatch.setattr(MD, "ROWS_PER_TASK", 10)
    table = spark.range(2000).repartition(60)
    assert MD.by_gradients(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_fits_on_all_rows_have_a_partition_for_each_core_at_most(spark, monkeypatch):
    monkeypatch.setattr(MD, "ROWS_PER_TASK", 10)
    rows = [(str(i), i % 2, i % 3, Vectors.dense([float(i % 7), float(i)])) for i in range(600)]
    train = MD.by_rows(spark.createDataFrame(rows, ["sku_id", Q.LABEL, "fold", "features"]).repartition(60), 10)
    monkeypatch.setattr(Q, "model_tables", lambda *a: (train, train.drop("fold"), ["a", "b"]))
    seen = []

    def factory(table, names):
        def make(seed, n):
            est = MD.ridge(Q.LABEL, 0.5)(seed, n)
            fit = est.fit
            est.fit = lambda df: (seen.append(df.rdd.getNumPartitions()), fit(df))[1]
            return est
        return make
    assert Q._fit_all(spark, "", factory).count() == 1200
    assert seen == [spark.sparkContext.defaultParallelism] and train.rdd.getNumPartitions() == 60


def test_forests_keep_the_rows_nodes_and_grow_the_same_trees(spark):
    rows = [(i, int((i * 37) % 11 > 4 or i % 5 == 0), Vectors.dense([(i * 37) % 11, i % 7, (i * 13) % 5])) for i in range(400)]
    data = spark.createDataFrame(rows, ["id", "label", "features"]).repartition(3).cache()
    forest = MD.random_forest("label", trees=8, depth=9)(7, 400)
    assert forest.getCacheNodeIds()
    assert forest.fit(data).toDebugString.split("\n")[1:] == forest.copy({forest.cacheNodeIds: False}).fit(data).toDebugString.split("\n")[1:]
