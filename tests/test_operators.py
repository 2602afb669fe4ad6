"""Invariants of the table-level operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import encode as EN
from quire.operators import groups as G
from quire.operators import metrics as MT
from quire.operators import ngrams as NG
from quire.operators.folds import stratified_folds
from quire.operators.ordered import ordered_index, running_sum


def test_ordered_index_is_consecutive(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    idx = ordered_index(df, [F.col("v")], "i").select("v", "i").toPandas().sort_values("v")
    assert idx["i"].tolist() == list(range(5000))
    assert (idx["v"] == idx["i"]).all()


def test_running_sum_matches_cumsum(spark):
    pdf = pd.DataFrame({"k": range(3000), "x": [(i * 37) % 5 for i in range(3000)]})
    df = spark.createDataFrame(pdf).repartition(5)
    out = running_sum(df, [F.col("k")], "x", "c").toPandas().sort_values("k")
    assert out["c"].tolist() == pdf["x"].cumsum().tolist()


def test_entropy_drops_null_children_but_counts_them_in_parent(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "p string, c string")
    e = {r["p"]: r["e"] for r in G.entropy(df, "p", "c", "e").collect()}
    import math
    assert e["a"] == pytest.approx(-2 * (1 / 3) * math.log(1 / 3))
    assert e["b"] == pytest.approx(0.0)


def test_one_row_group_std_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "k string, x double")
    st = {r["k"]: r["s"] for r in G.group_stats(df, "k", {"s": F.stddev_samp("x")}).collect()}
    assert st["a"] is None and st["b"] == pytest.approx(2 ** 0.5)


def test_target_encoding_unseen_gets_prior(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("c", None)], "k string, y int")
    tr = df.where(F.col("y").isNotNull())
    out = {r["k"]: r["te"] for r in EN.target_mean_encode(df, tr, "k", "y", "te").collect()}
    assert out == {"a": 0.5, "b": 1.0, "c": pytest.approx(2 / 3)}


def test_label_codes_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    out = {r["k"]: r["code"] for r in EN.label_codes(df, "k").collect()}
    assert out == {"a": 0, "b": 1, "c": 2}


def test_row_local_term_counts_equal_grouped(spark):
    df = spark.createDataFrame([("k1", "ab ab b"), ("k2", ""), ("k3", "abc")], "k string, s string")
    terms = NG.char_ngrams("s", 1, 2)
    a = sorted(map(tuple, NG.term_counts(df, "k", terms).collect()))
    b = sorted(map(tuple, NG.term_counts(df, "k", terms, unique_key=False).collect()))
    assert a == b and ("k3", "ab", 1) in a and not any(r[0] == "k2" for r in a)


def test_char_ngrams_short_text(spark):
    df = spark.createDataFrame([("ab",)], "s string")
    assert sorted(df.select(F.explode(NG.char_ngrams("s", 1, 3))).toPandas().iloc[:, 0]) == ["a", "ab", "b"]


def test_stratified_folds_balanced(spark):
    pdf = pd.DataFrame({"k": [f"x{i}" for i in range(1000)], "y": [int(i % 3 == 0) for i in range(1000)]})
    f = stratified_folds(spark.createDataFrame(pdf), "k", "y", 10, 2017).toPandas()
    assert f["k"].is_unique and len(f) == 1000
    per = f.groupby(["y", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 1


def test_auc_with_ties_equals_pairwise(spark):
    pdf = pd.DataFrame({"g": [1] * 8, "y": [1, 0, 1, 0, 1, 0, 0, 1], "p": [.9, .9, .5, .3, .3, .1, .2, .8]})
    auc = MT.roc_auc(spark.createDataFrame(pdf), ["g"], "y", "p").first()["auc"]
    pos, neg = pdf[pdf.y == 1].p, pdf[pdf.y == 0].p
    pair = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(pair)


def test_mine_attributes_inline(spark):
    from quire.functions.items import extract_items
    html = ["<ul><li>Color : red</li><li>Size: L</li></ul>", "<ul><li>color: blue</li><li>plain</li></ul>",
            "Size: M no list"]
    df = spark.createDataFrame([(h,) for h in html], "d string")
    items = df.select(extract_items("d").alias("items"), "d")
    out = {r["att"]: r["count"] for r in G.mine_attributes(items, "items", "d").collect()}
    assert out == {"color": 2, "size": 2}


def test_exact_median_matches_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 2001), "x": rng.integers(0, 50, 2001).astype(float)})
    pdf.loc[pdf.index[:5], "x"] = np.nan
    df = spark.createDataFrame(pdf).repartition(6)
    got = {r["g"]: r["m"] for r in G.exact_median(df.where(~F.isnan("x")), "g", "x", "m").collect()}
    want = pdf.dropna().groupby("g")["x"].median().to_dict()
    assert got == pytest.approx(want)


def test_exact_median_sets_with_null_keys(spark):
    pdf = pd.DataFrame({"a": ["x", "x", "y", None, "y", "x"], "b": [1, 2, 1, 2, 2, 1],
                        "v": [1.0, 5.0, 2.0, 9.0, 4.0, 3.0]})
    df = spark.createDataFrame(pdf, "a string, b long, v double")
    out = G.exact_median_sets(df, {"sa": ["a"], "sab": ["a", "b"]}, "v")
    got_a = {r["a"]: r["_m"] for r in out["sa"].collect()}
    got_ab = {(r["a"], r["b"]): r["_m"] for r in out["sab"].collect()}
    assert got_a == pdf.dropna().groupby("a")["v"].median().to_dict()
    assert got_ab == pdf.dropna().groupby(["a", "b"])["v"].median().to_dict()


def test_label_encode_many_per_column_ranks(spark):
    df = spark.createDataFrame([("b", "z"), ("a", "y"), ("c", "y"), ("a", None)], "p string, q string")
    out = EN.label_encode_many(df, ["p", "q"]).collect()
    assert {(r["p"], r["p_code"]) for r in out} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r["q"], r["q_code"]) for r in out} == {("y", 0), ("z", 1), (None, None)}


def test_std_of_large_prices(spark):
    rows = [("a", 1e9 + i % 4) for i in range(200)] + [("b", 2e12), ("b", 2e12 + 3)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    st = {r["k"]: r["s"] for r in G.group_stats(df, "k", {"s": F.stddev_samp("x")}).collect()}
    assert st["a"] == pytest.approx(1.1208, abs=1e-4) and st["b"] == pytest.approx(3 / 2 ** 0.5)


def test_listings_round_trip(spark, tmp_path):
    from quire.schema import LISTING
    from quire.sources import io as IO
    odd = ["  lead trail  ", "", None, 'say "hi", then\nnext "line"', "a,b", " \n "]
    rows = [tuple((odd[(i + j) % len(odd)] if f.dataType.simpleString() == "string" else float(i)) for j, f in enumerate(LISTING.fields))
            for i in range(len(odd))]
    from pyspark.sql.types import StructField, StructType
    df = spark.createDataFrame(rows, StructType([StructField(f.name, f.dataType) for f in LISTING.fields]))
    IO.write_listings_csv(df, str(tmp_path / "x"))
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(key, IO.read_listings(spark, str(tmp_path / "x")).collect())) == sorted(map(key, df.collect()))


def test_submission_is_ordered_and_keyed(spark, tmp_path):
    from quire.sources import io as IO
    df = spark.createDataFrame([(f"k{i:03d}", i / 10) for i in range(200)], "sku_id string, pred double").repartition(5)
    IO.write_submission(df, str(tmp_path / "s"))
    lines = [x for f in sorted((tmp_path / "s").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x.split(",")[0] for x in lines] == sorted(r["sku_id"] for r in df.collect())
