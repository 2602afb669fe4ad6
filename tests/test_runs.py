"""Prediction runs: partitioned writes, reruns of one part, metadata of names."""

import glob
import os

from pyspark.sql import functions as F

from quire.operators import stack as ST


def runs(spark):
    rows = [(i, "conciseness", "etc_v1", "title.boc", 0, 0, i % 3, i / 10) for i in range(9)]
    return spark.createDataFrame(rows, "id int, label string, model string, features string, fold_set int, run int, fold int, pred double")


def test_a_rerun_replaces_its_own_folder_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    ST.write_run(runs(spark), path)
    before = set(glob.glob(path + "/**/*.parquet", recursive=True))
    ST.write_run(runs(spark).where("fold = 1").withColumn("pred", F.lit(9.0)), path)
    after = set(glob.glob(path + "/**/*.parquet", recursive=True))
    assert all("fold=1" in p for p in before ^ after) and before & after and before - after
    ST.write_run(runs(spark).where("fold = 0").withColumn("run", F.lit(1)), path)
    out = ST.read_predictions(spark, path)
    got = sorted((r["id"], r["run"], r["pred"]) for r in out.collect())
    want = [(i, 0, 9.0 if i % 3 == 1 else i / 10) for i in range(9)] + [(i, 1, i / 10) for i in (0, 3, 6)]
    assert got == sorted(want)
    meta = ST.path_metadata(out, ST.RUN_FIELDS)
    assert meta.where("path_label <> label or path_features <> features or path_run <> run or path_fold <> fold").count() == 0
    assert {r["path_model"] for r in meta.collect()} == {"etc_v1"}


def test_no_rows_replace_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    ST.write_run(runs(spark), path)
    ST.write_run(runs(spark).where("id < 0"), path)
    assert ST.read_predictions(spark, path).count() == 9 and os.path.isdir(path)


def test_dotted_names(spark):
    df = spark.createDataFrame([("conciseness.etc_v1.title.boc.5grams.run0.full.csv", "pred/Set2"),
                                ("clarity.nbc.title.run12.full.csv", "pred/Set0/"), ("notes.txt", "pred"), (None, None)],
                               "name string, folder string")
    got = [tuple(r)[2:] for r in ST.run_names(df, "name", "folder").collect()]
    assert got == [("conciseness", "etc_v1", "title.boc.5grams", 0, 2), ("clarity", "nbc", "title", 12, 0),
                   (None, None, None, None, None), (None, None, None, None, None)]
