"""Queries: prediction datasets, stacking, blending and metrics
(S9, S12, U3, M15-M23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import metrics as MT
from quire.operators import stack as ST
from quire.plans.common import D, P, r
from quire.plans.oracle_views import views
from quire.plans.registry import query
from quire.sources.fixtures import predictions

MODELS = [1, 2, 3]
EXPECTED_MEAN = {"conciseness": 0.6585, "clarity": 0.923623177}


def _dataset(spark, sf_dir):
    path = ST.output_folder(spark, "predictions")
    ST.write_predictions(P(spark, sf_dir), path, ["model", "fold"])
    return ST.read_predictions(spark, path)


@query("s9_write_predictions", oracle=views("p") + "select sku_id, model, fold, pred from p")
def s9_write_predictions(spark, sf_dir):
    """Predictions written as one dataset partitioned by model and fold,
    read back whole."""
    return _dataset(spark, sf_dir).select("sku_id", F.col("model").cast("int"), F.col("fold").cast("int"), "pred")


@query("s12_run_metadata_from_path", oracle=views("p") + """
select cast(model as varchar) as path_model, cast(fold as varchar) as path_fold, count(*) as n from p group by 1, 2""")
def s12_run_metadata_from_path(spark, sf_dir):
    """Run metadata parsed from each file's path (name=value segments)."""
    ds = ST.path_metadata(_dataset(spark, sf_dir), ["model", "fold"])
    return ds.groupBy("path_model", "path_fold").agg(F.count(F.lit(1)).alias("n"))


RUNS_SQL = views("p", "p2") + """,
runs as (select sku_id, 'conciseness' as label, model, fold, case when model = 2 and fold = 3 then 1.0 - pred else pred end as pred from p
         union all select sku_id, 'clarity', model, fold, pred from p2)"""


def _runs(spark, sf_dir):
    """Both labels' predictions as runs on one feature set and fold set, and
    then model 2's fold 3 of conciseness once more with turned scores."""
    path = ST.output_folder(spark, "runs")
    for label in ("conciseness", "clarity"):
        preds = predictions(spark, sf_dir, label=label).withColumns(
            {"label": F.lit(label), "features": F.lit("title.words"), "fold_set": F.lit(0), "run": F.lit(0)})
        ST.write_run(preds, path)
        if label == "conciseness":
            again = preds.where((F.col("model") == 2) & (F.col("fold") == 3))
            ST.write_run(again.withColumn("pred", F.lit(1.0) - F.col("pred")), path)
    return ST.read_predictions(spark, path)


@query("s9_prediction_runs", oracle=RUNS_SQL + """
select sku_id, label, model, 'title.words' as features, 0 as fold_set, 0 as run, fold, round(pred, 6) as pred from runs""")
def s9_prediction_runs(spark, sf_dir):
    """Predictions of both labels in one dataset partitioned by label, model,
    feature set, fold set, run and fold, after the rerun of one fold."""
    return _runs(spark, sf_dir).select("sku_id", *ST.RUN_FIELDS, r("pred").alias("pred"))


@query("s12_run_registry", oracle=RUNS_SQL + """
select label as path_label, cast(model as varchar) as path_model, 'title.words' as path_features, '0' as path_fold_set,
  '0' as path_run, cast(fold as varchar) as path_fold, count(*) as n, round(avg(pred), 6) as mean_pred
from runs group by label, model, fold""")
def s12_run_registry(spark, sf_dir):
    """The registered runs by the metadata in their files' paths: rows and
    mean prediction of each part."""
    ds = ST.path_metadata(_runs(spark, sf_dir).select("pred"), ST.RUN_FIELDS)
    return ds.groupBy(*[f"path_{c}" for c in ST.RUN_FIELDS]).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("pred")).alias("mean_pred"))


@query("u3_concat_folds", oracle=views("p") + "select sku_id, fold, pred from p where model = 2")
def u3_concat_folds(spark, sf_dir):
    """The 10 validation parts of one model: a single read of the
    partitioned dataset with partition pruning on the model folder."""
    ds = _dataset(spark, sf_dir)
    return ds.where(F.col("model") == 2).select("sku_id", F.col("fold").cast("int"), "pred")


@query("m15_stack_matrix", oracle=views("d", "p") + """
select d.sku_id, d.conciseness, m1, m2, m3 from d join (
  select sku_id, max(case when model = 1 then pred end) as m1, max(case when model = 2 then pred end) as m2,
         max(case when model = 3 then pred end) as m3 from p group by sku_id) w using (sku_id)""")
def m15_stack_matrix(spark, sf_dir):
    """Stacking matrix: label plus one prediction column per model."""
    wide = ST.stack_matrix(P(spark, sf_dir), "sku_id", "model", MODELS)
    return D(spark, sf_dir).select("sku_id", "conciseness").join(wide, "sku_id")


@query("m16_stack_both_labels", oracle=views("d", "p", "p2") + """
select d.sku_id, d.conciseness, d.clarity, w.m1 as c_m1, w.m2 as c_m2, w.m3 as c_m3,
  k.m1 as k_m1, k.m2 as k_m2, k.m3 as k_m3
from d join (select sku_id, max(case when model = 1 then pred end) as m1, max(case when model = 2 then pred end) as m2,
                    max(case when model = 3 then pred end) as m3 from p2 group by sku_id) k using (sku_id) join (select sku_id, max(case when model = 1 then pred end) as m1, max(case when model = 2 then pred end) as m2,
                    max(case when model = 3 then pred end) as m3 from p group by sku_id) w using (sku_id)""")
def m16_stack_both_labels(spark, sf_dir):
    """Stacking block for both labels: the conciseness models' columns and
    the clarity models' columns attached by key."""
    wide = ST.stack_matrix(P(spark, sf_dir), "sku_id", "model", MODELS, prefix="c_m")
    other = ST.stack_matrix(predictions(spark, sf_dir, label="clarity"), "sku_id", "model", MODELS, prefix="k_m")
    return (D(spark, sf_dir).select("sku_id", "conciseness", "clarity")
            .join(wide, "sku_id").join(other, "sku_id"))


@query("m17_level2_feature_join", oracle=views("d", "p") + """
select w.sku_id, m1, m2, m3, cast(length(d.title) as bigint) as title_len from d
join (select sku_id, max(case when model = 1 then pred end) as m1, max(case when model = 2 then pred end) as m2,
             max(case when model = 3 then pred end) as m3 from p group by sku_id) w using (sku_id)""")
def m17_level2_feature_join(spark, sf_dir):
    """Level-2 features: stacking block joined with a text block by key;
    label columns dropped."""
    wide = ST.stack_matrix(P(spark, sf_dir), "sku_id", "model", MODELS)
    text = D(spark, sf_dir).select("sku_id", F.length("title").cast("long").alias("title_len"))
    return wide.join(text, "sku_id")


@query("m18_blend_linear", oracle=views("p") + """
select sku_id, round(0.35 * m1 + 0.65 * m2, 6) as blend_conc, round(0.30 * m1 + 0.70 * m3, 6) as blend_clar,
  round(0.6 * m2 + 0.4 * m3, 6) as blend_final
from (select sku_id, max(case when model = 1 then pred end) as m1, max(case when model = 2 then pred end) as m2,
             max(case when model = 3 then pred end) as m3 from p group by sku_id)""")
def m18_blend_linear(spark, sf_dir):
    """Linear blends 0.35/0.65, 0.30/0.70 and 0.6/0.4 of model columns."""
    w = ST.stack_matrix(P(spark, sf_dir), "sku_id", "model", MODELS)
    w = MT.blend(w, {"m1": 0.35, "m2": 0.65}, "blend_conc")
    w = MT.blend(w, {"m1": 0.30, "m3": 0.70}, "blend_clar")
    w = MT.blend(w, {"m2": 0.6, "m3": 0.4}, "blend_final")
    return w.select("sku_id", *[r(c).alias(c) for c in ("blend_conc", "blend_clar", "blend_final")])


@query("m19_average_folds", oracle=views("p") + "select sku_id, round(avg(pred), 6) as pred from p group by sku_id")
def m19_average_folds(spark, sf_dir):
    """Mean of the prediction sets per key."""
    return MT.average_sets(P(spark, sf_dir), "sku_id").select("sku_id", r("pred").alias("pred"))


def _rescaled_sql(view: str, label: str) -> str:
    return (f"select sku_id, round(least(greatest(a + ({EXPECTED_MEAN[label]} - avg(a) over ()), 0.0), 1.0), 6) as {label} "
            f"from (select sku_id, avg(pred) as a from {view} group by sku_id)")


@query("m20_rescale_to_mean", oracle=views("p", "p2") + "select * from (" + _rescaled_sql("p", "conciseness")
       + ") join (" + _rescaled_sql("p2", "clarity") + ") using (sku_id)")
def m20_rescale_to_mean(spark, sf_dir):
    """Averaged predictions of both labels shifted to their expected means,
    clipped to [0, 1]."""
    out = []
    for label, mean in EXPECTED_MEAN.items():
        avg = MT.average_sets(predictions(spark, sf_dir, label=label), "sku_id")
        out.append(MT.rescale_to_mean(avg, "pred", mean).select("sku_id", r("pred").alias(label)))
    return out[0].join(out[1], "sku_id")


LABELLED = views("d", "p") + ", lp as (select p.model, p.fold, d.conciseness as y, p.pred from d join p using (sku_id) " \
    "where d.conciseness is not null)"


def _labelled(spark, sf_dir):
    d = D(spark, sf_dir).where(F.col("conciseness").isNotNull()).select("sku_id", F.col("conciseness").alias("y"))
    return P(spark, sf_dir).join(d, "sku_id")


@query("m21_rmse", oracle=LABELLED + """
select model, fold, round(sqrt(avg((y - pred) * (y - pred))), 6) as rmse from lp group by model, fold
union all select model, -1, round(sqrt(avg((y - pred) * (y - pred))), 6) from lp group by model""")
def m21_rmse(spark, sf_dir):
    """RMSE per model and fold, and per model over all folds (fold -1)."""
    lp = _labelled(spark, sf_dir)
    per = MT.rmse(lp, ["model", "fold"], "y", "pred")
    tot = MT.rmse(lp, ["model"], "y", "pred").select("model", F.lit(-1).alias("fold"), "rmse")
    return per.unionByName(tot).select("model", "fold", r("rmse").alias("rmse"))


@query("m22_roc_auc", oracle=LABELLED + """
select a.model, a.fold, round(sum(case when a.pred > b.pred then 1.0 when a.pred = b.pred then 0.5 else 0 end)
  / (count(*)), 6) as auc
from lp a join lp b on a.model = b.model and a.fold = b.fold and a.y = 1 and b.y = 0
group by a.model, a.fold""")
def m22_roc_auc(spark, sf_dir):
    """ROC AUC per model and fold (ties count one half)."""
    lp = _labelled(spark, sf_dir)
    auc = MT.roc_auc(lp, ["model", "fold"], "y", "pred")
    return auc.where(F.col("auc").isNotNull()).select("model", "fold", r("auc").alias("auc"))


@query("m23_fold_score_summary", oracle=LABELLED + """
select model, round(avg(rmse), 6) as rmse_mean, round(stddev_pop(rmse), 6) as rmse_std
from (select model, fold, sqrt(avg((y - pred) * (y - pred))) as rmse from lp group by model, fold) group by model""")
def m23_fold_score_summary(spark, sf_dir):
    """Mean and population std of the fold RMSEs per model."""
    lp = _labelled(spark, sf_dir)
    s = MT.fold_summary(MT.rmse(lp, ["model", "fold"], "y", "pred"), ["model"], "rmse")
    return s.select("model", r("rmse_mean").alias("rmse_mean"), r("rmse_std").alias("rmse_std"))
