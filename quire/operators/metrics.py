"""Blending, rescaling and scoring (M18-M23) as aggregations.

Nothing is collected: global means are scalar sub-queries, per-group
metrics are ``groupBy`` aggregates, and the AUC uses a range-partitioned
prefix sum over distinct scores instead of a window over a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import bounded
from quire.operators.ordered import running_sum


def blend(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """Weighted sum of prediction columns."""
    expr = None
    for c, w in weights.items():
        term = F.col(c) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return df.withColumn(out, expr)


def average_sets(preds: DataFrame, key: str, pred: str = "pred", out: str = "pred") -> DataFrame:
    """Mean over several prediction sets of the same keys."""
    return preds.groupBy(key).agg(F.avg(pred).alias(out))


def rescale_to_mean(df: DataFrame, pred: str, expected: float, out: str | None = None) -> DataFrame:
    """Shift by (expected - mean) and clip to [0, 1]."""
    out = out or pred
    mean = df.select(F.avg(pred)).scalar()
    shifted = F.col(pred) + (F.lit(expected) - mean)
    return df.withColumn(out, F.least(F.greatest(shifted, F.lit(0.0)), F.lit(1.0)))


def rmse(df: DataFrame, groups: list[str], y: str, p: str, out: str = "rmse") -> DataFrame:
    """sqrt(mean((y - p)^2)) per group."""
    d = F.col(y).cast("double") - F.col(p)
    return df.groupBy(*groups).agg(F.sqrt(F.avg(d * d)).alias(out))


def roc_auc(df: DataFrame, groups: list[str], y: str, p: str, out: str = "auc") -> DataFrame:
    """Area under the ROC curve per group, ties counted one half.

    AUC = sum over positives of (negatives with a lower score + half the
    negatives with an equal score) / (P * N). Rows are first reduced to
    (group, score) counts; the negatives below each score come from a
    range-partitioned running sum minus the running sum at the group start.
    A group without both classes has no AUC (NULL)."""
    yv = F.col(y).cast("int")
    sc = (df.groupBy(*groups, p)
          .agg(F.sum(F.when(yv == 1, 1).otherwise(0)).alias("_pos"),
               F.sum(F.when(yv == 0, 1).otherwise(0)).alias("_neg")))
    cum = running_sum(sc, [F.col(g) for g in groups] + [F.col(p)], "_neg", "_cum")
    cum = cum.withColumn("_before", F.col("_cum") - F.col("_neg"))
    base = cum.groupBy(*groups).agg(F.min("_before").alias("_base"),
                                    F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    j = cum.join(bounded(base), groups)
    below = F.col("_before") - F.col("_base")
    contrib = F.col("_pos") * (below + F.col("_neg") * 0.5)
    return (j.groupBy(*groups)
            .agg(F.try_divide(F.sum(contrib).cast("double"),
                              (F.first("_P") * F.first("_N")).cast("double")).alias(out)))


def fold_summary(scores: DataFrame, groups: list[str], score: str) -> DataFrame:
    """Mean and population std of fold scores."""
    return scores.groupBy(*groups).agg(F.avg(score).alias(f"{score}_mean"),
                                       F.stddev_pop(score).alias(f"{score}_std"))
