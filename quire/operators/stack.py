"""Stacking matrices from long-form prediction tables (M15-M17) and the
partitioned prediction dataset (S9, S12, U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import scratch_path


def stack_matrix(preds: DataFrame, key: str, model_col: str, models: list, pred: str = "pred",
                 prefix: str = "m") -> DataFrame:
    """One column per model. The pivot values are given explicitly,
    so Spark does not run a job to discover them and the plan is one
    aggregation keyed by ``key``."""
    wide = preds.groupBy(key).pivot(model_col, models).agg(F.first(pred))
    return wide.select(key, *[F.col(str(m)).alias(f"{prefix}{m}") for m in models])


def output_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return scratch_path(spark, name)


def write_predictions(preds: DataFrame, path: str, partition_cols: list[str]) -> None:
    """One Parquet dataset partitioned by the run metadata."""
    preds.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One partitioned read; partition values (label, model,
    fold, ...) come back as columns and filters on them prune folders."""
    return spark.read.parquet(path)


#: What identifies a part of a run, from the outer folder to the inner one.
RUN_FIELDS = ["label", "model", "features", "fold_set", "run", "fold"]


def write_run(preds: DataFrame, path: str, fields: list[str] = RUN_FIELDS) -> None:
    """Add predictions to a dataset partitioned by the run's metadata.

    Only the folders that ``preds`` has rows for are replaced (dynamic
    overwrite), so a rerun of one fold leaves every other part alone. Rows are
    gathered by folder before the write; a folder that holds much is split
    over several tasks."""
    gathered = preds.hint("rebalance", *[F.col(c) for c in fields])
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*fields).parquet(path)


def run_names(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """S12 (dotted form): label, model, features and run of names like
    ``label.model.features.run0.full.csv``, where features may have dots, and
    the fold set of a folder that ends in ``Set0``. A name of another form
    gives nulls."""
    form = r"^([^.]+)\.([^.]+)\.(.+)\.run(\d+)\.[^.]+\.csv$"
    parts = {c: F.regexp_extract(name, form, i + 1) for i, c in enumerate(("label", "model", "features", "run"))}
    if folder is not None:
        parts["fold_set"] = F.regexp_extract(folder, r"Set(\d+)/?$", 1)
    out = {c: F.when(v != "", v) for c, v in parts.items()}
    return df.select("*", *[(v.cast("int") if c in ("run", "fold_set") else v).alias(c) for c, v in out.items()])


def path_metadata(df: DataFrame, names: list[str]) -> DataFrame:
    """S12 (file-name form): ``name=value`` segments parsed from each row's
    source file path."""
    path = F.input_file_name()
    return df.select("*", *[F.regexp_extract(path, f"/{n}=([^/]+)/", 1).alias(f"path_{n}") for n in names])
