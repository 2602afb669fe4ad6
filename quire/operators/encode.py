"""Category encodings.

Label codes are computed on the *distinct* values only (ordered with the
distributed index) and attached with a size-checked join. Target and
leave-one-out encodings are per-value (sum, count) aggregates attached to
the rows; the global mean is a scalar sub-query (one value, planned once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.groups import value_counts
from quire.operators.joins import bounded, fits_broadcast, materialize, side
from quire.operators.ordered import ordered_index


def label_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """(value, code): rank of each distinct non-null value in sorted order,
    from 0 (LabelEncoder semantics)."""
    vals = df.select(col).where(F.col(col).isNotNull()).distinct()
    return ordered_index(vals, [F.col(col)], name)


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """G1: replace ``col`` by its label code in column ``out``."""
    out = out or f"{col}_code"
    return df.join(bounded(label_codes(df, col, out)), col, "left")


def label_encode_many(df: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """G1 for several string columns at once: one scan expands each row into
    (column, value) pairs, one distributed index ranks the distinct pairs,
    and each column's codes are its ranks minus the column's first rank
    (one row per column). The written code table is measured once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("string").alias("_v"))
                                for c in cols]))
    vals = df.select(pairs.alias("_p")).select("_p._col", "_p._v").where(F.col("_v").isNotNull()).distinct()
    idx = ordered_index(vals, [F.col("_col"), F.col("_v")], "_i")
    starts = idx.groupBy("_col").agg(F.min("_i").alias("_s"))
    codes = materialize(idx.join(F.broadcast(starts), "_col")
                        .select("_col", "_v", (F.col("_i") - F.col("_s")).alias("_code")))
    small = fits_broadcast(codes)
    out = df
    for c in cols:
        t = codes.where(F.col("_col") == c).select(F.col("_v").alias(c), F.col("_code").alias(f"{c}{suffix}"))
        out = out.join(side(t, small), c, "left")
    return out


def collapse_rare(df: DataFrame, col: str, min_count: int, other: str = "Others",
                  out: str | None = None) -> DataFrame:
    """Values seen fewer than ``min_count`` times become ``other``."""
    out = out or col
    rare = value_counts(df, col, "_n").where(F.col("_n") < min_count).select(col, F.lit(True).alias("_rare"))
    j = df.join(bounded(rare), col, "left")
    return j.withColumn(out, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(col))).drop("_rare")


def one_hot_long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One-hot blocks of several label-encoded columns side by side, in
    long form (key, column_name, index): index = code + width of the blocks
    before it, i.e. the column of the 1 in the stacked sparse matrix.

    Ranking the distinct (column position, value) pairs once gives exactly
    that index; rows are expanded into their pairs and joined to it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_pos"), F.lit(c).alias("column_name"),
                                         F.col(c).cast("string").alias("_v")) for i, c in enumerate(cols)]))
    rows = df.select(key, pairs.alias("_p")).select(key, "_p._pos", "_p.column_name", "_p._v") \
        .where(F.col("_v").isNotNull())
    idx = materialize(ordered_index(rows.select("_pos", "_v").distinct(), [F.col("_pos"), F.col("_v")], "index"))
    return (rows.join(side(idx, fits_broadcast(idx)), ["_pos", "_v"])
            .select(key, "column_name", "index"))


def _stats(train: DataFrame, col: str, label: str) -> DataFrame:
    return train.groupBy(col).agg(F.sum(F.col(label).cast("double")).alias("_s"),
                                  F.count(F.col(label)).alias("_n"))


def target_mean_encode(df: DataFrame, train: DataFrame, col: str, label: str, out: str) -> DataFrame:
    """Mean label of the value over the training rows; a value not seen
    in training gets the global training mean."""
    stats = bounded(_stats(train, col, label))
    prior = train.select(F.avg(F.col(label).cast("double"))).scalar()
    return (df.join(stats, col, "left")
            .withColumn(out, F.coalesce(F.col("_s") / F.col("_n"), prior))
            .drop("_s", "_n"))


def leave_one_out_encode(df: DataFrame, train: DataFrame, col: str, label: str, out: str,
                         is_train: F.Column, noise_sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """On training rows (sum - y) / (n - 1) (the global mean when the
    value occurs once), elsewhere sum / n (unseen: the global mean).
    ``noise_sigma > 0`` multiplies training encodings by N(1, sigma)."""
    stats = bounded(_stats(train, col, label))
    prior = train.select(F.avg(F.col(label).cast("double"))).scalar()
    y = F.col(label).cast("double")
    loo = F.when(F.col("_n") > 1, (F.col("_s") - y) / (F.col("_n") - 1)).otherwise(prior)
    if noise_sigma > 0:
        loo = loo * (F.lit(1.0) + F.randn(seed) * noise_sigma)
    enc = F.when(is_train, loo).otherwise(F.coalesce(F.col("_s") / F.col("_n"), prior))
    return df.join(stats, col, "left").withColumn(out, enc).drop("_s", "_n")
