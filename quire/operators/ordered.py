"""Ordered operators (W1-W6) and the distributed ordered index.

A global ``row_number()`` without ``partitionBy`` runs in one task. The
index here is computed the scalable way: a range-partitioned sort, a
checkpoint that freezes partition contents, per-partition row counts (at
most one row per partition, so the offsets table has a proven bound), and
a local position inside each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.joins import materialize


#: Rows of a run: 2 to this power; one offset for each is broadcast.
RUN_BITS = 16


def ordered_index(df: DataFrame, order_cols, name: str = "idx", start: int = 0) -> DataFrame:
    """Attach a consecutive index following ``order_cols`` (ties must be
    broken by the caller so the order is total)."""
    tagged = (df.orderBy(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local + F.lit(start)).cast("long"))
            .drop("_pid", "_mid", "_off"))


def running_sum(df: DataFrame, order_cols, value, name: str) -> DataFrame:
    """Cumulative sum in row order, as a per-partition prefix sum plus
    the totals of all earlier range partitions.

    Ranges are cut into runs of RUN_ROWS rows in order; the prefix sum is a
    window over a run, so that no task holds a range."""
    tagged = (df.orderBy(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              # the partition is in the upper bits, so runs are numbered in row order
              .withColumn("_pid", F.shiftright("_mid", RUN_BITS)))
    tagged = materialize(tagged)
    totals = materialize(tagged.groupBy("_pid").agg(F.sum(value).alias("_t")))
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.sum(value).over(w))
            .drop("_pid", "_mid", "_off"))


def last_per_block(df: DataFrame, block, order_col, value, name: str) -> DataFrame:
    """Keep ``value`` on the last row (by ``order_col``) of each block,
    null elsewhere. The block's last key is found by aggregation (partial
    aggregation absorbs hot blocks) and joined back."""
    last = df.groupBy(block).agg(F.max(order_col).alias("_last"))
    out = df.join(last, block, "left")
    return out.withColumn(name, F.when(F.col(order_col) == F.col("_last"), F.col(value))).drop("_last")


def top_k(df: DataFrame, order_cols, k: int) -> DataFrame:
    """The first ``k`` rows in order (TakeOrdered: per-partition top-k
    then a final merge of at most k rows per partition)."""
    return df.orderBy(*order_cols).limit(k)


def top_k_per_group(df: DataFrame, group, order_cols, k: int, name: str = "rank") -> DataFrame:
    """``row_number`` within each group, keep ranks ``<= k``.

    Spark plans this as a WindowGroupLimit, which drops rows beyond rank k
    before the shuffle, so a hot group ships at most k rows per map task."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order_cols)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
