"""Joins of derived side tables back to the rows.

Group statistics, vocabularies and lexicons are *derived* tables whose size
depends on the data (number of categories, distinct terms, ...). They are
broadcast only after their row count has been measured on a reliable
checkpoint; beyond the bound the join stays a shuffle join, which AQE can
still split when a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import scratch_path

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20


def max_broadcast_rows(spark) -> int:
    return int(spark.conf.get("quire.broadcast.maxRows", str(DEFAULT_MAX_BROADCAST_ROWS)))


def max_broadcast_bytes(spark) -> int:
    return int(spark.conf.get("quire.broadcast.maxBytes", str(DEFAULT_MAX_BROADCAST_BYTES)))


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of a table in one aggregate: 16 bytes for
    each value, the length of strings, and 16 for each element of arrays."""
    def width(name: str, kind: str):
        if kind in ("string", "binary"):
            return F.octet_length(name)
        return F.size(name) * 16 if kind.startswith(("array", "map")) else F.lit(0)

    sizes = [F.coalesce(width(n, k).cast("long"), F.lit(0)) + 16 for n, k in df.dtypes]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(sizes[1:], sizes[0])).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def materialize(df: DataFrame, name: str = "m") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: the input is computed once, the lineage is cut (a lost
    executor costs a re-read, not a recomputation) and the planner sees the
    table's real file sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a (written) table is within the broadcast bounds. Tables
    derived from it by filters, projections or roll-ups are no larger, so
    one measurement bounds them all."""
    spark = df.sparkSession
    n, size = measure(df)
    return n <= max_broadcast_rows(spark) and size <= max_broadcast_bytes(spark)


def side(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint for a side table: at once if the table it is made of
    was measured to be small, else by its own measure. A table of a few groups
    is broadcast however many rows its parent has."""
    return F.broadcast(df) if small else bounded(df)


def bounded(small: DataFrame, max_rows: int | None = None, cheap: bool = False) -> DataFrame:
    """Write a derived table, measure it, and mark it for broadcast only when
    its row count is within ``max_rows`` and its size within
    ``quire.broadcast.maxBytes``; otherwise the join stays a shuffle join.

    ``cheap=True``: the table is a filter / small aggregate of an already
    written table, so it is only counted, not written again."""
    spark = small.sparkSession
    limit = max_rows if max_rows is not None else max_broadcast_rows(spark)
    if not cheap:
        small = materialize(small)
    n, size = measure(small)
    return F.broadcast(small) if n <= limit and size <= max_broadcast_bytes(spark) else small


def attach(df: DataFrame, small: DataFrame, on, how: str = "left",
           max_rows: int | None = None) -> DataFrame:
    """Left-join a derived (usually aggregated) table to the rows."""
    return df.join(bounded(small, max_rows), on, how)


def attach_many(df: DataFrame, parts: list[tuple[DataFrame, list[str]]],
                how: str = "left", max_rows: int | None = None) -> DataFrame:
    """Attach several side tables; each is size-checked on its own."""
    for small, on in parts:
        df = attach(df, small, on, how, max_rows)
    return df


def literal_table(spark, values, name: str = "value") -> DataFrame:
    """A one-column table of caller-supplied literals (lexicons, stop words).

    Its size is the length of the Python list, so broadcasting it is safe."""
    return F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} string"))


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows with a match."""
    return df.join(bounded(other), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows without a match."""
    return df.join(bounded(other), on, "left_anti")
