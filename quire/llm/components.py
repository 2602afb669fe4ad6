"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of ``links``
    (a, b: long) that is not itself the smallest of its component.

    Alternating star operations: every node links its larger neighbours to
    the smallest neighbour, then its smaller neighbours likewise, until the
    table stays the same. Every round is a grouped minimum, which Spark
    aggregates before the shuffle, and a join whose hot keys AQE can split;
    each result is written to the shared folder. Loops and repeated links
    are allowed; an empty table gives an empty table."""
    pairs = written(_smaller_first(links), "links")
    for _ in range(max_rounds):
        after = written(_small_star(_large_star(pairs)), "links")
        old, new = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
                    for x in (pairs, after))
        pairs = after
        if tuple(old) == tuple(new):
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def _smaller_first(links: DataFrame) -> DataFrame:
    return (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter("a <> b").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _smaller_first(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _smaller_first(moved.union(least.select("a", F.col("m").alias("b"))))
