"""Operator 2, chat formatting: collapse of cumulative snapshots.

Every turn gets a hash of its place, role and text; the hash of a prefix is
the running exclusive-or of its turns' hashes, twice 64 bits. A conversation
whose whole hash is another's shorter prefix is a snapshot of it. Anti-joins
keep the maximal conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import quoted, ready, written

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _render(role: Column, text: Column, turn: str) -> Column:
    head, rest = turn.split("{role}")
    middle, tail = rest.split("{text}")
    return F.concat(F.lit(head), role, F.lit(middle), text, F.lit(tail))


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                          text: str = "text", template: str = TURN) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation.

    Turns are ordered by their number, ties by role and text; repeats of a
    row count once. A null role is "unknown", a null text empty, a null turn
    number comes first; rows with a null conversation are left out. Equal
    conversations collapse to the smallest id, ``n_copies`` counts them. An
    empty table gives an empty table; columns beside the four named ones are
    ignored, whatever their names.

    Prefix hashes are made distinct before the anti-join, so a first turn
    that most conversations share is one row there."""
    ready(turns.sparkSession)
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(quoted(conv).alias("conv_id"), quoted(turn).alias("turn"),
                        F.coalesce(quoted(role), F.lit("unknown")).alias("role"),
                        F.coalesce(quoted(text), F.lit("")).alias("text")).filter("conv_id is not null")
    same = F.lag(F.struct("turn", "role", "text")).over(own).eqNullSafe(F.struct("turn", "role", "text"))
    rows = rows.withColumn("same", same).filter(~F.col("same")).drop("same").withColumn("nth", F.row_number().over(own))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    hashed = [F.bit_xor(F.xxhash64(F.lit(seed), "nth", "role", "text")).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    last = F.lead("nth").over(own).isNull().alias("last")
    prefixes = written(rows.select("conv_id", "nth", last, *hashed), "prefixes")
    keys = ["nth", "h1", "h2"]
    whole = prefixes.filter("last").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    kept = whole.join(prefixes.filter(~F.col("last")).select(*keys).distinct(), keys, "left_anti")
    kept = written(kept.select("conv_id", F.col("nth").alias("n_turns"), "n_copies"), "maximal")
    said = rows.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", _render(F.col("role"), F.col("text"), template).alias("said")))).alias("turns"))
    return said.join(kept, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies",
                                             F.array_join(F.col("turns.said"), "").alias("rendered"))
