"""Queries: ordered operators (W1-W5) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import tokenise_alpha
from quire.operators import groups as G
from quire.operators.ordered import last_per_block, ordered_index, running_sum, top_k
from quire.plans.common import C, D, r
from quire.plans.oracle_views import views
from quire.plans.registry import query
from quire.sources import lexicons as LX


@query("w1_transform_window", oracle=views("d") + """
select sku_id, round(cast(avg(cast(price as decimal(24, 6))) over (partition by country) as double), 6) as lang_price_mean,
  cast(count(*) over (partition by country, category_lvl_2) as bigint) as lang_source_cnt
from d""")
def w1_transform_window(spark, sf_dir):
    """``groupby().transform()``: a group aggregate on every row, planned as
    aggregate + size-checked broadcast join (not a window that sends a
    whole group to one task)."""
    d = D(spark, sf_dir)
    d = G.attach_group_stats(d, "country", {"lang_price_mean": G.exact_avg("price")})
    d = G.attach_counts(d, ["country", "category_lvl_2"], "lang_source_cnt")
    return d.select("sku_id", r("lang_price_mean").alias("lang_price_mean"), "lang_source_cnt")


FLAG_SQL = "case when country = 'my' then 1 else 0 end"


@query("w2_running_flag_block", oracle=views("c") + f"""
select sku_id, cast(sum({FLAG_SQL}) over (order by sku_id rows between unbounded preceding and current row) as bigint)
  as flag1 from c""")
def w2_running_flag_block(spark, sf_dir):
    """Running count of 'my' listings in key order: per-range-partition
    prefix sums plus the totals of all earlier partitions (no single-task
    global window)."""
    c = C(spark, sf_dir).select("sku_id", F.when(F.col("country") == "my", 1).otherwise(0).alias("flag"))
    out = running_sum(c, [F.col("sku_id")], "flag", "flag1")
    return out.select("sku_id", F.col("flag1").cast("long").alias("flag1"))


@query("w3_last_row_per_block", oracle=views("c") + f"""
select sku_id, case when row_number() over (partition by flag1 order by sku_id desc) = 1 then flag1 end as flag1
from (select sku_id, cast(sum({FLAG_SQL}) over (order by sku_id rows between unbounded preceding and current row)
      as bigint) as flag1 from c)""")
def w3_last_row_per_block(spark, sf_dir):
    """The running count kept only on the last row of each block of equal
    counts (null elsewhere)."""
    c = C(spark, sf_dir).select("sku_id", F.when(F.col("country") == "my", 1).otherwise(0).alias("flag"))
    run = running_sum(c, [F.col("sku_id")], "flag", "flag1").select("sku_id", F.col("flag1").cast("long"))
    return last_per_block(run, "flag1", "sku_id", "flag1", "flag1_last").select(
        "sku_id", F.col("flag1_last").alias("flag1"))


@query("w4_rank_by_importance", oracle=views("c") + """
select column_name, value, count, cast(row_number() over (order by count desc, column_name, value) as bigint) as rank
from (select 'category_lvl_1' as column_name, category_lvl_1 as value, count(*) as count from c group by 2
      union all select 'category_lvl_2', category_lvl_2, count(*) from c group by 2
      union all select 'category_lvl_3', category_lvl_3, count(*) from c where category_lvl_3 is not null group by 2)""")
def w4_rank_by_importance(spark, sf_dir):
    """Rank (from 1) of category values by frequency, descending, computed
    with the distributed ordered index."""
    c = C(spark, sf_dir)
    parts = [G.value_counts(c, k).select(F.lit(k).alias("column_name"), F.col(k).alias("value"), "count")
             for k in ("category_lvl_1", "category_lvl_2", "category_lvl_3")]
    t = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ordered_index(t, [F.col("count").desc(), F.col("column_name"), F.col("value")], "rank", start=1)


TOP_K = 150


@query("w5_top_k", oracle=views("tt") + f"""
select word, count(*) as count from tt group by word order by count desc, word limit {TOP_K}""")
def w5_top_k(spark, sf_dir):
    """The 150 most frequent title tokens (ties by token): TakeOrdered,
    i.e. per-partition top-k then one merge of at most k rows each."""
    toks = D(spark, sf_dir).select(F.explode(tokenise_alpha("title")).alias("word"))
    return top_k(G.value_counts(toks, "word"), [F.col("count").desc(), F.col("word")], TOP_K)


@query("u1_stack_train_test", oracle=views("d") + """
select sku_id, split from d where split = 'trn' union all select sku_id, split from d where split = 'tst'""")
def u1_stack_train_test(spark, sf_dir):
    """Train and test parts stacked by name, duplicates kept."""
    d = D(spark, sf_dir).select("sku_id", "split")
    return d.where(F.col("split") == "trn").unionByName(d.where(F.col("split") == "tst"))


@query("u2_split_by_flag", oracle=views("d") + "select sku_id, conciseness from d where split = 'tst'")
def u2_split_by_flag(spark, sf_dir):
    """The test part selected by the split column, never by position."""
    return D(spark, sf_dir).where(F.col("split") == "tst").select("sku_id", "conciseness")


@query("u4_token_set_difference", oracle=views("d") + f"""
select sku_id, array_to_string(list_sort(list_filter(list_distinct(list_filter(string_split(lower(
  regexp_replace(title, '[^a-zA-Z]', ' ', 'g')), ' '), lambda x: x <> '')), lambda w: not list_contains(
  [{', '.join(repr(w) for w in LX.STOP_WORDS)}], w))), ' ') as tokens
from d""")
def u4_token_set_difference(spark, sf_dir):
    """Distinct title tokens minus a token set (sorted, space-joined)."""
    stops = F.array(*[F.lit(w) for w in LX.STOP_WORDS])
    t = F.array_sort(F.array_except(F.array_distinct(tokenise_alpha("title")), stops))
    return D(spark, sf_dir).select("sku_id", F.array_join(t, " ").alias("tokens"))
