"""Queries: HTML list-item operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import items as IT
from quire.plans.common import H, r
from quire.plans.oracle_views import views
from quire.plans.q_flags import ITEMS_SQL, PYWS
from quire.plans.registry import query

ITEMS = "(case when contains(short_description, '<li') then " + ITEMS_SQL.replace('{0}', 'short_description') + \
        " else []::varchar[] end)"
WS = "list_filter(regexp_split_to_array(x, '" + PYWS + "+'), lambda y: y <> '')"


def _stats_sql(lens: str, prefix: str) -> str:
    parts = {
        "min": f"list_min({lens})", "max": f"list_max({lens})", "sum": f"list_sum({lens})",
        "mean": f"list_avg({lens})", "median": f"list_aggregate({lens}, 'median')",
        "std": f"list_aggregate({lens}, 'stddev_pop')",
    }
    return ", ".join(f"round(case when len({lens}) > 0 then cast({e} as double) else 0.0 end, 6) as {prefix}_{k}"
                     for k, e in parts.items())


@query("i1_extract_items", oracle=views("h") + f"""
select sku_id, cast(len({ITEMS}) as bigint) as n_items, array_to_string({ITEMS}, '|') as items from h""")
def i1_extract_items(spark, sf_dir):
    """Texts of the <li> elements (joined with '|' for comparison)."""
    items = IT.extract_items("short_description")
    return H(spark, sf_dir).select("sku_id", F.size(items).cast("long").alias("n_items"),
                                   F.array_join(items, "|").alias("items"))


@query("i2_item_count", oracle=views("h") + f"select sku_id, cast(len({ITEMS}) as bigint) as items_cnt from h")
def i2_item_count(spark, sf_dir):
    """Number of list items."""
    return H(spark, sf_dir).select("sku_id", IT.item_count("short_description").cast("long").alias("items_cnt"))


@query("i3_clean_item_ratio", oracle=views("h") + f"""
select sku_id, round(case when len(l) > 0 then (len(list_filter(l, lambda x: strpos(x, ':') > 1)) + 0.1)
                                              / (len(l) + 0.1) else 0.0 end, 6) as items_ratio
from (select sku_id, {ITEMS} as l from h)""")
def i3_clean_item_ratio(spark, sf_dir):
    """Share of 'name: value' items, smoothed by 0.1."""
    return H(spark, sf_dir).select("sku_id", r(IT.clean_item_ratio("short_description")).alias("items_ratio"))


@query("i4_item_word_stats", oracle=views("h") + f"""
select sku_id, cast(len(list_filter(lens, lambda x: x <> 0)) as double) as item_len_nonzero,
  {_stats_sql('lens', 'item_len')}
from (select sku_id, list_transform({ITEMS}, lambda x: len(string_split(x, ' '))) as lens from h)""")
def i4_item_word_stats(spark, sf_dir):
    """Space-word counts per item: nonzero count, min/max/sum/mean/median/std."""
    h = H(spark, sf_dir).select("sku_id", IT.extract_items("short_description").alias("_items"))
    s = IT.item_word_stats(None, F.col("_items"))
    return h.select("sku_id", *[r(v).alias(k) if k != "item_len_nonzero" else v.alias(k) for k, v in s.items()])


@query("i5_item_word_char_stats", oracle=views("h") + f"""
select sku_id, {_stats_sql('wl', 'item_word_cnt')}, {_stats_sql('cl', 'item_char_cnt')}
from (select sku_id, list_transform({ITEMS}, lambda x: len({WS})) as wl,
             list_transform({ITEMS}, lambda x: length(x)) as cl from h)""")
def i5_item_word_char_stats(spark, sf_dir):
    """Whitespace words and characters per item: min/max/sum/mean/median/std."""
    h = H(spark, sf_dir).select("sku_id", IT.extract_items("short_description").alias("_items"))
    s = IT.item_word_char_stats(None, F.col("_items"))
    return h.select("sku_id", *[r(v).alias(k) for k, v in s.items()])
