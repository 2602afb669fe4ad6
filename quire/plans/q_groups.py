"""Queries: group statistics, joins of aggregates, entropies (A*, J*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_html, combo_key, convert_price, space_punctuation, word_len_space
from quire.operators import groups as G
from quire.operators.joins import attach, bounded, fits_broadcast, materialize, side
from quire.plans.common import C, D, r
from quire.plans.oracle_views import views
from quire.plans.registry import query
from quire.sources import lexicons as LX

CATS = ["category_lvl_1", "category_lvl_2", "category_lvl_3"]

# --------------------------------------------------------------------- A2
PRICE_SQL = "case country when 'sg' then price when 'my' then price * 0.32 else price * 0.074 end"


def attach_price_stats(c: DataFrame) -> DataFrame:
    """A2: converted price; category 1 mean/min/max/std, category 2 and 3
    means; null categories form the group 'NA'. One GROUPING SETS scan
    builds all three small tables, which are attached by size-checked
    broadcast joins (no shuffle of the listing rows)."""
    keys = {k: f"_{k}" for k in CATS}
    rows = c.withColumn("price", convert_price()).select(
        "*", *[F.coalesce(F.col(k), F.lit("NA")).alias(a) for k, a in keys.items()])
    p = F.col("price")
    stats = G.grouping_sets_stats(
        rows.select("price", *keys.values()), {a: [a] for a in keys.values()},
        {"mean": G.exact_avg(p), "min": F.min(p), "max": F.max(p), "std": F.stddev_samp(p)})
    k1, k2, k3 = keys.values()
    s1 = stats[k1].select(
        k1, F.col("mean").alias("category_lvl_1_price_mean"),
        F.col("min").alias("category_lvl_1_price_min"), F.col("max").alias("category_lvl_1_price_max"),
        F.col("std").alias("category_lvl_1_price_std"))
    s2 = stats[k2].select(k2, F.col("mean").alias("category_lvl_2_price_mean"))
    s3 = stats[k3].select(k3, F.col("mean").alias("category_lvl_3_price_mean"))
    out = rows
    for s, k in ((s1, k1), (s2, k2), (s3, k3)):
        out = out.join(side(s, stats.small), k, "left")
    return out.drop(*keys.values())


PRICE_STATS_COLS = ["price", "category_lvl_1_price_mean", "category_lvl_1_price_min",
                    "category_lvl_1_price_max", "category_lvl_1_price_std",
                    "category_lvl_2_price_mean", "category_lvl_3_price_mean"]


@query("a2_group_price_stats", oracle=views("c") + f"""
select sku_id, round(cp, 6) as price,
  round(cast(avg(cast(cp as decimal(24, 6))) over (partition by k1) as double), 6) as category_lvl_1_price_mean,
  round(min(cp) over (partition by k1), 6) as category_lvl_1_price_min,
  round(max(cp) over (partition by k1), 6) as category_lvl_1_price_max,
  round(stddev_samp(cp) over (partition by k1), 6) as category_lvl_1_price_std,
  round(cast(avg(cast(cp as decimal(24, 6))) over (partition by k2) as double), 6) as category_lvl_2_price_mean,
  round(cast(avg(cast(cp as decimal(24, 6))) over (partition by k3) as double), 6) as category_lvl_3_price_mean
from (select sku_id, {PRICE_SQL} as cp, coalesce(category_lvl_1, 'NA') k1,
             coalesce(category_lvl_2, 'NA') k2, coalesce(category_lvl_3, 'NA') k3 from c) t
""")
def a2_group_price_stats(spark, sf_dir):
    """Converted price with category price profiles attached to each listing."""
    out = attach_price_stats(C(spark, sf_dir))
    return out.select("sku_id", *[r(k).alias(k) for k in PRICE_STATS_COLS])


# --------------------------------------------------------------------- A10
def attach_category_entropies(c: DataFrame) -> DataFrame:
    """A10: entropy12, 23, 13, 123 from one finest (c1, c2, c3) count table.

    The finest counts keep null children so parent totals include them;
    null parents and null children drop out of the entropy sums."""
    fine = materialize(c.groupBy(*CATS).agg(F.count(F.lit(1)).alias("_w")))
    small = fits_broadcast(fine)
    e12 = G.entropy_from_counts(fine, "category_lvl_1", "category_lvl_2", "_w", "entropy12")
    e13 = G.entropy_from_counts(fine, "category_lvl_1", "category_lvl_3", "_w", "entropy13")
    e123 = G.entropy_from_counts(fine, "category_lvl_1", ["category_lvl_2", "category_lvl_3"], "_w", "entropy123")
    e23 = G.entropy_from_counts(fine, "category_lvl_2", "category_lvl_3", "_w", "entropy23")
    by1 = e12.join(e13, "category_lvl_1", "full").join(e123, "category_lvl_1", "full")
    return (c.join(side(by1, small), "category_lvl_1", "left")
             .join(side(e23, small), "category_lvl_2", "left"))


ENTROPY_COLS = ["entropy12", "entropy23", "entropy13", "entropy123"]


def _entropy_sql(parent: str, child: list[str], name: str, weight: str = "1") -> str:
    cnn = " and ".join(f"{k} is not null" for k in child)
    ck = ", ".join(child)
    return f"""
{name} as (
  select {parent}, sum(-ln(s / g) * s / g) as {name} from (
    select {parent}, {ck}, sum({weight}) as s,
           any_value(g) as g
    from (select *, sum({weight}) over (partition by {parent}) as g from src where {parent} is not null) x
    where {cnn}
    group by {parent}, {ck}) y
  group by {parent})"""


def entropy_ctes(src: str = "c") -> str:
    return ",\n".join([
        f"src as (select * from {src})",
        _entropy_sql("category_lvl_1", ["category_lvl_2"], "entropy12"),
        _entropy_sql("category_lvl_2", ["category_lvl_3"], "entropy23"),
        _entropy_sql("category_lvl_1", ["category_lvl_3"], "entropy13"),
        _entropy_sql("category_lvl_1", ["category_lvl_2", "category_lvl_3"], "entropy123"),
    ])


ENTROPY_JOIN = """left join entropy12 using (category_lvl_1) left join entropy23 using (category_lvl_2)
       left join entropy13 using (category_lvl_1) left join entropy123 using (category_lvl_1)"""

ENTROPY_ORACLE = views("c") + ", " + entropy_ctes() + f"""
select sku_id, round(entropy12, 6) as entropy12, round(entropy23, 6) as entropy23,
       round(entropy13, 6) as entropy13, round(entropy123, 6) as entropy123
from c {ENTROPY_JOIN}
"""


@query("a10_category_entropy", oracle=ENTROPY_ORACLE)
def a10_category_entropy(spark, sf_dir):
    """Entropy of child categories under each parent category, per listing."""
    out = attach_category_entropies(C(spark, sf_dir))
    return out.select("sku_id", *[r(k).alias(k) for k in ENTROPY_COLS])


# --------------------------------------------------------------------- J1 flagship
@query("j1_left_join_group_stats", oracle=views("c") + ", " + entropy_ctes() + f""",
ps as (select sku_id, cp,
  avg(cast(cp as decimal(24, 6))) over (partition by k1) m1, min(cp) over (partition by k1) n1, max(cp) over (partition by k1) x1,
  stddev_samp(cp) over (partition by k1) s1, avg(cast(cp as decimal(24, 6))) over (partition by k2) m2, avg(cast(cp as decimal(24, 6))) over (partition by k3) m3
  from (select sku_id, {PRICE_SQL} as cp, coalesce(category_lvl_1, 'NA') k1,
               coalesce(category_lvl_2, 'NA') k2, coalesce(category_lvl_3, 'NA') k3 from c) t)
select sku_id, round(cp, 6) as price, round(m1, 6) as category_lvl_1_price_mean,
  round(n1, 6) as category_lvl_1_price_min, round(x1, 6) as category_lvl_1_price_max,
  round(s1, 6) as category_lvl_1_price_std, round(m2, 6) as category_lvl_2_price_mean,
  round(m3, 6) as category_lvl_3_price_mean,
  round(entropy12, 6) as entropy12, round(entropy23, 6) as entropy23,
  round(entropy13, 6) as entropy13, round(entropy123, 6) as entropy123
from c join ps using (sku_id) {ENTROPY_JOIN}
""")
def j1_left_join_group_stats(spark, sf_dir):
    """Flagship: per listing, converted price, category price profile and
    category entropies (S1 -> P7 -> A2 + A10 -> J1).

    One GROUPING SETS scan of the listings yields both the per-category
    price statistics ('NA'-filled keys) and the finest raw (c1, c2, c3)
    counts the entropies roll up from; every statistic is then a small
    table attached by size-checked broadcast, so the listing rows are read
    twice in total and never shuffled."""
    c = C(spark, sf_dir)
    keys = {k: f"_{k}" for k in CATS}
    rows = c.withColumn("price", convert_price()).select(
        "sku_id", "price", *CATS, *[F.coalesce(F.col(k), F.lit("NA")).alias(a) for k, a in keys.items()])
    p = F.col("price")
    sets = {a: [a] for a in keys.values()}
    sets["fine"] = CATS
    stats = G.grouping_sets_stats(
        rows.select("price", *CATS, *keys.values()), sets,
        {"mean": G.exact_avg(p), "min": F.min(p), "max": F.max(p), "std": F.stddev_samp(p),
         "_w": F.count(F.lit(1))})
    k1, k2, k3 = keys.values()
    s1 = stats[k1].select(k1, F.col("mean").alias("category_lvl_1_price_mean"),
                          F.col("min").alias("category_lvl_1_price_min"),
                          F.col("max").alias("category_lvl_1_price_max"),
                          F.col("std").alias("category_lvl_1_price_std"))
    s2 = stats[k2].select(k2, F.col("mean").alias("category_lvl_2_price_mean"))
    s3 = stats[k3].select(k3, F.col("mean").alias("category_lvl_3_price_mean"))
    fine = stats["fine"].select(*CATS, "_w")
    e12 = G.entropy_from_counts(fine, "category_lvl_1", "category_lvl_2", "_w", "entropy12")
    e13 = G.entropy_from_counts(fine, "category_lvl_1", "category_lvl_3", "_w", "entropy13")
    e123 = G.entropy_from_counts(fine, "category_lvl_1", ["category_lvl_2", "category_lvl_3"], "_w", "entropy123")
    e23 = G.entropy_from_counts(fine, "category_lvl_2", "category_lvl_3", "_w", "entropy23")
    by1 = e12.join(e13, "category_lvl_1", "full").join(e123, "category_lvl_1", "full")
    out = rows
    for t, k in ((s1, k1), (s2, k2), (s3, k3), (by1, "category_lvl_1"), (e23, "category_lvl_2")):
        out = out.join(side(t, stats.small), k, "left")
    return out.select("sku_id", *[r(k).alias(k) for k in PRICE_STATS_COLS + ENTROPY_COLS])


# --------------------------------------------------------------------- shared SQL
def na(c: str, fill: str = "NA") -> str:
    return f"coalesce({c}, '{fill}')"


P4_SQL = ("replace(replace(replace(replace(replace({0}, '(', ' ( '), ')', ' ) '), '/', ' / '), '  ', ' '), "
          "chr(9), ' ')")
PYWS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
        r"\x{205f}\x{3000}]")
WS_SQL = "list_filter(regexp_split_to_array({0}, '" + PYWS + "+'), lambda x: x <> '')"


def ws_sql(src: str) -> str:
    return WS_SQL.replace("{0}", src)


def exact_sum_sql(x: str, part: str) -> str:
    return f"round(cast(sum(cast({x} as decimal(38, 6))) over (partition by {part}) as double), 6)"


# --------------------------------------------------------------------- A1
A1_KEYS = {
    "product_type_price": ["product_type"],
    "category_lvl_12_price": ["category_lvl_1", "category_lvl_2"],
    "category_lvl_23_price": ["category_lvl_2", "category_lvl_3"],
    "category_lvl_13_price": ["category_lvl_1", "category_lvl_3"],
    "category_lvl_123_price": ["category_lvl_1", "category_lvl_2", "category_lvl_3"],
}


@query("a1_group_sum", oracle=views("c") + "select sku_id, " + ", ".join(
    exact_sum_sql("price", " || '-' || ".join(na(k) for k in keys)) + f" as {name}"
    for name, keys in A1_KEYS.items()) + " from c")
def a1_group_sum(spark, sf_dir):
    """Raw price summed over the product type and category combinations
    ('NA' for nulls), attached to each listing; one GROUPING SETS scan."""
    c = C(spark, sf_dir)
    keys = {name: combo_key(*ks).alias(f"_{name}") for name, ks in A1_KEYS.items()}
    rows = c.select("sku_id", "price", *keys.values())
    sets = {f"_{n}": [f"_{n}"] for n in A1_KEYS}
    stats = G.grouping_sets_stats(rows.select("price", *sets), sets, {"s": G.exact_sum("price")})
    out = rows
    for n in A1_KEYS:
        out = out.join(side(stats[f"_{n}"].withColumnRenamed("s", n), stats.small), f"_{n}", "left")
    return out.select("sku_id", *[r(n).alias(n) for n in A1_KEYS])


# --------------------------------------------------------------------- A3
@query("a3_country_group_price_stats", oracle=views("c") + "select sku_id, " + ", ".join(
    f"round(cast(avg(cast(cp as decimal(24, 6))) over (partition by country, k{n}) as double), 6) "
    f"as category_lvl_{n}c_price_mean, "
    f"round(stddev_samp(cp) over (partition by country, k{n}), 6) as category_lvl_{n}c_price_std"
    for n in (1, 2, 3)) + f""" from (select sku_id, country, {PRICE_SQL} as cp,
  {na('category_lvl_1')} k1, {na('category_lvl_2')} k2, {na('category_lvl_3')} k3 from c)""")
def a3_country_group_price_stats(spark, sf_dir):
    """Converted-price mean and sample std by (country, category n)."""
    c = C(spark, sf_dir)
    rows = c.select("sku_id", "country", convert_price().alias("cp"),
                    *[F.coalesce(F.col(k), F.lit("NA")).alias(f"k{i}") for i, k in enumerate(CATS, start=1)])
    sets = {f"k{n}": ["country", f"k{n}"] for n in (1, 2, 3)}
    stats = G.grouping_sets_stats(rows, sets, {"m": G.exact_avg("cp"), "s": F.stddev_samp("cp")})
    out = rows
    for n in (1, 2, 3):
        t = stats[f"k{n}"].select("country", f"k{n}", F.col("m").alias(f"category_lvl_{n}c_price_mean"),
                                  F.col("s").alias(f"category_lvl_{n}c_price_std"))
        out = out.join(side(t, stats.small), ["country", f"k{n}"], "left")
    cols = [f"category_lvl_{n}c_price_{s}" for n in (1, 2, 3) for s in ("mean", "std")]
    return out.select("sku_id", *[r(k).alias(k) for k in cols])


# --------------------------------------------------------------------- A4
@query("a4_country_group_price_median", oracle=views("c") + "select sku_id, " + ", ".join(
    f"round(cast(avg(cast(price as decimal(24, 6))) over (partition by country, g{n}) as double), 6) as price_avg{n}, "
    f"round(median(price) over (partition by country, g{n}), 6) as price_mdn{n}, "
    f"round(stddev_samp(price) over (partition by country, g{n}), 4) as price_std{n}"
    for n in (1, 2, 3, 4)) + f""" from (select sku_id, country, price, {na('category_lvl_1', 'empty')} g1,
  {na('category_lvl_2', 'empty')} g2, {na('category_lvl_3', 'empty')} g3, substr(sku_id, 1, 2) g4 from c)""")
def a4_country_group_price_median(spark, sf_dir):
    """Raw-price mean / exact median / sample std by (country, category n)
    and (country, key prefix 2); nulls filled with 'empty'. Means and stds
    come from one GROUPING SETS pass; medians are selected by narrowing each
    group's bounds (no group's values gathered in one task)."""
    c = C(spark, sf_dir)
    rows = c.select("sku_id", "country", "price",
                    *[F.coalesce(F.col(k), F.lit("empty")).alias(f"g{i}") for i, k in enumerate(CATS, start=1)],
                    F.substring("sku_id", 1, 2).alias("g4"))
    rows = materialize(rows)
    sets = {f"g{n}": ["country", f"g{n}"] for n in (1, 2, 3, 4)}
    stats = G.grouping_sets_stats(rows, sets, {"m": G.exact_avg("price"), "s": F.stddev_samp("price")} | G.range_aggs("price"))
    meds = G.selected_median_sets(rows, sets, "price", stats)
    out = rows
    for n in (1, 2, 3, 4):
        t = stats[f"g{n}"].select("country", f"g{n}", F.col("m").alias(f"price_avg{n}"),
                                  F.col("s").alias(f"price_std{n}"))
        t = t.join(meds[f"g{n}"].withColumnRenamed("_m", f"price_mdn{n}"), ["country", f"g{n}"], "left")
        out = out.join(side(t, stats.small and meds.small), ["country", f"g{n}"], "left")
    # stds of ~3e4 to 4 digits: the two engines' moment sums differ in the 12th
    digits = {"avg": 6, "mdn": 6, "std": 4}
    return out.select("sku_id", *[F.round(f"price_{s}{n}", d).alias(f"price_{s}{n}")
                                  for n in (1, 2, 3, 4) for s, d in digits.items()])


# --------------------------------------------------------------------- A5 / A6
def _word_totals(spark, sf_dir, log: bool, text="title"):
    d = D(spark, sf_dir)
    out = d.select("sku_id", *CATS)
    # texts are cleaned and split once for all categories
    counts = materialize(G.word_counts(d.withColumn("t", space_punctuation(text)), CATS, "t"))
    for n, k in enumerate(CATS, start=1):
        tot = G.group_word_totals(counts.where(F.col(k).isNotNull()), k, f"cat{n}")
        out = out.join(bounded(tot), k, "left")
    cols = [f"cat{n}_{s}" for n in (1, 2, 3) for s in ("words", "nunique")]
    f = (lambda c: r(F.ln(F.col(c)))) if log else (lambda c: F.col(c).cast("long"))
    return out.select("sku_id", *[f(c).alias(c) for c in cols])


def _word_totals_sql(log: bool, text: str = "title") -> str:
    f = (lambda e: f"round(ln({e}), 6)") if log else (lambda e: f"cast({e} as bigint)")
    parts = []
    for n, k in enumerate(CATS, start=1):
        parts.append(f"""g{n} as (select {k}, {f('count(*)')} as cat{n}_words, {f('count(distinct w)')} as cat{n}_nunique
   from (select {k}, unnest(string_split({P4_SQL.format(text)}, ' ')) as w from d where {k} is not null)
   group by {k})""")
    return views("d") + ", " + ",\n".join(parts) + "\nselect sku_id, " + ", ".join(
        f"cat{n}_{s}" for n in (1, 2, 3) for s in ("words", "nunique")) + " from d " + " ".join(
        f"left join g{n} using ({k})" for n, k in enumerate(CATS, start=1))


@query("a5_group_word_totals", oracle=_word_totals_sql(False))
def a5_group_word_totals(spark, sf_dir):
    """Total and distinct title words of each category, by exploding words
    (never by concatenating a group's text)."""
    return _word_totals(spark, sf_dir, log=False)


@query("a6_group_word_totals_log", oracle=_word_totals_sql(True))
def a6_group_word_totals_log(spark, sf_dir):
    """Natural log of the category word totals."""
    return _word_totals(spark, sf_dir, log=True)


def _desc():
    return clean_html(F.coalesce("short_description", F.lit("")))


DESC_SQL = r"regexp_replace(coalesce(short_description, ''), '<[^\n]*?>', '', 'g')"


@query("a5_group_word_totals_description", oracle=_word_totals_sql(False, DESC_SQL))
def a5_group_word_totals_description(spark, sf_dir):
    """Total and distinct description words of each category."""
    return _word_totals(spark, sf_dir, log=False, text=_desc())


@query("a6_group_word_totals_log_description", oracle=_word_totals_sql(True, DESC_SQL))
def a6_group_word_totals_log_description(spark, sf_dir):
    """Natural log of the category totals of description words."""
    return _word_totals(spark, sf_dir, log=True, text=_desc())


# --------------------------------------------------------------------- A7 / A8
STAT_NAMES = ("min", "max", "mean", "median", "std")


def _length_stats(rows, sets: dict[str, list[str]]):
    """Attach word-count stats for each named key set (null keys drop out)."""
    x = F.col("wc")
    out = rows
    for name, keys in sets.items():
        aggs = G.length_stats_aggs(x.cast("double"), name)
        t = G.group_stats(rows, keys, aggs, drop_null_keys=True)
        out = out.join(bounded(t), keys, "left")
    cols = [f"{name}_{s}" for name in sets for s in STAT_NAMES]
    return out.select("sku_id", *[r(c).alias(c) for c in cols])


def _length_stats_sql(src: str, title_expr: str, sets: dict[str, list[str]]) -> str:
    sel = []
    for name, keys in sets.items():
        part = ", ".join(keys)
        nn = " and ".join(f"{k} is not null" for k in keys)
        for s, fn in zip(STAT_NAMES, ("min", "max", "avg", "median", "stddev_samp")):
            sel.append(f"round(case when {nn} then cast({fn}(wc) over (partition by {part}) as double) end, 6) "
                       f"as {name}_{s}")
    return (views(src) + f"select sku_id, " + ", ".join(sel)
            + f" from (select *, len(string_split({title_expr}, ' ')) as wc from {src})")


A7_SETS = {f"cat{n}_word_cnt": [k] for n, k in enumerate(CATS, start=1)}


@query("a7_group_length_stats", oracle=_length_stats_sql("d", P4_SQL.format("title"), A7_SETS))
def a7_group_length_stats(spark, sf_dir):
    """Min / max / mean / median / sample std of title word counts by
    each category."""
    d = D(spark, sf_dir)
    rows = d.select("sku_id", *CATS, word_len_space(space_punctuation("title")).alias("wc"))
    return _length_stats(rows, A7_SETS)


@query("a7_group_length_stats_description", oracle=_length_stats_sql("d", P4_SQL.format(DESC_SQL), A7_SETS))
def a7_group_length_stats_description(spark, sf_dir):
    """Min / max / mean / median / sample std of description word counts by
    each category."""
    d = D(spark, sf_dir)
    rows = d.select("sku_id", *CATS, word_len_space(space_punctuation(_desc())).alias("wc"))
    return _length_stats(rows, A7_SETS)


A8_SETS = {"cat1_word_cnt": ["category_lvl_1", "category_lvl_2"],
           "cat2_word_cnt": ["category_lvl_2", "category_lvl_3"],
           "cat3_word_cnt": ["category_lvl_3", "category_lvl_1"],
           "cat4_word_cnt": ["category_lvl_1", "category_lvl_2", "category_lvl_3"]}


@query("a8_group_length_stats_multikey", oracle=_length_stats_sql("c", "title", A8_SETS))
def a8_group_length_stats_multikey(spark, sf_dir):
    """Word-count stats by category pairs and triple (null keys drop out)."""
    c = C(spark, sf_dir)
    rows = c.select("sku_id", *CATS, word_len_space("title").alias("wc"))
    return _length_stats(rows, A8_SETS)


# --------------------------------------------------------------------- A9
A9_PAIRS = [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


@query("a9_group_nunique", oracle=views("c") + "select sku_id, " + ", ".join(
    f"cast(count(distinct k{b}) over (partition by k{a}) as bigint) as category_lvl_{a}{b}_nunique"
    for a, b in A9_PAIRS) + f""" from (select sku_id, {na('category_lvl_1')} k1, {na('category_lvl_2')} k2,
  {na('category_lvl_3')} k3 from c)""")
def a9_group_nunique(spark, sf_dir):
    """Distinct child categories per parent category ('NA' for nulls),
    exact, by two-step distinct."""
    c = C(spark, sf_dir)
    rows = c.select("sku_id", *[F.coalesce(F.col(k), F.lit("NA")).alias(f"k{i}") for i, k in enumerate(CATS, 1)])
    # one scan: the distinct (k1, k2, k3) triples, written once; every pair's
    # distinct-children count is a small roll-up of that table
    triples = materialize(rows.select("k1", "k2", "k3").distinct())
    small = fits_broadcast(triples)
    out = rows
    for a, b in A9_PAIRS:
        t = G.count_distinct_children(triples, f"k{a}", f"k{b}", f"category_lvl_{a}{b}_nunique")
        out = out.join(side(t, small), f"k{a}", "left")
    return out.select("sku_id", *[F.col(f"category_lvl_{a}{b}_nunique").cast("long") for a, b in A9_PAIRS])


# --------------------------------------------------------------------- A11
@query("a11_brand_entropy", oracle=views("c") + ", " + ",\n".join([
    "src as (select *, substr(sku_id, 1, 5) as brand from c)",
    _entropy_sql("category_lvl_1", ["brand"], "brand_entropy1"),
    _entropy_sql("category_lvl_2", ["brand"], "brand_entropy2"),
    _entropy_sql("category_lvl_3", ["brand"], "brand_entropy3")]) + """
select sku_id, round(brand_entropy1, 6) as brand_entropy1, round(brand_entropy2, 6) as brand_entropy2,
       round(brand_entropy3, 6) as brand_entropy3
from c left join brand_entropy1 using (category_lvl_1) left join brand_entropy2 using (category_lvl_2)
       left join brand_entropy3 using (category_lvl_3)""")
def a11_brand_entropy(spark, sf_dir):
    """Entropy of the key prefix (5 chars, a brand proxy) under each
    category level."""
    c = C(spark, sf_dir).withColumn("brand", F.substring("sku_id", 1, 5))
    fine = materialize(c.groupBy(*CATS, "brand").agg(F.count(F.lit(1)).alias("_w")))
    small = fits_broadcast(fine)
    out = c
    for n, k in enumerate(CATS, start=1):
        e = G.entropy_from_counts(fine, k, "brand", "_w", f"brand_entropy{n}")
        out = out.join(side(e, small), k, "left")
    return out.select("sku_id", *[r(f"brand_entropy{n}").alias(f"brand_entropy{n}") for n in (1, 2, 3)])


# --------------------------------------------------------------------- A12
def _weighted_entropy_ctes() -> str:
    w = "len(string_split(title, ' '))"
    return ",\n".join([
        "src as (select * from d)",
        _entropy_sql("category_lvl_1", ["category_lvl_2"], "entropy12", w),
        _entropy_sql("category_lvl_2", ["category_lvl_3"], "entropy23", w),
        _entropy_sql("category_lvl_1", ["category_lvl_3"], "entropy13", w),
        _entropy_sql("category_lvl_1", ["category_lvl_2", "category_lvl_3"], "entropy123", w),
    ])


@query("a12_title_length_entropy", oracle=views("d") + ", " + _weighted_entropy_ctes() + f"""
select sku_id, round(entropy12, 6) as entropy12, round(entropy23, 6) as entropy23,
       round(entropy13, 6) as entropy13, round(entropy123, 6) as entropy123
from d {ENTROPY_JOIN}""")
def a12_title_length_entropy(spark, sf_dir):
    """Category entropies weighted by title word counts instead of rows."""
    d = D(spark, sf_dir).withColumn("_len", word_len_space("title"))
    fine = materialize(d.groupBy(*CATS).agg(F.sum("_len").alias("_w")))
    e12 = G.entropy_from_counts(fine, "category_lvl_1", "category_lvl_2", "_w", "entropy12")
    e13 = G.entropy_from_counts(fine, "category_lvl_1", "category_lvl_3", "_w", "entropy13")
    e123 = G.entropy_from_counts(fine, "category_lvl_1", ["category_lvl_2", "category_lvl_3"], "_w", "entropy123")
    e23 = G.entropy_from_counts(fine, "category_lvl_2", "category_lvl_3", "_w", "entropy23")
    by1 = e12.join(e13, "category_lvl_1", "full").join(e123, "category_lvl_1", "full")
    small = fits_broadcast(fine)
    out = d.join(side(by1, small), "category_lvl_1", "left").join(side(e23, small), "category_lvl_2", "left")
    return out.select("sku_id", *[r(k).alias(k) for k in ENTROPY_COLS])


# --------------------------------------------------------------------- A13
@query("a13_mine_attributes", oracle=views("h", "d", "t") + ", "
    + __import__("quire.plans.q_flags", fromlist=["DESC_SQL"]).DESC_SQL + __import__("quire.plans.q_flags", fromlist=["mined_sql"]).mined_sql("desc_all")
    + "\nselect att, cast(cnt as bigint) as count from mined")
def a13_mine_attributes(spark, sf_dir):
    """Attribute names mined from list items (or whole descriptions
    without a list) of pages and documents, with counts >= 2."""
    from quire.functions.items import extract_items
    from quire.plans.q_flags import descriptions
    d = descriptions(spark, sf_dir)
    items = d.select(extract_items("short_description").alias("items"), "short_description")
    return G.mine_attributes(items, "items", "short_description").select("att", F.col("count").cast("long"))


# --------------------------------------------------------------------- A14
@query("a14_crosstab", oracle=views("c") + " " + " union all ".join(
    f"select {n} as level, {k} as category, substr(sku_id, 1, 5) as sku1, count(*) as count from c "
    f"where {k} is not null group by {k}, substr(sku_id, 1, 5)" for n, k in enumerate(CATS, start=1)))
def a14_crosstab(spark, sf_dir):
    """Counts of category n x key prefix 5, in long form (the wide matrix
    has one column per prefix and grows with the data)."""
    c = C(spark, sf_dir).withColumn("sku1", F.substring("sku_id", 1, 5))
    parts = [G.crosstab_long(c, k, "sku1").select(F.lit(n).alias("level"), F.col(k).alias("category"), "sku1",
                                                   F.col("count").cast("long"))
             for n, k in enumerate(CATS, start=1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------- A15
@query("a15_duplicate_counts", oracle=views("d") + """
select sku_id, count(*) over (partition by coalesce(title, 'empty')) as n1,
       count(*) over (partition by coalesce(short_description, 'empty')) as n2 from d""")
def a15_duplicate_counts(spark, sf_dir):
    """Listings sharing the same title (n1) and the same description (n2).

    The keys are 256-bit digests of the texts. Counts are aggregated with
    partial aggregation and joined back; only texts seen twice or more are
    joined, and AQE splits a hot one."""
    digest = {n: F.unhex(F.sha2(F.coalesce(c, F.lit("empty")).cast("binary"), 256)).alias(n)
              for n, c in (("t", "title"), ("s", "short_description"))}
    d = D(spark, sf_dir).select("sku_id", *digest.values())
    out = d
    for key, name in (("t", "n1"), ("s", "n2")):
        repeated = d.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
        out = out.join(repeated, key, "left")
    return out.select("sku_id", *[F.coalesce(n, F.lit(1)).alias(n) for n in ("n1", "n2")])


# --------------------------------------------------------------------- A16
ALPHA2_SQL = "regexp_extract_all(lower(regexp_replace({0}, '[^a-zA-Z]', ' ', 'g')), '[a-z]{{2,}}')"


@query("a16_rare_tokens", oracle=views("d") + f"""
select w as token, count(*) as count from (select unnest({ALPHA2_SQL.format('title')}) as w from d)
group by w having count(*) < 10""")
def a16_rare_tokens(spark, sf_dir):
    """Title tokens (letters only, two or more) seen fewer than 10 times."""
    d = D(spark, sf_dir)
    toks = d.select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("title", "[^a-zA-Z]", " ")),
                                                   F.lit("[a-z]{2,}"), 0)).alias("token"))
    return G.value_counts(toks, "token").where(F.col("count") < 10)


# --------------------------------------------------------------------- A17
A17_COLS = {"country": "country", "category_lvl_1": "category_lvl_1", "sku_id2": "substr(sku_id, 1, 2)"}


@query("a17_value_counts", oracle=views("c") + " " + " union all ".join(
    f"select '{n}' as column_name, {e} as value, count(*) as count from c where {e} is not null group by {e}"
    for n, e in A17_COLS.items()))
def a17_value_counts(spark, sf_dir):
    """Frequencies of country, category 1 and key prefix 2 (long form)."""
    c = C(spark, sf_dir).withColumn("sku_id2", F.substring("sku_id", 1, 2))
    parts = [G.value_counts(c, n).select(F.lit(n).alias("column_name"), F.col(n).alias("value"), "count")
             for n in A17_COLS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


A17_KEY_PARTS = {"sku_id_2": "substr(sku_id, length(sku_id) - 1, 2)", "sku_id57": "substr(sku_id, 6, 2)",
                 "sku_id_53": "substr(sku_id, length(sku_id) - 4, 1)"}


@query("a17_value_counts_key_parts", oracle=views("c") + " " + " union all ".join(
    f"select '{n}' as column_name, {e} as value, count(*) as count from c group by {e}"
    for n, e in A17_KEY_PARTS.items()))
def a17_value_counts_key_parts(spark, sf_dir):
    """Frequencies of the key's last two characters, of its sixth and seventh
    and of the fifth from its end (long form)."""
    key = F.col("sku_id")
    c = C(spark, sf_dir).select(F.substring(key, -2, 2).alias("sku_id_2"), F.substring(key, 6, 2).alias("sku_id57"),
                                F.substring(key, -5, 1).alias("sku_id_53"))
    parts = [G.value_counts(c, n).select(F.lit(n).alias("column_name"), F.col(n).alias("value"), "count")
             for n in A17_KEY_PARTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --------------------------------------------------------------------- A18 / A19
def _word_positions(d):
    from quire.functions.text import words_ws, ws_token_at
    return d.select("sku_id", F.size(words_ws("title")).alias("title_len"),
                    *[ws_token_at("title", i).alias(f"word_{i}") for i in range(1, 12)])


def _word_pos_sql() -> str:
    ws = ws_sql("title")
    return (f"select sku_id, len({ws}) as title_len, "
            + ", ".join(f"coalesce(({ws})[{i + 1}], 'NA') as word_{i}" for i in range(1, 12)) + " from d")


@query("a18_word_position_counts", oracle=views("d") + f", w as ({_word_pos_sql()})\nselect sku_id, "
       + "count(*) over (partition by title_len) as title_len_cnt, " + ", ".join(
           f"count(*) over (partition by title_len, word_{i}) as title_len_word{i}_cnt" for i in range(1, 12))
       + " from w")
def a18_word_position_counts(spark, sf_dir):
    """Listings sharing the title length, and sharing (length, word i).

    The word-position table is written once; all twelve counts come from
    one GROUPING SETS pass over it and are attached by size-checked joins."""
    w = materialize(_word_positions(D(spark, sf_dir)))
    sets = {"title_len_cnt": ["title_len"]}
    sets.update({f"title_len_word{i}_cnt": ["title_len", f"word_{i}"] for i in range(1, 12)})
    return _attach_set_counts(w, sets)


@query("a19_word_prefix_counts", oracle=views("d") + f", w as ({_word_pos_sql()})\nselect sku_id, " + ", ".join(
    f"count(*) over (partition by {', '.join(f'word_{j}' for j in range(1, k + 1))}) as title_len_wordlen{k}_cnt"
    for k in range(2, 10)) + " from w")
def a19_word_prefix_counts(spark, sf_dir):
    """Listings sharing the first k title words (positions 1..k), k=2..9,
    from one GROUPING SETS pass."""
    w = materialize(_word_positions(D(spark, sf_dir)))
    sets = {f"title_len_wordlen{k}_cnt": [f"word_{j}" for j in range(1, k + 1)] for k in range(2, 10)}
    return _attach_set_counts(w, sets)


def _attach_set_counts(w, sets: dict[str, list[str]]):
    stats = G.grouping_sets_stats(w, sets, {"n": F.count(F.lit(1))})
    out = w
    for name, keys in sets.items():
        out = out.join(side(stats[name].withColumnRenamed("n", name), stats.small), keys, "left")
    return out.select("sku_id", *sets)


# --------------------------------------------------------------------- A20
def _sql_arr(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


@query("a20_stop_word_count", oracle=views("d") + f"""
select sku_id, cast(len(list_filter(ws, lambda w: list_contains({_sql_arr(LX.STOP_WORDS)}, w))) as bigint)
  as stopwords_count,
  len(list_filter(ws, lambda w: list_contains({_sql_arr(LX.STOP_WORDS)}, w))) / len(ws) as stopwords_ratio
from (select sku_id, string_split(replace(replace(title, '&amp;', '&'), '&nbsp;', ' '), ' ') as ws from d)""")
def a20_stop_word_count(spark, sf_dir):
    """Stop words among the title's space words, count and ratio."""
    from quire.functions.text import decode_entities, words_space
    d = D(spark, sf_dir)
    ws = words_space(decode_entities("title"))
    stops = F.array(*[F.lit(w) for w in LX.STOP_WORDS])
    cnt = F.size(F.filter(ws, lambda w: F.array_contains(stops, w)))
    return d.select("sku_id", cnt.cast("long").alias("stopwords_count"),
                    (cnt / F.size(ws)).alias("stopwords_ratio"))


# --------------------------------------------------------------------- A21
def known_words(spark, sf_dir):
    """Lexicon table: title tokens seen at least KNOWN_WORD_MIN_COUNT times."""
    from quire.sources.fixtures import title_tokens
    return (G.value_counts(title_tokens(spark, sf_dir), "word", "n")
            .where(F.col("n") >= LX.KNOWN_WORD_MIN_COUNT).select("word"))


KNOWN_SQL = ("known as (select word from tt group by word having count(*) >= "
             f"{LX.KNOWN_WORD_MIN_COUNT})")


@query("a21_lexicon_coverage", oracle=views("tt") + ", " + KNOWN_SQL + """,
tw as (select sku_id, unnest(string_split(title, ' ')) as w from d),
dw as (select sku_id, unnest(string_split(regexp_replace(short_description, '<[^\\n]*?>', '', 'g'), ' ')) as w from d),
tc as (select sku_id, count(*) as n, count(*) filter (where w in (select word from known)) as k from tw group by sku_id),
dc as (select sku_id, count(*) as n, count(*) filter (where w in (select word from known)) as k from dw group by sku_id)
select d.sku_id, cast(tc.n - tc.k as bigint) as title_unknown_cnt, cast(tc.k as bigint) as title_known_cnt,
  (tc.n - tc.k) / tc.n as title_unknown_ratio, tc.k / tc.n as title_known_ratio,
  cast(dc.n - dc.k as bigint) as desc_unknown_cnt, cast(dc.k as bigint) as desc_known_cnt,
  (dc.n - dc.k) / dc.n as desc_unknown_ratio, dc.k / dc.n as desc_known_ratio
from d join tc using (sku_id) join dc using (sku_id)""")
def a21_lexicon_coverage(spark, sf_dir):
    """Known / unknown space words of title and cleaned description against
    a lexicon table. Words are exploded and joined with the lexicon
    (size-checked broadcast, else a shuffle join), then counted per row."""
    from quire.functions.text import clean_html, words_space
    d = D(spark, sf_dir)
    known = bounded(known_words(spark, sf_dir).withColumn("_k", F.lit(1)))
    out = d.select("sku_id")
    for name, text in (("title", F.col("title")), ("desc", clean_html("short_description"))):
        w = d.select("sku_id", F.explode(words_space(text)).alias("word"))
        c = (w.join(known, "word", "left").groupBy("sku_id")
             .agg(F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_kn")))
        c = c.select("sku_id", (F.col("_n") - F.col("_kn")).alias(f"{name}_unknown_cnt"),
                     F.col("_kn").alias(f"{name}_known_cnt"),
                     ((F.col("_n") - F.col("_kn")) / F.col("_n")).alias(f"{name}_unknown_ratio"),
                     (F.col("_kn") / F.col("_n")).alias(f"{name}_known_ratio"))
        out = out.join(c, "sku_id")
    return out


# --------------------------------------------------------------------- J2-J7
@query("j2_left_join_multikey", oracle=views("c") + """
select sku_id, cast(count(*) over (partition by category_lvl_1, category_lvl_2) as bigint) as n12,
  case when category_lvl_3 is not null
       then cast(count(*) over (partition by category_lvl_1, category_lvl_2, category_lvl_3) as bigint) end as n123
from c""")
def j2_left_join_multikey(spark, sf_dir):
    """Group counts on two and three keys left-joined to the listings
    (a null key finds no group)."""
    c = C(spark, sf_dir)
    c = G.attach_counts(c, ["category_lvl_1", "category_lvl_2"], "n12", drop_null_keys=True)
    c = G.attach_counts(c, CATS, "n123", drop_null_keys=True)
    return c.select("sku_id", "n12", "n123")


@query("j3_parent_child_counts", oracle=views("c") + """
select category_lvl_1, category_lvl_2, count(*) as subgrp_cnt,
  cast(sum(count(*)) over (partition by category_lvl_1) as bigint) as grp_cnt
from c group by category_lvl_1, category_lvl_2""")
def j3_parent_child_counts(spark, sf_dir):
    """(parent, child) counts with the parent count joined on."""
    c = C(spark, sf_dir)
    sub = G.value_counts(c, ["category_lvl_1", "category_lvl_2"], "subgrp_cnt", drop_null_keys=False)
    grp = G.value_counts(c, "category_lvl_1", "grp_cnt", drop_null_keys=False)
    return sub.join(bounded(grp), "category_lvl_1", "left").select(
        "category_lvl_1", "category_lvl_2", "subgrp_cnt", "grp_cnt")


@query("j4_join_predictions", oracle=views("d", "p") + """
select d.sku_id, d.conciseness, p.pred from d left join (select * from p where model = 1) p using (sku_id)
where d.split = 'trn'""")
def j4_join_predictions(spark, sf_dir):
    """Training rows with the level-1 prediction of model 1 (left join by key)."""
    from quire.plans.common import P
    d = D(spark, sf_dir).where(F.col("split") == "trn").select("sku_id", "conciseness")
    p = P(spark, sf_dir).where(F.col("model") == 1).select("sku_id", "pred")
    return d.join(p, "sku_id", "left")


@query("j5_key_join_blocks", oracle=views("d") + """
select a.sku_id, a.title_len, b.desc_len, c.n_tokens
from (select sku_id, cast(length(title) as bigint) as title_len from d) a
join (select sku_id, cast(length(short_description) as bigint) as desc_len from d) b using (sku_id)
join (select sku_id, cast(len(regexp_extract_all(lower(title), '[a-z]+')) as bigint) as n_tokens from d) c
  using (sku_id)""")
def j5_key_join_blocks(spark, sf_dir):
    """Feature blocks computed separately, put side by side by key join
    (never by row position)."""
    from quire.functions.text import tokenise_alpha
    d = D(spark, sf_dir)
    a = d.select("sku_id", F.length("title").cast("long").alias("title_len"))
    b = d.select("sku_id", F.length("short_description").cast("long").alias("desc_len"))
    c = d.select("sku_id", F.size(tokenise_alpha("title")).cast("long").alias("n_tokens"))
    return a.join(b, "sku_id").join(c, "sku_id")


@query("j6_vector_lookup", oracle=views("v") + """
select sku_id, pos, word, cast(vec[1] as double) as v0, cast(len(vec) as bigint) as dim
from (select sku_id, unnest(generate_series(0, len(l) - 1)) as pos, unnest(l) as word
      from (select sku_id, list_filter(string_split(lower(regexp_replace(title, '[^a-zA-Z]', ' ', 'g')), ' '),
                                       lambda x: x <> '') as l from d)) t
join v using (word)""")
def j6_vector_lookup(spark, sf_dir):
    """Title tokens (with position) looked up in the word-vector table."""
    from quire.functions.text import tokenise_alpha
    from quire.plans.common import V
    d = D(spark, sf_dir)
    toks = d.select("sku_id", F.posexplode(tokenise_alpha("title")).alias("pos", "word"))
    vec = bounded(V(spark, sf_dir))
    return toks.join(vec, "word").select("sku_id", F.col("pos").cast("long").alias("pos"), "word",
                                         F.col("vec")[0].cast("double").alias("v0"),
                                         F.size("vec").cast("long").alias("dim"))


@query("j7_semi_anti_membership", oracle=views("d") + f"""
, w as (select sku_id, unnest(string_split(lower(title), ' ')) as word from d),
stops as (select unnest({_sql_arr(LX.STOP_WORDS)}) as word)
select sku_id, cast(count(*) filter (where word in (select word from stops)) as bigint) as n_stop,
  cast(count(*) filter (where word not in (select word from stops)) as bigint) as n_other
from w group by sku_id""")
def j7_semi_anti_membership(spark, sf_dir):
    """Title words that are stop words (left-semi) and that are not
    (left-anti), counted per listing."""
    from quire.functions.text import words_space
    from quire.operators.joins import literal_table
    d = D(spark, sf_dir)
    w = d.select("sku_id", F.posexplode(words_space(F.lower(F.col("title")))).alias("pos", "word"))
    stops = literal_table(spark, LX.STOP_WORDS, "word")
    semi = w.join(stops, "word", "left_semi").groupBy("sku_id").agg(F.count(F.lit(1)).alias("n_stop"))
    anti = w.join(stops, "word", "left_anti").groupBy("sku_id").agg(F.count(F.lit(1)).alias("n_other"))
    keys = w.select("sku_id").distinct()
    return (keys.join(semi, "sku_id", "left").join(anti, "sku_id", "left")
            .select("sku_id", F.coalesce("n_stop", F.lit(0)).alias("n_stop"),
                    F.coalesce("n_other", F.lit(0)).alias("n_other")))
