"""Queries: encodings (G1-G5), folds (M1) and sample weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import word_len_space
from quire.operators import encode as EN
from quire.operators.folds import class_weights, stratified_folds
from quire.plans.common import C, D, r
from quire.plans.oracle_views import views
from quire.plans.registry import query

CATS = ["category_lvl_1", "category_lvl_2", "category_lvl_3"]


@query("g1_label_encode", oracle=views("c") + """
select sku_id, """ + ", ".join(
    f"cast(dense_rank() over (order by coalesce({k}, 'NA')) - 1 as bigint) as {k}_code" for k in CATS) + " from c")
def g1_label_encode(spark, sf_dir):
    """Label codes of the three categories ('NA' for nulls): rank of the
    value among the sorted distinct values, from 0."""
    c = C(spark, sf_dir).select("sku_id", *[F.coalesce(F.col(k), F.lit("NA")).alias(k) for k in CATS])
    c = EN.label_encode_many(c, CATS)
    return c.select("sku_id", *[f"{k}_code" for k in CATS])


RARE_MIN = 70


@query("g2_collapse_rare", oracle=views("d") + f"""
select sku_id, v as category_lvl_2, cast(dense_rank() over (order by v) - 1 as bigint) as category_lvl_2_code
from (select sku_id, case when count(*) over (partition by category_lvl_2) < {RARE_MIN} then 'Others'
                          else category_lvl_2 end as v from d)""")
def g2_collapse_rare(spark, sf_dir):
    """Sources seen fewer than 70 times become 'Others', then label codes."""
    d = D(spark, sf_dir).select("sku_id", "category_lvl_2")
    d = EN.collapse_rare(d, "category_lvl_2", RARE_MIN)
    return EN.label_encode(d, "category_lvl_2", "category_lvl_2_code").select(
        "sku_id", "category_lvl_2", "category_lvl_2_code")


G3_COLS = ["category_lvl_1", "category_lvl_2", "category_lvl_3", "product_type"]


def _g3_sql(src: str = "c", cols: list[str] = G3_COLS) -> str:
    parts, offset = [], "0"
    for k in cols:
        parts.append(f"select sku_id, '{k}' as column_name, cast(dense_rank() over (order by coalesce({k}, 'NA')) - 1 "
                     f"+ {offset} as bigint) as index from {src}")
        offset += f" + (select count(distinct coalesce({k}, 'NA')) from {src})"
    return views(src) + " union all ".join(parts)


@query("g3_one_hot_block", oracle=_g3_sql())
def g3_one_hot_block(spark, sf_dir):
    """One-hot blocks of categories and product type, long form: the column
    index of each listing's 1 in the stacked sparse block."""
    c = C(spark, sf_dir).select("sku_id", *[F.coalesce(F.col(k), F.lit("NA")).alias(k) for k in G3_COLS])
    out = EN.one_hot_long(c, "sku_id", G3_COLS)
    return out.select("sku_id", "column_name", F.col("index").cast("long"))


G3_DESC_COLS = CATS + ["short_description"]


@query("g3_one_hot_block_description", oracle=_g3_sql("d", G3_DESC_COLS))
def g3_one_hot_block_description(spark, sf_dir):
    """One-hot blocks of categories and whole descriptions of the document
    listings, long form as in g3_one_hot_block."""
    d = D(spark, sf_dir).select("sku_id", *[F.coalesce(F.col(k), F.lit("NA")).alias(k) for k in G3_DESC_COLS])
    out = EN.one_hot_long(d, "sku_id", G3_DESC_COLS)
    return out.select("sku_id", "column_name", F.col("index").cast("long"))


TRAIN_SQL = "split = 'trn' and clarity is not null"


def _train(d):
    return d.where((F.col("split") == "trn") & F.col("clarity").isNotNull())


@query("g4_target_mean_encode", oracle=views("d") + ", " + f"""
tr as (select * from d where {TRAIN_SQL}), prior as (select avg(clarity) as p from tr)
select sku_id, """ + ", ".join(
    f"round(coalesce((select avg(clarity) from tr where tr.{k} = d.{k}), (select p from prior)), 6) as {k}_te"
    for k in CATS) + " from d")
def g4_target_mean_encode(spark, sf_dir):
    """Mean clarity of each category value over labelled training rows;
    unseen values get the global training mean."""
    d = D(spark, sf_dir)
    tr = _train(d)
    out = d.select("sku_id", *CATS)
    for k in CATS:
        out = EN.target_mean_encode(out, tr, k, "clarity", f"{k}_te")
    return out.select("sku_id", *[r(f"{k}_te").alias(f"{k}_te") for k in CATS])


G5_COLS = CATS + ["title_len"]


@query("g5_leave_one_out_encode", oracle=views("d") + ", " + f"""
dd as (select *, len(string_split(title, ' ')) as title_len, {TRAIN_SQL} as is_tr from d),
tr as (select * from dd where is_tr), prior as (select avg(clarity) as p from tr)
select sku_id, """ + ", ".join(
    f"""round(case when is_tr then
       case when (select count(*) from tr where tr.{k} = dd.{k}) > 1
            then ((select sum(clarity) from tr where tr.{k} = dd.{k}) - clarity)
                 / ((select count(*) from tr where tr.{k} = dd.{k}) - 1)
            else (select p from prior) end
     else coalesce((select avg(clarity) from tr where tr.{k} = dd.{k}), (select p from prior)) end, 6) as {k}_loo"""
    for k in G5_COLS) + " from dd")
def g5_leave_one_out_encode(spark, sf_dir):
    """Leave-one-out clarity encoding of categories and title length: on
    training rows the row's own label is left out; other rows get the
    value mean (no noise here; ``noise_sigma`` adds it)."""
    d = D(spark, sf_dir).withColumn("title_len", word_len_space("title"))
    is_tr = (F.col("split") == "trn") & F.col("clarity").isNotNull()
    tr = d.where(is_tr)
    out = d.select("sku_id", "split", "clarity", *G5_COLS)
    for k in G5_COLS:
        out = EN.leave_one_out_encode(out, tr, k, "clarity", f"{k}_loo", is_tr)
    return out.select("sku_id", *[r(f"{k}_loo").alias(f"{k}_loo") for k in G5_COLS])


def _loo_more_sql(label: str, cols: list[str]) -> str:
    parts = []
    for k in cols:
        own = f"over (partition by {k})"
        n, s = f"count(*) filter (is_tr) {own}", f"sum({label}) filter (is_tr) {own}"
        parts.append(f"round(case when is_tr and {n} > 1 then ({s} - {label}) / ({n} - 1) when not is_tr and {n} > 0 "
                     f"then {s} / {n} else avg({label}) filter (is_tr) over () end, 6) as {k}_loo")
    return views("d") + f""", dd as (
  select *, len(string_split(coalesce(title, 'NA'), ' ')) as title_len,
         coalesce(category_lvl_1, 'NA') || cast(len(string_split(coalesce(title, 'NA'), ' ')) as varchar) as cat_title_len,
         split = 'trn' and {label} is not null as is_tr from d)
select sku_id, {', '.join(parts)} from dd"""


def _loo_more(spark, sf_dir, label: str, cols: list[str]):
    d = D(spark, sf_dir).withColumn("title_len", word_len_space(F.coalesce("title", F.lit("NA"))))
    d = d.withColumn("cat_title_len", F.concat(F.coalesce("category_lvl_1", F.lit("NA")), F.col("title_len").cast("string")))
    is_tr = (F.col("split") == "trn") & F.col(label).isNotNull()
    out = d.select("sku_id", "split", label, *cols)
    for k in cols:
        out = EN.leave_one_out_encode(out, d.where(is_tr), k, label, f"{k}_loo", is_tr)
    return out.select("sku_id", *[r(f"{k}_loo").alias(f"{k}_loo") for k in cols])


@query("g5_leave_one_out_encode_cat_title_len", oracle=_loo_more_sql("clarity", ["cat_title_len"]))
def g5_leave_one_out_encode_cat_title_len(spark, sf_dir):
    """Leave-one-out clarity encoding of category 1 with the title length."""
    return _loo_more(spark, sf_dir, "clarity", ["cat_title_len"])


@query("g5_leave_one_out_encode_conciseness", oracle=_loo_more_sql("conciseness", G5_COLS))
def g5_leave_one_out_encode_conciseness(spark, sf_dir):
    """Leave-one-out conciseness encoding of categories and title length."""
    return _loo_more(spark, sf_dir, "conciseness", G5_COLS)


@query("m1_stratified_folds", oracle=views("d") + """
select sku_id, conciseness,
  cast((row_number() over (partition by conciseness order by md5(sku_id || '2017'), sku_id) - 1) % 10 as int) as fold
from d where conciseness is not null""")
def m1_stratified_folds(spark, sf_dir):
    """10 folds stratified on conciseness: per-class hash order dealt
    round-robin (seed 2017 = fold set 0)."""
    return stratified_folds(D(spark, sf_dir), "sku_id", "conciseness", 10, 2017)


# ---------------------------------------------------------------- fixed values
# Class weights of the re-weighted level-2 models (class 0, class 1).
CONCISENESS_WEIGHTS = {0: 1.0, 1: 0.9614}
CLARITY_WEIGHTS = {0: 1.0, 1: 0.923623177 / 0.943362}


@query("m13_sample_weights", oracle=views("d") + """
select sku_id, round(wc / avg(wc) over (), 6) as w_conciseness, round(wk / avg(wk) over (), 6) as w_clarity from (
  select sku_id, case conciseness when 0 then 1.0 when 1 then 0.9614 end as wc,
         case clarity when 0 then 1.0 when 1 then 0.923623177::double / 0.943362::double end as wk
  from d where conciseness is not null and clarity is not null)""")
def m13_sample_weights(spark, sf_dir):
    """Class weights of both labels divided by their mean over the labelled rows."""
    d = D(spark, sf_dir).where("conciseness is not null and clarity is not null")
    out = class_weights(d, "conciseness", CONCISENESS_WEIGHTS, "w_conciseness")
    out = class_weights(out, "clarity", CLARITY_WEIGHTS, "w_clarity")
    return out.select("sku_id", r("w_conciseness").alias("w_conciseness"), r("w_clarity").alias("w_clarity"))
