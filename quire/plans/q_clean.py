"""Queries: projections, cleaning and derived keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.groups import value_counts
from quire.operators.joins import bounded
from quire.plans.common import C, D, H, r
from quire.plans.oracle_views import views
from quire.plans.registry import query

CATS = ["category_lvl_1", "category_lvl_2", "category_lvl_3"]
PYWS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
        r"\x{205f}\x{3000}]")
WS_WORDS_SQL = "list_filter(regexp_split_to_array({0}, '" + PYWS + "+'), lambda x: x <> '')"


@query("p1_clean_html", oracle=views("h") + r"""
select sku_id, regexp_replace(short_description, '<[^\n]*?>', '', 'g') as description
from h""")
def p1_clean_html(spark, sf_dir):
    """Remove tags non-greedily, never across a newline."""
    return H(spark, sf_dir).select("sku_id", X.clean_html("short_description").alias("description"))


@query("p2_strip_tags_strict", oracle=views("h") + r"""
select sku_id, regexp_replace(short_description, '<[^<]+?>', '', 'g') as description
from h""")
def p2_strip_tags_strict(spark, sf_dir):
    """Remove tags that contain no '<' (a tag may span lines)."""
    return H(spark, sf_dir).select("sku_id", X.strip_tags_strict("short_description").alias("description"))


@query("p3_decode_entities", oracle=views("h") + r"""
select sku_id, replace(replace(title, '&amp;', '&'), '&nbsp;', ' ') as title
from h""")
def p3_decode_entities(spark, sf_dir):
    """&amp; and &nbsp; decoded in the page title."""
    return H(spark, sf_dir).select("sku_id", X.decode_entities("title").alias("title"))


@query("p4_space_punctuation", oracle=views("d") + r"""
select sku_id, replace(replace(replace(replace(replace(title, '(', ' ( '), ')', ' ) '), '/', ' / '), '  ', ' '),
                       chr(9), ' ') as title
from d""")
def p4_space_punctuation(spark, sf_dir):
    """Spaces around brackets and slashes, one collapse of double spaces."""
    return D(spark, sf_dir).select("sku_id", X.space_punctuation("title").alias("title"))


@query("p5_normalise_category_words", oracle=views("d") + r"""
select sku_id, replace(replace(replace(replace(lower(title), ', ', ' '), '/ ', ' '), '& ', ' '), '  ', ' ') as title
from d""")
def p5_normalise_category_words(spark, sf_dir):
    """Lower case; ', ', '/ ', '& ' to a space (applied to the title text)."""
    return D(spark, sf_dir).select("sku_id", X.normalise_category_words("title").alias("title"))


@query("p6_strip_category_punct", oracle=views("h") + r"""
select sku_id, regexp_replace(title, '[&/,]', '', 'g') as title from h""")
def p6_strip_category_punct(spark, sf_dir):
    """Delete '&', '/' and ','."""
    return H(spark, sf_dir).select("sku_id", X.strip_category_punct("title").alias("title"))


@query("p7_convert_price", oracle=views("c") + r"""
select sku_id, round(case when country = 'sg' then price when country = 'my' then price * 0.32
                          else price * 0.074 end, 6) as price_converted
from c""")
def p7_convert_price(spark, sf_dir):
    """Local price to one currency by country rate."""
    return C(spark, sf_dir).select("sku_id", r(X.convert_price()).alias("price_converted"))


@query("p8_category_combo_keys", oracle=views("c") + r"""
select sku_id,
  coalesce(category_lvl_1, 'NA') || '-' || coalesce(category_lvl_2, 'NA') as category_lvl_12,
  coalesce(category_lvl_2, 'NA') || '-' || coalesce(category_lvl_3, 'NA') as category_lvl_23,
  coalesce(category_lvl_1, 'NA') || '-' || coalesce(category_lvl_3, 'NA') as category_lvl_13,
  coalesce(category_lvl_1, 'NA') || '-' || coalesce(category_lvl_2, 'NA') || '-' || coalesce(category_lvl_3, 'NA')
    as category_lvl_123
from c""")
def p8_category_combo_keys(spark, sf_dir):
    """Category combination keys 12, 23, 13, 123 after the 'NA' fill."""
    c1, c2, c3 = CATS
    return C(spark, sf_dir).select(
        "sku_id",
        X.combo_key(c1, c2).alias("category_lvl_12"), X.combo_key(c2, c3).alias("category_lvl_23"),
        X.combo_key(c1, c3).alias("category_lvl_13"), X.combo_key(c1, c2, c3).alias("category_lvl_123"))


SKU_SLICES = {"sku_0_5": (None, 5), "sku_5_9": (5, 9), "sku_0_2": (None, 2), "sku_m2": (-2, None),
              "sku_5_7": (5, 7), "sku_m5_m4": (-5, -4)}


@query("p9_sku_slices", oracle=views("c") + r"""
select sku_id,
  substr(sku_id, 1, 5) as sku_0_5, substr(sku_id, 6, 4) as sku_5_9, substr(sku_id, 1, 2) as sku_0_2,
  substr(sku_id, greatest(length(sku_id) - 1, 1)) as sku_m2, substr(sku_id, 6, 2) as sku_5_7,
  case when length(sku_id) >= 5 then substr(sku_id, length(sku_id) - 4, 1) else '' end as sku_m5_m4
from c""")
def p9_sku_slices(spark, sf_dir):
    """Python slices of the listing key."""
    return C(spark, sf_dir).select(
        "sku_id", *[X.py_slice("sku_id", a, b).alias(n) for n, (a, b) in SKU_SLICES.items()])


@query("p10_category_token_at", oracle=views("c") + ",\n" + ",\n".join(
    f"t{n} as (select sku_id, string_split(regexp_replace(coalesce({c}, 'NA'), '[&/,]', '', 'g'), ' ') as w from c)"
    for n, c in enumerate(CATS)) + "\n" + " union all ".join(
    f"select sku_id, {n + 1} as level, cast(i as int) as pos, coalesce(w[i + 1], 'NA') as token "
    f"from t{n}, (select unnest(range(0, max(len(w)))) as i from t{n})" for n in range(len(CATS))))
def p10_category_token_at(spark, sf_dir):
    """Space tokens of each category (after the punctuation strip) at every
    position up to the longest category's, 'NA' when missing, in long form;
    the label encoding is G1."""
    c = C(spark, sf_dir)
    out = None
    for n, k in enumerate(CATS):
        words = c.select("sku_id", X.words_space(X.strip_category_punct(F.coalesce(F.col(k), F.lit("NA")))).alias("w"))
        longest = c.select(F.max(F.size(X.words_space(X.strip_category_punct(F.coalesce(F.col(k), F.lit("NA"))))))).scalar()
        part = (words.select("sku_id", "w", F.explode(F.sequence(F.lit(0), longest - 1)).alias("pos"))
                .select("sku_id", F.lit(n + 1).alias("level"), "pos", F.coalesce(F.get("w", F.col("pos")), F.lit("NA")).alias("token")))
        out = part if out is None else out.unionByName(part)
    return out


@query("p11_title_word_at", oracle=views("d") + r"""
select sku_id,
""" + ",\n".join(f"  coalesce(({WS_WORDS_SQL.replace('{0}', 'title')})[{i + 1}], 'NA') as word_{i}"
                for i in range(1, 12)) + "\nfrom d")
def p11_title_word_at(spark, sf_dir):
    """Title words at positions 1..11 (0-based), 'NA' when missing."""
    return D(spark, sf_dir).select("sku_id", *[X.ws_token_at("title", i).alias(f"word_{i}") for i in range(1, 12)])


SHAPE_SQL = ("translate(regexp_replace(regexp_replace(regexp_replace({0}, '\\p{{Nd}}', chr(1), 'g'), "
             "'\\p{{Lu}}', chr(2), 'g'), '\\p{{L}}', chr(3), 'g'), chr(1) || chr(2) || chr(3), 'NAa')")


@query("p12_char_shape", oracle=views("d") + "select sku_id, " + SHAPE_SQL.format("title") + " as shape from d")
def p12_char_shape(spark, sf_dir):
    """Character shape of the title: A / a / N, other characters kept."""
    return D(spark, sf_dir).select("sku_id", X.char_shape("title").alias("shape"))


ALPHA_TOKENS_SQL = ("list_filter(string_split(lower(regexp_replace({0}, '[^a-zA-Z]', ' ', 'g')), ' '), "
                    "lambda x: x <> '')")


@query("p13_tokenise_alpha", oracle=views("d") + "select sku_id, array_to_string(" + ALPHA_TOKENS_SQL.format("title")
       + ", ' ') as tokens, cast(len(" + ALPHA_TOKENS_SQL.format("title") + ") as bigint) as n_tokens from d")
def p13_tokenise_alpha(spark, sf_dir):
    """Letters-only lower-case tokens (joined with a space for comparison)."""
    t = X.tokenise_alpha("title")
    return D(spark, sf_dir).select("sku_id", F.array_join(t, " ").alias("tokens"),
                                   F.size(t).cast("long").alias("n_tokens"))


RARE_MIN = 10


@query("p14_tokenise_unique_filtered", oracle=views("d") + f"""
, tok as (select sku_id, unnest({ALPHA_TOKENS_SQL.format("title")}) as w from d),
rare as (select w from tok group by w having count(*) < {RARE_MIN}),
kept as (select distinct sku_id, w from tok where w not in (select w from rare))
select d.sku_id, coalesce(array_to_string(list_sort(list(k.w) filter (where k.w is not null)), ' '), '') as tokens
from d left join kept k on d.sku_id = k.sku_id group by d.sku_id""")
def p14_tokenise_unique_filtered(spark, sf_dir):
    """Distinct title tokens minus the rare ones (corpus count < 10), sorted.

    The rare set is a derived table: tokens are exploded, anti-joined with
    it (size-checked broadcast) and re-collected per listing - each group
    is one listing's distinct tokens."""
    d = D(spark, sf_dir)
    tok = d.select("sku_id", F.explode(X.tokenise_alpha("title")).alias("w"))
    rare = value_counts(tok, "w", "n").where(F.col("n") < RARE_MIN).select("w")
    kept = tok.distinct().join(bounded(rare), "w", "left_anti")
    per = kept.groupBy("sku_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("tokens"))
    return (d.select("sku_id").join(per, "sku_id", "left")
            .select("sku_id", F.coalesce("tokens", F.lit("")).alias("tokens")))


WORD_TOKENS_SQL = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Mn}}\\p{{Nd}}_]{{2,}}')"


@query("p15_tokenise_words", oracle=views("d") + "select sku_id, array_to_string(" + WORD_TOKENS_SQL.format("title")
       + ", ' ') as tokens from d")
def p15_tokenise_words(spark, sf_dir):
    """Word tokens of two or more word characters, lower case."""
    return D(spark, sf_dir).select("sku_id", F.array_join(X.tokenise_words("title"), " ").alias("tokens"))


STEM_SQL = ("list_transform({0}, lambda w: case "
            "when suffix(w, 'ies') and not suffix(w, 'eies') and not suffix(w, 'aies') then left(w, length(w) - 3) || 'y' "
            "when suffix(w, 'es') and not suffix(w, 'aes') and not suffix(w, 'ees') and not suffix(w, 'oes') "
            "then left(w, length(w) - 1) "
            "when suffix(w, 's') and not suffix(w, 'us') and not suffix(w, 'ss') then left(w, length(w) - 1) "
            "else w end)")


@query("p16_stem_tokens", oracle=views("d") + "select sku_id, array_to_string(" + STEM_SQL.format(
    WORD_TOKENS_SQL.format("title")) + ", ' ') as stems from d")
def p16_stem_tokens(spark, sf_dir):
    """S-stemmer (plural stripping) of the word tokens."""
    return D(spark, sf_dir).select("sku_id", F.array_join(X.stem_tokens(X.tokenise_words("title")), " ").alias("stems"))


@query("p17_one_hot_label", oracle=views("d") + """
select sku_id, cast(1 - conciseness as double) as y0, cast(conciseness as double) as y1 from d
where conciseness is not null""")
def p17_one_hot_label(spark, sf_dir):
    """Label 0/1 as a 2-vector (two columns here)."""
    d = D(spark, sf_dir).where(F.col("conciseness").isNotNull())
    v = X.one_hot_label("conciseness")
    return d.select("sku_id", v[0].alias("y0"), v[1].alias("y1"))


@query("p18_nan_to_zero", oracle=views("d") + """
select sku_id, coalesce(cast(conciseness as double), 0.0) as conciseness, coalesce(cast(clarity as double), 0.0) as clarity,
       coalesce(price / nullif(length(title), 0), 0.0) as price_per_char from d""")
def p18_nan_to_zero(spark, sf_dir):
    """Null / NaN to 0 over a block of columns."""
    d = D(spark, sf_dir).withColumn("price_per_char", X.safe_div(F.col("price"), F.length("title")))
    return d.select("sku_id", *[X.zero_fill(c).alias(c) for c in ("conciseness", "clarity", "price_per_char")])


@query("p19_cast_block_to_double", oracle=views("c") + """
select sku_id, cast(length(title) as double) as title_len, cast(length(sku_id) as double) as sku_len,
       cast(price as double) as price from c""")
def p19_cast_block_to_double(spark, sf_dir):
    """Integer features cast to double before saving a block."""
    c = C(spark, sf_dir).select("sku_id", F.length("title").alias("title_len"),
                                F.length("sku_id").alias("sku_len"), "price")
    return c.select("sku_id", *[F.col(k).cast("double").alias(k) for k in ("title_len", "sku_len", "price")])
