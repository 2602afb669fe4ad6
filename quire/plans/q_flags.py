"""Queries: predicates and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import flags as FL
from quire.functions import items as IT
from quire.operators.groups import mine_attributes
from quire.operators.ordered import top_k
from quire.plans.common import C, D, H
from quire.plans.oracle_views import views
from quire.plans.registry import query
from quire.sources.fixtures import conversation_listings
from quire.sources import lexicons as LX

PYWS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
        r"\x{205f}\x{3000}]")


def _any_sql(src: str, terms: list[str]) -> str:
    def q(t):
        return "'" + t.replace("'", "''") + "'"
    return "cast((" + " or ".join(f"contains(lower({src}), {q(t)})" for t in terms) + ") as int)"


def _block_sql(src: str, spec: dict[str, list[str]]) -> str:
    return ", ".join(f"{_any_sql(src, terms)} as {name}" for name, terms in spec.items())


F1_SPEC = {"has_storage_size": FL.STORAGE_SIZE_TERMS, "has_storage": FL.STORAGE_TERMS,
           "has_screen_size": FL.SCREEN_SIZE_TERMS, "has_screen": FL.SCREEN_TERMS, "has_cpu": FL.CPU_TERMS}


@query("f1_device_flags", oracle=views("d") + "select sku_id, " + _block_sql("title", F1_SPEC) + " from d")
def f1_device_flags(spark, sf_dir):
    """Storage / screen / cpu term flags of the title."""
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in FL.device_flags("title").items()])


@query("f2_title_unit_flags", oracle=views("d") + "select sku_id, " + _block_sql("title", FL.TITLE_UNIT_FLAGS)
       + " from d")
def f2_title_unit_flags(spark, sf_dir):
    """Year, weight, size, length, dimension and pieces flags."""
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in FL.flag_block("title", FL.TITLE_UNIT_FLAGS).items()])


@query("f3_title_noun_flags", oracle=views("c") + "select sku_id, " + _block_sql("title", FL.TITLE_NOUN_FLAGS)
       + " from c")
def f3_title_noun_flags(spark, sf_dir):
    """Women / men / fashion / watch / brand / bag / shoe flags."""
    return C(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in FL.flag_block("title", FL.TITLE_NOUN_FLAGS).items()])


@query("f4_description_topic_flags", oracle=views("d") + "select sku_id, " + _block_sql(
    "short_description", FL.DESC_TOPIC_FLAGS) + " from d")
def f4_description_topic_flags(spark, sf_dir):
    """Condition / size / color / material / capacity / style mentions."""
    return D(spark, sf_dir).select(
        "sku_id", *[v.alias(k) for k, v in FL.flag_block("short_description", FL.DESC_TOPIC_FLAGS).items()])


@query("f5_punctuation_flags", oracle=views("d") + "select sku_id, " + ", ".join(
    "cast((" + " or ".join(f"strpos(lower(title), '{t.replace(chr(39), chr(39) * 2)}') > 1" for t in terms)
    + f") as int) as {name}" for name, terms in FL.PUNCT_FLAGS.items()) + " from d")
def f5_punctuation_flags(spark, sf_dir):
    """'=', quote, ':' and bracket found after the first character."""
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in
                                               FL.punctuation_flags(F.lower(F.col("title"))).items()])


@query("f6_html_entity_flags", oracle=views("h") + """
select sku_id, cast(contains(title, '&amp;') as int) as title_has_html_and,
  cast(contains(title, '&nbsp;') as int) as title_has_html_space,
  cast(contains(short_description, '&amp;') as int) as desc_has_html_and,
  cast(contains(short_description, '&nbsp;') as int) as desc_has_html_space,
  cast(contains(short_description, 'class=') as int) as desc_has_html_class,
  cast(contains(short_description, 'style=') as int) as desc_has_html_style
from h""")
def f6_html_entity_flags(spark, sf_dir):
    """Entity and attribute markers in title and description."""
    return H(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in
                                               FL.html_entity_flags("title", "short_description").items()])


STRIP_SQL = "regexp_replace({0}, '^" + PYWS + "+|" + PYWS + "+$', '', 'g')"


@query("f7_html_boundary_flags", oracle=views("h") + "select sku_id, " + ", ".join(
    [f"cast(starts_with({STRIP_SQL.replace('{0}', 'short_description')}, '{v}') as int) as {k}"
     for k, v in FL.HTML_START.items()]
    + [f"cast(suffix({STRIP_SQL.replace('{0}', 'short_description')}, '{v}') as int) as {k}"
       for k, v in FL.HTML_END.items()]) + " from h")
def f7_html_boundary_flags(spark, sf_dir):
    """Stripped description starts / ends with ul, div or p tags."""
    return H(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in
                                               FL.html_boundary_flags("short_description").items()])


LEX_WORDS_SQL = ("list_transform(string_split(lower(title), ' '), lambda w: "
                 + STRIP_SQL.replace("{0}", "translate(w, '()[]', '')") + ")")


def _arr(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


@query("f8_lexicon_hit", oracle=views("c") + f"""
select sku_id, cast(list_has_any({LEX_WORDS_SQL}, {_arr(LX.BRANDS)}) as int) as title_has_brand,
  cast(list_has_any({LEX_WORDS_SQL}, {_arr(LX.COLORS)}) as int) as title_has_color
from c""")
def f8_lexicon_hit(spark, sf_dir):
    """Some title word is a known brand / color."""
    return C(spark, sf_dir).select("sku_id", FL.lexicon_hit("title", LX.BRANDS).alias("title_has_brand"),
                                   FL.lexicon_hit("title", LX.COLORS).alias("title_has_color"))


WS_WORDS = "list_filter(regexp_split_to_array({0}, '" + PYWS.replace("{", "{{").replace("}", "}}") + "+'), lambda x: x <> '')"


@query("f9_looks_like_model", oracle=views("h") + f"""
select sku_id, coalesce(cast(regexp_matches(l[-1], '[0-9]') and regexp_matches(l[-1], '[A-Za-z]') as int), 0)
  as title_has_model
from (select sku_id, {WS_WORDS.format('title')} as l from h)""")
def f9_looks_like_model(spark, sf_dir):
    """The last title word mixes letters and digits."""
    return H(spark, sf_dir).select("sku_id", FL.looks_like_model("title").alias("title_has_model"))


@query("f10_ranked_term_flags", oracle=views("d") + "select sku_id, " + ", ".join(
    f"cast(contains(lower(title), '{t}') as int) as has_{i}" for i, t in enumerate(LX.RANKED_TERMS)) + " from d")
def f10_ranked_term_flags(spark, sf_dir):
    """One flag per ranked term (substring of the lower title)."""
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in FL.term_flags("title", LX.RANKED_TERMS).items()])


TOP_ATTRIBUTES = 150


def top_attributes(h, k: int = TOP_ATTRIBUTES):
    items = h.select(IT.extract_items("short_description").alias("items"), "short_description")
    mined = mine_attributes(items, "items", "short_description")
    return top_k(mined, [F.col("count").desc(), F.col("att").asc()], k)


ITEMS_SQL = ("list_transform(regexp_extract_all({0}, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1), lambda x: "
             + STRIP_SQL.replace("{0}", "replace(replace(replace(replace(replace(replace("
                                 "regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
                                 "'&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')") + ")")


def mined_sql(src: str = "h") -> str:
    return f"""
, its as (select case when contains(short_description, '<li')
                      then {ITEMS_SQL.replace('{0}', 'short_description')} else [short_description] end as l from {src}),
flat as (select replace(unnest(l), ' : ', ': ') as it from its),
mined as (select lower(split_part(it, ':', 1)) as att, count(*) as cnt from flat where strpos(it, ':') > 1
          group by 1 having count(*) >= 2)"""


def descriptions(spark, sf_dir):
    """Listing descriptions of the page (H), document (D) and conversation
    (T) views; the last list ``role : text`` items."""
    return (H(spark, sf_dir).select("sku_id", "short_description")
            .unionByName(D(spark, sf_dir).select("sku_id", "short_description"))
            .unionByName(conversation_listings(spark, sf_dir)))


DESC_SQL = ("desc_all as (select sku_id, short_description from h union all select sku_id, short_description from d "
            "union all select sku_id, short_description from t)")


@query("f11_attribute_presence_flags", oracle=views("h", "d", "t") + ", " + DESC_SQL + mined_sql("desc_all") + f"""
, top as (select att from mined order by cnt desc, att limit {TOP_ATTRIBUTES})
select sku_id, att from desc_all join top on contains(lower(short_description), att)""")
def f11_attribute_presence_flags(spark, sf_dir):
    """Long form (sku_id, att): which of the top-150 mined attributes each
    description mentions. The top-k list (at most 150 names) is the only
    driver-side value; the flags are one literal-array filter per row."""
    h = descriptions(spark, sf_dir)
    atts = [r["att"] for r in top_attributes(h).collect()]
    arr = F.array(*[F.lit(a) for a in atts]) if atts else F.array().cast("array<string>")
    low = h.select("sku_id", F.lower("short_description").alias("low"))  # a column, not re-evaluated per name
    return low.select("sku_id", F.explode(F.filter(arr, lambda a: F.contains(F.col("low"), a))).alias("att"))
