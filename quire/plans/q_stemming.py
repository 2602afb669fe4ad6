"""Queries: English stems (P16) and TF-IDF of stemmed titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import tokenise_words
from quire.operators import ngrams as NG
from quire.operators import stemming as ST
from quire.operators.joins import materialize
from quire.plans.common import D, r
from quire.plans.oracle_views import views
from quire.plans.q_clean import WORD_TOKENS_SQL
from quire.plans.registry import query

TOKENS = WORD_TOKENS_SQL.format("title")


def _longest_first(rules) -> list[str]:
    return sorted(rules, key=lambda s: (-len(s), s))


def _step(name: str, source: str, cases: str) -> str:
    return f"{name} as (select token, p1, p2, case {cases} else w end as w from {source})"


def _rules(rules: dict[str, str], region: str, extra: dict[str, str]) -> str:
    """One branch a suffix, the longest first; a suffix that may not go ends the step."""
    out = []
    for s in _longest_first(rules):
        ok = f"length(w) - {len(s)} >= {region}" + (f" and {extra[s]}" if s in extra else "")
        out.append(f"when suffix(w, '{s}') then case when {ok} then left(w, length(w) - {len(s)}) || '{rules[s]}' else w end")
    return " ".join(out)


def stem_sql(tokens: str) -> str:
    """CTEs up to ``st`` (token, stem) over a view ``tokens`` (token)."""
    region = "coalesce(nullif(strpos(regexp_replace({0}, '[aeiouy][^aeiouy]', '##'), '##'), 0) + 1, length({0}))"
    short = "(regexp_matches({0}, '^[aeiouy][^aeiouy]$') or regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"
    stops = ", ".join(f"'{s}'" for s in ST.STOP_AFTER_1A)
    marked = "regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"
    prefix = " ".join(f"when starts_with(w, '{p}') then {len(p)}" for p in ST.LONG_PREFIXES)
    cut = []
    for s in ("ingly", "edly", "ing", "ed"):
        b = f"left(w, length(w) - {len(s)})"
        cut.append(f"when suffix(w, '{s}') and not suffix(w, 'eed') and not suffix(w, 'eedly') then case "
                   f"when not regexp_matches({b}, '[aeiouy]') then w "
                   f"when right({b}, 2) in ('at', 'bl', 'iz') then {b} || 'e' "
                   f"when right({b}, 2) in ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') then left({b}, length({b}) - 1) "
                   f"when length({b}) <= p1 and {short.format(b)} then {b} || 'e' else {b} end")
    step_1b = (f"when w in ({stops}) then w "
               + " ".join(f"when suffix(w, '{s}') then case when length(w) - {len(s)} >= p1 then left(w, length(w) - {len(s)}) || 'ee' "
                          "else w end" for s in ("eedly", "eed")) + " " + " ".join(cut))
    base = "left(w, length(w) - 1)"
    exceptions = " ".join(f"when '{k}' then '{v}'" for k, v in ST.EXCEPTIONS.items())
    return f"""
tk as (select distinct token from {tokens}),
s0 as (select token, {marked} as w from tk),
s1 as (select token, w, case {prefix} else {region.format('w')} end as p1 from s0),
s2 as (select token, w, p1, substr(w, p1 + 1) as rest from s1),
s3 as (select token, w, p1, p1 + {region.format('rest')} as p2 from s2),
{_step('s4', 's3', f'''when suffix(w, 'sses') then left(w, length(w) - 2)
   when suffix(w, 'ied') or suffix(w, 'ies') then left(w, length(w) - (case when length(w) > 4 then 2 else 1 end))
   when suffix(w, 'us') or suffix(w, 'ss') then w
   when suffix(w, 's') and regexp_matches(left(w, length(w) - 2), '[aeiouy]') then {base}''')},
{_step('s5', 's4', step_1b)},
{_step('s6', 's5', f"when lower(right(w, 1)) = 'y' and length(w) > 2 and not regexp_matches({base}, '[aeiouy]$') then {base} || 'i'")},
{_step('s7', 's6', _rules(ST.STEP_2, 'p1', {'ogi': "suffix(w, 'logi')", 'li': "regexp_matches(w, '[cdeghkmnrt]li$')"}))},
{_step('s8', 's7', _rules(ST.STEP_3, 'p1', {'ative': 'length(w) - 5 >= p2'}))},
{_step('s9', 's8', _rules(dict.fromkeys(ST.STEP_4, ''), 'p2', {'ion': "regexp_matches(w, '[st]ion$')"}))},
{_step('s10', 's9', f'''when suffix(w, 'e') and (length(w) - 1 >= p2 or (length(w) - 1 >= p1 and not {short.format(base)})) then {base}
   when suffix(w, 'll') and length(w) - 1 >= p2 then {base}''')},
st as (select token, case when length(token) <= 2 then token else case token {exceptions} else replace(w, 'Y', 'y') end end as stem
       from s10)"""


STEMS = views("d") + f""",
tks as (select sku_id, unnest(t) as token, unnest(range(len(t))) as i from (select sku_id, {TOKENS} as t from d)),""" + stem_sql("tks")


@query("p16_stem_tokens_english", oracle=STEMS + """
select d.sku_id, case when title is not null then coalesce(stems, '') end as stems from d left join (
  select sku_id, string_agg(stem, ' ' order by i) as stems from tks join st using (token) group by sku_id) using (sku_id)""")
def p16_stem_tokens_english(spark, sf_dir):
    """English stems of the title's word tokens, in their order."""
    d = materialize(D(spark, sf_dir).select("sku_id", tokenise_words("title").alias("tok")))
    return ST.stem_arrays(d, "sku_id", "tok").select("sku_id", F.array_join("stems", " ").alias("stems"))


@query("n6_tfidf_stemmed_english", oracle=STEMS + """,
tc as (select sku_id, stem as term, count(*) as tf from tks join st using (token) group by sku_id, stem),
df as (select term, count(*) as df from tc group by term),
raw as (select sku_id, term, tf * (ln((1.0 + (select count(*) from d)) / (1.0 + df)) + 1.0) as x from tc join df using (term))
select sku_id, term, round(x / sqrt(sum(x * x) over (partition by sku_id)), 6) as weight from raw""")
def n6_tfidf_stemmed_english(spark, sf_dir):
    """TF-IDF of the English stems of the title words."""
    d = D(spark, sf_dir)
    counts = materialize(NG.term_counts(d, "sku_id", tokenise_words("title")))
    w = NG.tfidf(materialize(ST.stemmed_counts(counts, "sku_id")), "sku_id", NG.n_rows(d))
    return w.select("sku_id", "term", r("weight").alias("weight"))
