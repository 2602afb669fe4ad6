"""Queries on lexicon tables of thousands of phrases.

The lexicons are given tables in the listing model. Here they are the clauses
of one to four words that conversations (brands) and benchmark items (colors)
hold; the stop list and the ranked terms are counted from the titles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import decode_entities, words_space
from quire.operators import groups as G
from quire.operators import lexicon as LT
from quire.operators.ordered import ordered_index, top_k
from quire.plans.common import D, r
from quire.plans.oracle_views import views
from quire.plans.q_flags import LEX_WORDS_SQL
from quire.plans.q_ngrams import TOKENS
from quire.plans.registry import query
from quire.sources.fixtures import title_tokens
from quire.sources.tables import table

LONGEST_PHRASE = 4
TOP_TERMS = 50
STOP_MIN_COUNT = 100


def lexicon_table(spark, sf_dir, source: str):
    """(phrase): clauses of at most LONGEST_PHRASE words of a table's texts."""
    clauses = table(spark, sf_dir, source).select(F.explode(F.split(F.lower("text"), r"[.,\n]")).alias("c"))
    return (clauses.select(F.trim("c").alias("phrase")).where("phrase <> ''")
            .where(F.size(F.split("phrase", " ")) <= LONGEST_PHRASE).distinct())


def lexicons(spark, sf_dir):
    return {"has_brand": lexicon_table(spark, sf_dir, "conversations"),
            "has_color": lexicon_table(spark, sf_dir, "benchmark")}


def _lexicon_sql(source: str) -> str:
    return f"""select distinct phrase from (select trim(unnest(regexp_split_to_array(lower(text), '[.,\\n]')), ' ') as phrase
from {source}) where phrase <> '' and len(string_split(phrase, ' ')) <= {LONGEST_PHRASE}"""


def _flags_sql(text: str) -> str:
    words = f"list_filter({LEX_WORDS_SQL}, lambda w: w <> '')"
    return views("d") + f""", w as (select sku_id, {words.replace('title', text)} as ws from d),
g as (select distinct sku_id, array_to_string(ws[i:i + n - 1], ' ') as phrase
  from (select sku_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i
        from w, (values {', '.join(f'({n})' for n in range(1, LONGEST_PHRASE + 1))}) k(n) where len(ws) >= n)),
brand as (select distinct array_to_string({words.replace('title', 'phrase')}, ' ') as phrase from ({_lexicon_sql('conversations')})),
color as (select distinct array_to_string({words.replace('title', 'phrase')}, ' ') as phrase from ({_lexicon_sql('benchmark')}))
select sku_id, cast(sku_id in (select sku_id from g join brand using (phrase) where phrase <> '') as int) as has_brand,
  cast(sku_id in (select sku_id from g join color using (phrase) where phrase <> '') as int) as has_color from d"""


@query("f8_lexicon_hit_table", oracle=_flags_sql("title"))
def f8_lexicon_hit_table(spark, sf_dir):
    """Brand and color phrases of one to four words in the title."""
    return LT.lexicon_flags(D(spark, sf_dir), "sku_id", "title", lexicons(spark, sf_dir))


@query("f8_lexicon_hit_table_description", oracle=_flags_sql("short_description"))
def f8_lexicon_hit_table_description(spark, sf_dir):
    """Brand and color phrases of one to four words in the description."""
    return LT.lexicon_flags(D(spark, sf_dir), "sku_id", "short_description", lexicons(spark, sf_dir))


@query("f10_ranked_term_flags_table", oracle=views("tt") + f""",
ranked as (select word, row_number() over (order by count(*) desc, word) - 1 as rank from tt group by word
           order by rank limit {TOP_TERMS})
select sku_id, {', '.join(f"coalesce(cast(contains(lower(title), (select word from ranked where rank = {i})) as int), 0) as has_{i}"
                          for i in range(TOP_TERMS))} from d""")
def f10_ranked_term_flags_table(spark, sf_dir):
    """One flag for each of the first 50 terms of a ranked term table (the
    commonest title words), substring of the lower title."""
    counts = G.value_counts(title_tokens(spark, sf_dir), "word", "n")
    first = top_k(counts, [F.col("n").desc(), F.col("word").asc()], TOP_TERMS)
    ranked = ordered_index(first, [F.col("n").desc(), F.col("word").asc()], "rank").withColumnRenamed("word", "term")
    return LT.ranked_term_flags(D(spark, sf_dir).select("sku_id", "title"), "title", ranked, TOP_TERMS).drop("title")


@query("n7_lexicon_tfidf_description", oracle=views("d") + f"""
, one as ({_lexicon_sql('benchmark')}),
lex as (select phrase from one union all select replace(phrase, ' ', '') from one where contains(phrase, ' ')),
lt as (select rid, unnest(list_distinct({TOKENS.format('phrase')})) as term
       from (select phrase, row_number() over (order by phrase) as rid from lex)),
nl as (select cast(count(*) as double) as n from lex),
idf as (select term, ln((1 + (select n from nl)) / (1 + cast(count(*) as double))) + 1 as idf from lt group by term),
tc as (select sku_id, term, count(*) as tf from (
         select sku_id, unnest({TOKENS.format("lower(replace(replace(short_description, '(', ' ('), ')', ' )'))")}) as term
         from d) group by sku_id, term),
w as (select sku_id, term, tf * idf as w from tc join idf using (term))
select sku_id, term, round(w / sqrt(sum(w * w) over (partition by sku_id)), 6) as weight from w""")
def n7_lexicon_tfidf_description(spark, sf_dir):
    """TF-IDF of the description's words, vocabulary and idf fitted on the
    color phrases and their joined forms."""
    lexicon = LT.joined_forms(lexicon_table(spark, sf_dir, "benchmark"))
    w = LT.lexicon_tfidf(D(spark, sf_dir), "sku_id", "short_description", lexicon)
    return w.select("sku_id", "term", r("weight").alias("weight"))


@query("a20_stop_word_count_table", oracle=views("tt") + f""",
stops as (select word from tt group by word having count(*) >= {STOP_MIN_COUNT}),
w as (select sku_id, unnest(string_split(replace(replace(short_description, '&amp;', '&'), '&nbsp;', ' '), ' ')) as word from d)
select sku_id, cast(count(*) filter (word in (select word from stops)) as bigint) as stopwords_count,
  count(*) filter (word in (select word from stops)) / count(*) as stopwords_ratio from w group by sku_id""")
def a20_stop_word_count_table(spark, sf_dir):
    """Words of a stop list table (title words that occur 100 times or more)
    among the description's space words, count and ratio."""
    stops = G.value_counts(title_tokens(spark, sf_dir), "word", "n").where(F.col("n") >= STOP_MIN_COUNT)
    return LT.stop_word_counts(D(spark, sf_dir), "sku_id", words_space(decode_entities("short_description")), stops)
