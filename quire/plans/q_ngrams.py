"""Queries: n-grams and term weights (N1-N8) and per-group top words."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import stem_tokens, tokenise_words
from quire.operators import ngrams as NG
from quire.operators.ordered import top_k_per_group
from quire.plans.common import C, D, r
from quire.plans.oracle_views import views
from quire.plans.registry import query
from quire.sources import lexicons as LX

PYWS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
        r"\x{205f}\x{3000}]")
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Mn}}\\p{{Nd}}_]{{2,}}')"
STOPS = "[" + ", ".join(f"'{w}'" for w in LX.STOP_WORDS) + "]"
STEM = ("list_transform({0}, lambda w: case "
        "when suffix(w, 'ies') and not suffix(w, 'eies') and not suffix(w, 'aies') then left(w, length(w) - 3) || 'y' "
        "when suffix(w, 'es') and not suffix(w, 'aes') and not suffix(w, 'ees') and not suffix(w, 'oes') "
        "then left(w, length(w) - 1) "
        "when suffix(w, 's') and not suffix(w, 'us') and not suffix(w, 'ss') then left(w, length(w) - 1) "
        "else w end)")


def _tfidf_sql(src: str, terms_expr: str) -> str:
    """tf-idf CTEs + final select over (sku_id, term) from ``src``."""
    return f""", tok as (select sku_id, unnest({terms_expr}) as term from {src}),
tc as (select sku_id, term, count(*) as tf from tok group by sku_id, term),
nd as (select cast(count(*) as double) as n from {src}),
idf as (select term, ln((1 + (select n from nd)) / (1 + cast(count(*) as double))) + 1 as idf from tc group by term),
w as (select sku_id, term, tf * idf as w from tc join idf using (term))
select sku_id, term, round(w / sqrt(sum(w * w) over (partition by sku_id)), 6) as weight from w"""


@query("n1_char_ngrams", oracle=views("d") + f"""
, t as (select sku_id, regexp_replace(lower(title), '{PYWS}{{2,}}', ' ', 'g') as s from d),
g as (select sku_id, s, n, unnest(range(1, length(s) - n + 2)) as i from t, (values (1), (2), (3)) v(n)
      where length(s) >= n)
select sku_id, substr(s, i, n) as term, count(*) as count from g group by sku_id, substr(s, i, n)""")
def n1_char_ngrams(spark, sf_dir):
    """Character 1-3-grams of the lower title (whitespace runs -> one
    space), counted per listing."""
    d = D(spark, sf_dir)
    tc = NG.term_counts(d, "sku_id", NG.char_ngrams("title", 1, 3))
    return tc.select("sku_id", "term", F.col("tf").alias("count"))


@query("n2_word_ngrams", oracle=views("d") + f"""
, t as (select sku_id, {TOKENS.format('title')} as tk from d),
g as (select sku_id, unnest(tk) as term from t
      union all
      select sku_id, unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) from t)
select sku_id, term, count(*) as count from g group by sku_id, term""")
def n2_word_ngrams(spark, sf_dir):
    """Word 1-2-grams of the title tokens, counted per listing."""
    d = D(spark, sf_dir).select("sku_id", tokenise_words("title").alias("tk"))
    tc = NG.term_counts(d, "sku_id", NG.word_ngrams(F.col("tk"), 1, 2))
    return tc.select("sku_id", "term", F.col("tf").alias("count"))


MIN_DF = 0.005


@query("n3_term_counts_min_df", oracle=views("d") + f"""
, tc as (select sku_id, term, count(*) as tf from (select sku_id, unnest({TOKENS.format('title')}) as term from d)
         group by sku_id, term),
keep as (select term from tc group by term having count(*) >= {MIN_DF} * (select count(*) from d))
select sku_id, term, tf as count, 1 as present from tc where term in (select term from keep)""")
def n3_term_counts_min_df(spark, sf_dir):
    """Title word counts restricted to words in at least 0.5% of listings,
    with the binary form alongside."""
    d = D(spark, sf_dir)
    tc = NG.df_filter(NG.term_counts(d, "sku_id", tokenise_words("title")), NG.n_rows(d), min_df=MIN_DF)
    return tc.select("sku_id", "term", F.col("tf").alias("count"), F.lit(1).alias("present"))


@query("n4_tfidf", oracle=views("d") + _tfidf_sql("d", TOKENS.format("title")))
def n4_tfidf(spark, sf_dir):
    """TF-IDF of the title words (smooth idf, L2 row norm), long form."""
    d = D(spark, sf_dir)
    w = NG.tfidf(NG.term_counts(d, "sku_id", tokenise_words("title")), "sku_id", NG.n_rows(d))
    return w.select("sku_id", "term", r("weight").alias("weight"))


NO_STOP = f"list_filter({TOKENS.format('title')}, lambda w: not list_contains({STOPS}, w))"


def _no_stop_tokens():
    stops = F.array(*[F.lit(w) for w in LX.STOP_WORDS])
    return F.filter(tokenise_words("title"), lambda w: ~F.array_contains(stops, w))


@query("n5_tfidf_stop_words", oracle=views("d") + _tfidf_sql("d", NO_STOP))
def n5_tfidf_stop_words(spark, sf_dir):
    """TF-IDF of the title words without stop words."""
    d = D(spark, sf_dir)
    w = NG.tfidf(NG.term_counts(d, "sku_id", _no_stop_tokens()), "sku_id", NG.n_rows(d))
    return w.select("sku_id", "term", r("weight").alias("weight"))


@query("n6_tfidf_stemmed", oracle=views("d") + _tfidf_sql("d", STEM.format(TOKENS.format("title"))))
def n6_tfidf_stemmed(spark, sf_dir):
    """TF-IDF of the S-stemmed title words."""
    d = D(spark, sf_dir)
    w = NG.tfidf(NG.term_counts(d, "sku_id", stem_tokens(tokenise_words("title"))), "sku_id", NG.n_rows(d))
    return w.select("sku_id", "term", r("weight").alias("weight"))


def lexicon_phrases() -> list[str]:
    """Lexicon documents: every phrase, plus multi-word phrases with the
    spaces removed."""
    phrases = [p.strip() for p in LX.COLORS + LX.BRANDS]
    return phrases + [p.replace(" ", "") for p in phrases if len(p.split()) > 1]


BRACKET_LOWER = "lower(replace(replace(title, '(', ' ('), ')', ' )'))"


@query("n7_lexicon_tfidf", oracle=views("c") + f"""
, lex(phrase) as (values {', '.join(f"('{p}')" for p in lexicon_phrases())}),
lt as (select distinct phrase, unnest({TOKENS.format('phrase')}) as term from lex),
nl as (select cast(count(*) as double) as n from lex),
idf as (select term, ln((1 + (select n from nl)) / (1 + cast(count(*) as double))) + 1 as idf from lt group by term),
tc as (select sku_id, term, count(*) as tf from (select sku_id, unnest({TOKENS.format(BRACKET_LOWER)}) as term from c)
       group by sku_id, term),
w as (select sku_id, term, tf * idf as w from tc join idf using (term))
select sku_id, term, round(w / sqrt(sum(w * w) over (partition by sku_id)), 6) as weight from w""")
def n7_lexicon_tfidf(spark, sf_dir):
    """TF-IDF whose vocabulary and idf are fitted on a lexicon (each phrase
    one document), applied to the catalog titles."""
    lex = spark.createDataFrame([(p,) for p in lexicon_phrases()], "phrase string")
    lt = lex.select("phrase", F.explode(F.array_distinct(tokenise_words("phrase"))).alias("term"))
    idf = NG.smooth_idf(NG.doc_freq(lt.withColumnRenamed("phrase", "_doc")), NG.n_rows(lex))
    c = C(spark, sf_dir).withColumn("t", F.lower(F.replace(F.replace("title", F.lit("("), F.lit(" (")),
                                                            F.lit(")"), F.lit(" )"))))
    tc = NG.term_counts(c, "sku_id", tokenise_words("t"))
    w = NG.tfidf(tc, "sku_id", NG.n_rows(c), idf_table=idf)
    return w.select("sku_id", "term", r("weight").alias("weight"))


@query("n8_bm25", oracle=views("d") + f"""
, t as (select sku_id, {TOKENS.format('title')} as tk from d),
tc as (select sku_id, term, count(*) as tf from (select sku_id, unnest(tk) as term from t) group by sku_id, term),
nd as (select cast(count(*) as double) as n, avg(len(tk)) as avgdl from t),
idf as (select term, ln(((select n from nd) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tc group by term),
dl as (select sku_id, cast(sum(tf) as double) as dl from tc group by sku_id)
select sku_id, term, round(tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * dl / (select avgdl from nd))) * idf, 6) as weight
from tc join idf using (term) join dl using (sku_id)""")
def n8_bm25(spark, sf_dir):
    """Okapi BM25 (k1 = 2, b = 0.75) of the title words."""
    d = D(spark, sf_dir).withColumn("tk", tokenise_words("title"))
    avg_len = d.select(F.avg(F.size("tk")).cast("double")).scalar()
    w = NG.bm25(NG.term_counts(d, "sku_id", F.col("tk")), "sku_id", NG.n_rows(d), avg_len)
    return w.select("sku_id", "term", r("weight").alias("weight"))


TOP_WORDS = 10


@query("w6_top_words", oracle=views("d") + _tfidf_sql("d", NO_STOP).replace(
    "select sku_id, term, round(w / sqrt(sum(w * w) over (partition by sku_id)), 6) as weight from w",
    f""", nw as (select sku_id, term, w / sqrt(sum(w * w) over (partition by sku_id)) as weight from w),
m as (select category_lvl_1, term, max(weight) as weight from nw join d using (sku_id) group by category_lvl_1, term)
select category_lvl_1, term, round(weight, 6) as weight, rank from (
  select *, row_number() over (partition by category_lvl_1 order by round(weight, 6) desc, term) as rank from m)
where rank <= {TOP_WORDS}"""))
def w6_top_words(spark, sf_dir):
    """Per category, the 10 terms with the largest TF-IDF weight in any of
    its listings (stop words removed). The per-group ranking keeps at most
    k rows per group before the shuffle (window group limit)."""
    d = D(spark, sf_dir)
    w = NG.tfidf(NG.term_counts(d, "sku_id", _no_stop_tokens()), "sku_id", NG.n_rows(d))
    m = (w.join(d.select("sku_id", "category_lvl_1"), "sku_id")
         .groupBy("category_lvl_1", "term").agg(r(F.max("weight")).alias("weight")))
    top = top_k_per_group(m, "category_lvl_1", [F.col("weight").desc(), F.col("term")], TOP_WORDS)
    return top.select("category_lvl_1", "term", "weight", F.col("rank").cast("long"))
