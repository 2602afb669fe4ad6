"""Registered queries of this subpackage: op<N>_<name>, and pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bwt_dedup, chat, html_text
from quire.llm import collocations as phrases
from quire.llm import decontaminate as benchmark
from quire.llm import packing
from quire.llm import quality_classifier, toxicity
from quire.llm import quality_rules as quality
from quire.llm import simhash
from quire.llm import substring_dedup as substrings
from quire.llm import url_filter as urls
from quire.llm import whitening
from quire.sources.tables import table

#: The rules that the url query applies.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return deco


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict of the quality rules."""
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_frequent_words", "kept")


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its SimHash and the component of near copies it is in."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = """
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
doc_words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
item_windows as (
  select distinct item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win, least(13, len(w)) as size
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from item_words where len(w) > 0)),
sizes as (select distinct size from item_windows),
doc_windows as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc_words, sizes where len(w) >= size)),
hits as (select d.doc_id, d.i, d.size, t.item_id from doc_windows d join item_windows t using (win, size)),
covered as (select doc_id, count(*) as n_hit from (
  select distinct doc_id, p from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hits)))
  group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words left join covered using (doc_id) left join found using (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows and the verdict."""
    out = benchmark.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, added_tokens=True)


URL_SQL = """
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
address as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(rule, host, path, verdict) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best as (
  select a.page_id, a.host, a.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from address a left join rules r
    on (a.host = r.host or ends_with(a.host, '.' || r.host)) and starts_with(a.path, r.path)
  group by all)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best
"""


@query(URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with the rule that fits it and the verdict."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", *urls.RESULTS)


SUBSTRING_SQL = """
with doc_words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from doc_words where len(w) >= 13)),
firsts as (select win, min(doc_id) as least from windows group by win),
gone as (select distinct doc_id, p from (
  select doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (win) where least < doc_id)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from doc_words),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n
         from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc_words left join kept using (doc_id)
"""


@query(SUBSTRING_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that repeat passages of earlier ones."""
    out = substrings.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace("clean_text", r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability that it is toxic."""
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *toxicity.RESULTS)


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability that it is of good quality."""
    out = quality_classifier.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                           table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_classifier.RESULTS)


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", *html_text.RESULTS)


CHAT_SQL = """
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as said
  from (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
        from conversations where conv_id is not null)),
prefixes as (select conv_id, nth, string_agg(said, '') over (partition by conv_id order by nth) as p,
                    max(nth) over (partition by conv_id) as n from turns),
whole as (select p, min(conv_id) as conv_id, max(n) as n_turns, count(*) as n_copies from prefixes where nth = n group by p)
select conv_id, n_turns, n_copies, p as rendered
from whole where p not in (select p from prefixes where nth < n)
"""


@query(CHAT_SQL)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the four leading components, whitened."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error",
                      F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")


PHRASE_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (
  select lang, w[i:i + m - 1] as g from (
    select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (select unnest([1, 2, 3, 4]) as m))),
f as (select lang, g, count(*) as a from grams group by lang, g),
cand as (select lang, g, a from f where len(g) > 1 and a >= 30),
cuts as (select lang, g, a, k, g[1:k] as first, g[k + 1:] as rest from (select *, unnest(range(1, len(g))) as k from cand)),
scored as (
  select c.lang, c.g, c.a, k, x.a as l, y.a as r, ((2000000::hugeint * c.a) // (x.a + y.a))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.g = c.first join f y on y.lang = c.lang and y.g = c.rest),
worst as (select *, row_number() over (partition by lang, g order by score, k) as nth from scored),
parts as (
  select lang, a, g[s:s + m - 1] as g from (
    select lang, a, g, m, unnest(range(1, len(g) - m + 2)) as s from cand, (select unnest([2, 3]) as m) where m < len(g))),
longer as (select lang, g, max(a) as most from parts group by lang, g),
held as (
  select w.lang, array_to_string(w.g, ' ') as phrase, w.a, l, r, score
  from worst w left join longer using (lang, g) where nth = 1 and (most is null or 100 * most < 80 * w.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from held)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""


@query(PHRASE_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


BYTES_SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as w from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from t)),
firsts as (select w, min(doc_id) as least from windows group by w),
hits as (select distinct doc_id, i from windows join firsts using (w) where least < doc_id),
steps as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 50, true)::int as fresh from hits),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from steps),
spans as (select doc_id, min(i) as low, max(i) + 50 as high from runs group by doc_id, run),
between_spans as (
  select doc_id, coalesce(lag(high) over (partition by doc_id order by low), 0) as s, low as e from spans
  union all select t.doc_id, coalesce(max(high), 0), any_value(length(h)) // 2 from t left join spans using (doc_id) group by t.doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' order by s) as k
         from between_spans join t using (doc_id) group by doc_id),
sums as (select doc_id, sum(high - low)::bigint as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(k)) as kept_sha256
from t join kept using (doc_id) left join sums using (doc_id)
"""


@query(BYTES_SQL)
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes that repeat strings of earlier ones."""
    out = bwt_dedup.bwt_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
