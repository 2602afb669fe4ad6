"""Queries: word-vector and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import tokenise_alpha
from quire.operators import embed as EM
from quire.operators import ngrams as NG
from quire.plans.common import D, V, r
from quire.plans.oracle_views import views
from quire.plans.registry import query

DIM = 64
CONCAT_WORDS = 70
NUM_WORDS = 20000
MAXLEN = 1000

TT_POS = ("tp as (select sku_id, unnest(range(0, len(l))) as pos, unnest(l) as word from ("
          "select sku_id, list_filter(string_split(lower(regexp_replace(title, '[^a-zA-Z]', ' ', 'g')), ' '), "
          "lambda x: x <> '') as l from d))")


def _tokens(spark, sf_dir):
    d = D(spark, sf_dir)
    return d, d.select("sku_id", F.posexplode(tokenise_alpha("title")).alias("pos", "word"))


def _long(vecs, key="sku_id"):
    """(key, dim, value) rows of a vector column, rounded."""
    return vecs.select(key, F.posexplode("vec").alias("dim", "value")).select(
        key, F.col("dim").cast("long"), r("value").alias("value"))


def _agg_sql(fn: str, weight: str = "1.0") -> str:
    return (views("v") + ", " + TT_POS + f""",
hits as (select tp.sku_id, e.i - 1 as dim, cast(e.x as double) * {weight} as x
         from tp join v using (word), unnest(v.vec) with ordinality as e(x, i)),
agg as (select sku_id, dim, {fn}(x) as value from hits group by sku_id, dim)
select d.sku_id, g.dim, round(coalesce(agg.value, 0.0), 6) as value
from d cross join (select unnest(range(0, {DIM})) as dim) g left join agg on agg.sku_id = d.sku_id and agg.dim = g.dim""")


@query("e1_mean_vector", oracle=_agg_sql("avg"))
def e1_mean_vector(spark, sf_dir):
    """Mean vector of the title tokens that have a vector (zeros when none),
    long form (sku_id, dim, value)."""
    d, toks = _tokens(spark, sf_dir)
    vecs = EM.vector_aggregate(EM.token_vectors(toks, V(spark, sf_dir), "sku_id"), "sku_id", "mean")
    return _long(EM.fill_zero_vectors(d.select("sku_id"), vecs, "sku_id", DIM))


@query("e2_sum_vector", oracle=_agg_sql("sum"))
def e2_sum_vector(spark, sf_dir):
    """Sum vector of the title tokens that have a vector."""
    d, toks = _tokens(spark, sf_dir)
    vecs = EM.vector_aggregate(EM.token_vectors(toks, V(spark, sf_dir), "sku_id"), "sku_id", "sum")
    return _long(EM.fill_zero_vectors(d.select("sku_id"), vecs, "sku_id", DIM))


@query("e3_concat_vector", oracle=views("v") + ", " + TT_POS + f"""
select tp.sku_id, cast(tp.pos * {DIM} + e.i - 1 as bigint) as idx, round(cast(e.x as double), 6) as value
from tp join v using (word), unnest(v.vec) with ordinality as e(x, i) where tp.pos < {CONCAT_WORDS}""")
def e3_concat_vector(spark, sf_dir):
    """The vectors of the first 70 tokens side by side, sparse long form
    (sku_id, idx = position * dim + d, value); unknown tokens leave zeros."""
    _, toks = _tokens(spark, sf_dir)
    # values are rounded once for each word, not for each of its tokens
    rounded = V(spark, sf_dir).select("word", F.transform("vec", lambda x: r(x)).alias("vec"))
    tv = EM.token_vectors(toks.where(F.col("pos") < CONCAT_WORDS), rounded, "sku_id")
    return tv.select("sku_id", "pos", F.posexplode("vec").alias("d", "value")).select(
        "sku_id", (F.col("pos") * DIM + F.col("d")).cast("long").alias("idx"), "value")


@query("e4_idf_weighted_mean_vector", oracle=views("v") + ", " + TT_POS + f""",
tc as (select sku_id, word from tp group by sku_id, word),
idf as (select word, ln((1 + (select count(*) from d)) / (1 + cast(count(*) as double))) + 1 as idf from tc group by word),
hits as (select tp.sku_id, e.i - 1 as dim, cast(e.x as double) * idf.idf as x
         from tp join v using (word) join idf using (word), unnest(v.vec) with ordinality as e(x, i)),
agg as (select sku_id, dim, avg(x) as value from hits group by sku_id, dim)
select d.sku_id, g.dim, round(coalesce(agg.value, 0.0), 6) as value
from d cross join (select unnest(range(0, {DIM})) as dim) g left join agg on agg.sku_id = d.sku_id and agg.dim = g.dim""")
def e4_idf_weighted_mean_vector(spark, sf_dir):
    """Mean of idf-weighted vectors of the title tokens (idf over the
    titles' token sets, smooth)."""
    d, toks = _tokens(spark, sf_dir)
    idf = NG.smooth_idf(NG.doc_freq(toks.select("sku_id", F.col("word").alias("term")).distinct()), NG.n_rows(d))
    tv = EM.token_vectors(toks, V(spark, sf_dir), "sku_id").join(
        idf.withColumnRenamed("term", "word"), "word")
    vecs = EM.vector_aggregate(tv, "sku_id", "mean", weight=F.col("idf"))
    return _long(EM.fill_zero_vectors(d.select("sku_id"), vecs, "sku_id", DIM))


SEQ_TOKENS = ("list_filter(string_split(translate(lower(title), '!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), "
              "repeat(' ', 34)), ' '), lambda x: x <> '')")


@query("e5_frequency_vocabulary", oracle=views("d") + f"""
select word, cast(row_number() over (order by count(*) desc, word) as bigint) as index, count(*) as count
from (select unnest({SEQ_TOKENS}) as word from d) group by word
qualify row_number() over (order by count(*) desc, word) < {NUM_WORDS}""")
def e5_frequency_vocabulary(spark, sf_dir):
    """Title words ranked by frequency (index from 1, ties by word), kept
    below num_words = 20000."""
    d = D(spark, sf_dir)
    toks = d.select(F.explode(EM.sequence_tokens("title")).alias("word"))
    return EM.frequency_vocabulary(toks, NUM_WORDS).select("word", "index", "count")


@query("e6_token_sequence_pad", oracle=views("d") + f"""
, voc as (select word, row_number() over (order by count(*) desc, word) as idx
          from (select unnest({SEQ_TOKENS}) as word from d) group by word
          qualify row_number() over (order by count(*) desc, word) < {NUM_WORDS}),
tp as (select sku_id, unnest(range(0, len(l))) as pos, unnest(l) as word from (select sku_id, {SEQ_TOKENS} as l from d)),
seq as (select sku_id, list(idx order by pos) as s from tp join voc using (word) group by sku_id),
full_ as (select d.sku_id, coalesce(s, []) as s from d left join seq using (sku_id))
select sku_id, cast(greatest({MAXLEN} - len(s), 0) as bigint) as n_pad,
  array_to_string(list_concat(list_transform(range(0, greatest({MAXLEN} - len(s), 0)), lambda x: 0),
                              s[greatest(len(s) - {MAXLEN} + 1, 1):]), ',') as seq
from full_""")
def e6_token_sequence_pad(spark, sf_dir):
    """Vocabulary indices of the title words in order, left-padded /
    truncated to 1000 (shown as text plus the pad count)."""
    d = D(spark, sf_dir)
    toks = d.select(F.explode(EM.sequence_tokens("title")).alias("word"))
    voc = EM.frequency_vocabulary(toks, NUM_WORDS)
    seqs = EM.token_sequences(d, "sku_id", "title", voc, MAXLEN)
    return seqs.select("sku_id", F.size(F.filter("seq", lambda x: x == 0)).cast("long").alias("n_pad"),
                       F.array_join("seq", ",").alias("seq"))


@query("e7_embedding_matrix", oracle=views("v") + f"""
, voc as (select word, row_number() over (order by count(*) desc, word) as idx
          from (select unnest({SEQ_TOKENS}) as word from d) group by word
          qualify row_number() over (order by count(*) desc, word) < {NUM_WORDS})
select cast(idx as bigint) as index, voc.word, cast(v.vec is not null as int) as known,
  round(coalesce(cast(v.vec[1] as double), 0.0), 6) as v0, cast(coalesce(len(v.vec), {DIM}) as bigint) as dim
from voc left join v using (word)""")
def e7_embedding_matrix(spark, sf_dir):
    """Vocabulary index -> vector, zeros for words without one (first
    component and dimension shown)."""
    d = D(spark, sf_dir)
    toks = d.select(F.explode(EM.sequence_tokens("title")).alias("word"))
    m = EM.embedding_matrix(EM.frequency_vocabulary(toks, NUM_WORDS), V(spark, sf_dir), DIM)
    return m.select("index", "word", "known", r(F.col("vec")[0]).alias("v0"), F.size("vec").cast("long").alias("dim"))
