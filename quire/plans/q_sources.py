"""Queries: sources and sinks (S1-S8, S10, S11). Each writes data derived
from the driver tables to the shared output folder and reads it back with
the operator under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import ngrams as NG
from quire.operators.groups import value_counts
from quire.operators.ordered import ordered_index, top_k
from quire.operators.stack import output_folder
from quire.plans.common import C, D, P, V, r
from quire.plans.oracle_views import views
from quire.plans.registry import query
from quire.sources import io as IO



@query("s1_read_listings", oracle=views("c") + """
select country, sku_id, title, category_lvl_1, category_lvl_2, category_lvl_3, price, product_type,
  case when length(sku_id) % 3 = 0 then '' when length(sku_id) % 3 = 1 then null
       else '  "' || title || '",' || chr(10) || ' two lines ' end as short_description from c""")
def s1_read_listings(spark, sf_dir):
    """Catalog listings written as header-less 9-column CSV and read back
    with the fixed schema; descriptions are null, empty, or hold quotes,
    commas, a line break and spaces at both ends."""
    path = output_folder(spark, "listings-csv")
    size = F.length("sku_id") % 3
    odd = F.concat(F.lit('  "'), "title", F.lit('",\n two lines '))
    IO.write_listings_csv(C(spark, sf_dir).withColumn(
        "short_description", F.when(size == 0, "").when(size == 2, odd)), path)
    return IO.read_listings(spark, path)


@query("s2_read_labels", oracle=views("d") + """
select sku_id, conciseness, clarity from d where conciseness is not null""")
def s2_read_labels(spark, sf_dir):
    """A keyed label table written to Parquet, read and joined by key."""
    path = output_folder(spark, "labels")
    d = D(spark, sf_dir)
    d.where(F.col("conciseness").isNotNull()).select("sku_id", "conciseness", "clarity").write.parquet(path)
    labels = IO.read_labels(spark, path)
    return d.select("sku_id").join(labels, "sku_id")


@query("s3_read_lexicon", oracle=views("tt") + """
select distinct trim(lower(word)) as phrase from tt where word in (select word from tt group by word having count(*) >= 5)""")
def s3_read_lexicon(spark, sf_dir):
    """A lexicon file (one phrase per line, derived from frequent title
    tokens, with mixed case and padding) read back stripped and lower-cased."""
    from quire.sources.fixtures import title_tokens
    words = value_counts(title_tokens(spark, sf_dir), "word", "n").where(F.col("n") >= 5)
    path = output_folder(spark, "lexicon")
    IO.write_lines(words.select(F.concat(F.lit("  "), F.upper("word"), F.lit(" ")).alias("w")), "w", path)
    return IO.read_lexicon(spark, path)


@query("s4_read_ranked_terms", oracle=views("tt") + """
select word as term from (select word, count(*) as n from tt group by word order by n desc, word limit 50)""")
def s4_read_ranked_terms(spark, sf_dir):
    """The 50 most frequent title tokens written as a fixed-width ranked
    list (index, weight, term from column 17) and parsed back."""
    from quire.sources.fixtures import title_tokens
    top = top_k(value_counts(title_tokens(spark, sf_dir), "word", "n"), [F.col("n").desc(), F.col("word")], 50)
    ranked = ordered_index(top, [F.col("n").desc(), F.col("word")], "idx")
    path = output_folder(spark, "ranked")
    IO.write_lines(IO.format_ranked_terms(ranked.withColumn("w", F.col("n") / 1000.0), "idx", "w", "word"),
                   "value", path)
    return IO.read_ranked_terms(spark, path)


@query("s5_read_word_vectors", oracle=views("v") + """
select word, cast(len(vec) as bigint) as dim, round(cast(vec[1] as double), 6) as v0,
       round(cast(vec[64] as double), 6) as v63 from v""")
def s5_read_word_vectors(spark, sf_dir):
    """The word-vector table written as 'word f1 ... fd' text and parsed."""
    path = output_folder(spark, "vectors")
    IO.write_lines(IO.format_word_vectors(V(spark, sf_dir)), "value", path)
    v = IO.read_word_vectors(spark, path)
    return v.select("word", F.size("vec").cast("long").alias("dim"), r(F.col("vec")[0]).alias("v0"),
                    r(F.col("vec")[63]).alias("v63"))


@query("s6_read_sparse_block", oracle=views("d") + """
, tc as (select sku_id, term, count(*) as tf from (select sku_id, unnest(regexp_extract_all(lower(title),
         '[\\p{L}\\p{Mn}\\p{Nd}_]{2,}')) as term from d) group by sku_id, term),
voc as (select term, row_number() over (order by term) - 1 as idx from (select distinct term from tc))
select sku_id, cast(count(*) as bigint) as nnz, cast(min(idx) as bigint) as first_index, cast(sum(tf) as bigint) as total
from tc join voc using (term) group by sku_id""")
def s6_read_sparse_block(spark, sf_dir):
    """Title word counts stored as a long-form sparse block (key, index,
    value) in Parquet and read back as per-row index / value arrays."""
    from quire.functions.text import tokenise_words
    d = D(spark, sf_dir)
    tc = NG.term_counts(d, "sku_id", tokenise_words("title"))
    voc = ordered_index(tc.select("term").distinct(), [F.col("term")], "index")
    path = output_folder(spark, "sparse")
    IO.write_sparse_block(tc.join(voc, "term").select("sku_id", "index", F.col("tf").alias("value")), path)
    blk = IO.read_sparse_block(spark, path)
    return blk.select("sku_id", F.size("indices").cast("long").alias("nnz"),
                      F.get("indices", 0).cast("long").alias("first_index"),
                      F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("s7_write_ids", oracle=views("c") + "select sku_id from c")
def s7_write_ids(spark, sf_dir):
    """The listing keys written as a header-less CSV and read back."""
    path = output_folder(spark, "ids")
    IO.write_ids(C(spark, sf_dir), path)
    return spark.read.schema("sku_id string").csv(path)


@query("s8_write_feature_block", oracle=views("d") + """
select sku_id, split, cast(length(title) as double) as title_len from d""")
def s8_write_feature_block(spark, sf_dir):
    """A feature block written partitioned by train / test and read back."""
    path = output_folder(spark, "block")
    d = D(spark, sf_dir).select("sku_id", "split", F.length("title").cast("double").alias("title_len"))
    IO.write_feature_block(d, path)
    return spark.read.parquet(path).select("sku_id", "split", "title_len")


@query("s10_write_submission", oracle=views("p") + """
select sku_id, cast(round(avg(pred), 6) as varchar) as pred from p group by sku_id""")
def s10_write_submission(spark, sf_dir):
    """Averaged scores written with their keys, in key order, without header
    and read back as text."""
    from quire.operators.metrics import average_sets
    avg = average_sets(P(spark, sf_dir), "sku_id").select("sku_id", r("pred").cast("string").alias("pred"))
    path = output_folder(spark, "submission")
    IO.write_submission(avg, path)
    return spark.read.schema("sku_id string, pred string").csv(path)


@query("s11_export_corpus_text", oracle=views("d") + """
select 0 as part, replace(replace(title, '(', ' ( '), ')', ' ) ') as text from d
union all
select 1, regexp_replace(replace(replace(coalesce(short_description, 'NA'), '(', ' ( '), ')', ' ) '), '<[^<]+?>', '', 'g')
from d""")
def s11_export_corpus_text(spark, sf_dir):
    """Titles then descriptions exported as text records (a record
    separator keeps multi-line descriptions whole) and read back."""
    recs = IO.corpus_records(D(spark, sf_dir))
    path = output_folder(spark, "corpus")
    for part in (0, 1):
        IO.write_lines(recs.where(F.col("part") == part), "text", f"{path}/part={part}", IO.RECORD_SEP)
    back = IO.read_lines(spark, path, IO.RECORD_SEP)
    return back.select(F.col("part").cast("int"), F.col("value").alias("text"))


