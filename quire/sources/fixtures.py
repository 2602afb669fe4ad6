"""Listing views over the driver tables (fixtures C, D, H, P, V).

Each view is a lazy DataFrame derived from the parquet tables, so its work
grows with them. Joins between the tables are left to Catalyst: the
dimension sides are broadcast only when their scanned size is under
``spark.sql.autoBroadcastJoinThreshold`` (a size known from file metadata).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import tokenise_alpha
from quire.operators.ordered import ordered_index
from quire.sources.tables import table


def catalog_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: one listing per lineitem; nulls in category 3 and product_type."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_extendedprice", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(sup, li.l_suppkey == sup.s_suppkey))
    ship = F.col("l_shipdate")
    day_key = (F.year(ship) * 10000 + F.month(ship) * 100 + F.dayofmonth(ship)).cast("string")
    nk = F.col("s_nationkey") % 3
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    day_key).alias("sku_id"),
        F.when(nk == 0, "sg").when(nk == 1, "my").otherwise("ph").alias("country"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category_lvl_1"),
        F.col("p_brand").alias("category_lvl_2"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("category_lvl_3"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
         .when(F.col("l_returnflag") == "A", F.lit("local"))
         .otherwise(F.lit("international")).alias("product_type"),
    )


def document_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: one listing per document; title = its whole first line."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    # the title is cut before the join, which then carries whole texts only for queries that read them
    docs = docs.withColumn("title", F.substring_index(F.col("text"), "\n", 1))
    d = docs.join(labels, "doc_id", "left")
    return d.select(
        F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.col("lang")).alias("sku_id"),
        F.col("lang").alias("country"),
        "title",
        F.col("lang").alias("category_lvl_1"),
        F.col("source").alias("category_lvl_2"),
        F.concat(F.lit("q "), (F.col("n_chars") % 7).cast("string")).alias("category_lvl_3"),
        F.col("text").alias("short_description"),
        F.col("n_chars").cast("double").alias("price"),
        F.col("quality").alias("conciseness"),
        (F.lit(1) - F.col("toxic")).alias("clarity"),
        F.when(F.col("doc_id") % 5 == 0, "tst").otherwise("trn").alias("split"),
    )


def html_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: one listing per web page; the description is the raw HTML."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("sku_id"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("short_description"),
        F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("country"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("category_lvl_1"),
    )


def conversation_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: one listing per conversation; the description lists its turns as
    ``role : text`` items."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.struct("turn", "role", "text").alias("t"),
        F.concat(F.lit("<li>"), "role", F.lit(" : "), "text", F.lit("</li>")).alias("item"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "item"))).alias("items"))
    return listed.select(F.concat(F.lit("V"), F.col("conv_id").cast("string")).alias("sku_id"),
                         F.concat(F.lit("<ul>"), F.array_join("items.item", ""), F.lit("</ul>")).alias("short_description"))


def predictions(spark: SparkSession, sf_dir: str, models=(1, 2, 3), label: str = "conciseness") -> DataFrame:
    """P: long-form level-1 predictions (sku_id, model, fold, pred) of a label.

    The model dimension is generated per row (``explode``), not joined."""
    a, b, c = {"conciseness": (7, 4, 1), "clarity": (5, 6, 3)}[label]
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    m = F.col("model")
    return (docs.select("*", F.explode(F.array(*[F.lit(x) for x in models])).alias("model"))
            .select(
                F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.col("lang")).alias("sku_id"),
                m.alias("model"),
                (F.col("doc_id") % 10).cast("int").alias("fold"),
                (((F.col("doc_id") * (F.lit(a) + F.lit(b) * m) + F.col("n_chars") * c) % 1000).cast("double")
                 / F.lit(1000.0)).alias("pred")))


def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sku_id, word): letters-only lower tokens of the D title."""
    d = document_listings(spark, sf_dir)
    return d.select("sku_id", F.explode(tokenise_alpha("title")).alias("word"))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: (word, vec) - the title token with frequency rank ``vec_id`` gets
    the embedding of that id (rank over distinct tokens, ties by word)."""
    freq = title_tokens(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_index(freq, [F.col("n").desc(), F.col("word").asc()], name="vec_id")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return ranked.join(emb, "vec_id").select("word", "vec")
