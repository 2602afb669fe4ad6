"""N-gram generation and term weighting (N1-N9) in long form.

Terms are produced per row by array expressions (no Python), exploded into
``(key, term)`` and aggregated once into term counts. Document frequencies
are a second aggregation of that table (the shuffle is reused), the idf
table is attached by a size-checked broadcast, and the per-row L2 norm is
a window over one row's terms (bounded by the row's length).

Weights follow the common text-vectoriser definitions:
tf-idf = tf * (ln((1 + N) / (1 + df)) + 1), rows L2-normalised;
BM25 = tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)) * ln((N - df + .5) / (df + .5)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import col
from quire.operators.joins import bounded

# Python's ``\s\s+`` (runs of two or more whitespace characters) used by the
# character analyser to normalise spacing.
WHITESPACE_RUN = r"(?U)[\s\x{1c}-\x{1f}]{2,}"


def char_text(c) -> Column:
    """Lower-case text with whitespace runs replaced by one space."""
    return F.regexp_replace(F.lower(col(c)), WHITESPACE_RUN, " ")


def char_ngrams(c, n_min: int, n_max: int, normalise: bool = True) -> Column:
    """All character n-grams, n in [n_min, n_max].

    One native regex pass per size with an overlapping look-ahead
    ``(?=(.{n}))`` - no lambda, so the normalised text is evaluated once
    per size, never once per n-gram. A text shorter than n yields none."""
    s = char_text(c) if normalise else col(c)
    return F.concat(*[F.regexp_extract_all(s, F.lit("(?s)(?=(.{%d}))" % n), 1) for n in range(n_min, n_max + 1)])


def word_ngrams(tokens: Column, n_min: int, n_max: int) -> Column:
    """Word n-grams (tokens joined by one space), n in [n_min, n_max].

    ``tokens`` should be a column (not an expression): it is referenced
    inside a lambda, where expressions are re-evaluated per element."""
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(tokens)
            continue
        k = F.size(tokens) - n
        parts.append(F.when(k >= 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(0))),
                                                lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))
                     .otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def run_starts(s: Column) -> Column:
    """1-based positions where a sorted array ``s`` (a column) starts a run."""
    n = F.size(s)
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: (n > 0) & ((i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1))))


def runs(s: Column, starts: Column) -> Column:
    """(term, tf) structs from a sorted array and its run starts (columns)."""
    n = F.size(s)
    m = F.size(starts)
    return F.transform(starts, lambda st, k: F.struct(
        F.element_at(s, st).alias("term"),
        (F.when(k + 1 < m, F.element_at(starts, k + 2)).otherwise(n + 1) - st).cast("long").alias("tf")))


def term_counts(df: DataFrame, key: str, terms: Column, unique_key: bool = True) -> DataFrame:
    """(key, term, tf): occurrences of each term in each row.

    With a unique key (one row per key, the listing model) the counting is
    row-local and needs no shuffle: the row's terms are sorted, run starts
    located and run lengths taken (O(n log n) per row). The sorted array
    and the starts are separate projections because lambda bodies are not
    subject to common-subexpression elimination: referencing an
    expression inside a lambda would re-evaluate it per element.
    Without a unique key the exploded terms are aggregated by (key, term)."""
    if unique_key:
        return (df.select(key, F.sort_array(terms).alias("_s"))
                .select(key, "_s", run_starts(F.col("_s")).alias("_st"))
                .select(key, F.explode(runs(F.col("_s"), F.col("_st"))).alias("_e"))
                .select(key, F.col("_e.term").alias("term"), F.col("_e.tf").alias("tf")))
    return (df.select(key, F.explode(terms).alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def doc_freq(tc: DataFrame) -> DataFrame:
    """(term, df): rows containing the term."""
    return tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def n_rows(df: DataFrame) -> Column:
    """Number of rows as a scalar sub-query."""
    return df.select(F.count(F.lit(1))).scalar()


def kept_terms(d: DataFrame, n_docs: Column, min_df=1, max_df=1.0) -> DataFrame:
    """The (term, df) rows within [min_df, max_df]; a float bound is a
    fraction of the rows, an int an absolute count."""
    lo = F.lit(float(min_df)) * n_docs if isinstance(min_df, float) else F.lit(min_df)
    hi = F.lit(float(max_df)) * n_docs if isinstance(max_df, float) else F.lit(max_df)
    return d.where((F.col("df") >= lo) & (F.col("df") <= hi))


def filtered_tfidf(tc: DataFrame, key: str, n_docs: Column, min_df=1, max_df=1.0) -> DataFrame:
    """N3 and N4 in one: weights of the terms that ``df_filter`` keeps. The
    join that attaches the idf drops the others, so that the counts meet a
    table of terms once and are not written between."""
    return tfidf(tc, key, n_docs, idf_table=smooth_idf(kept_terms(doc_freq(tc), n_docs, min_df, max_df), n_docs))


def df_filter(tc: DataFrame, n_docs: Column, min_df=1, max_df=1.0) -> DataFrame:
    """Keep terms whose document frequency is within [min_df, max_df];
    a float bound is a fraction of the rows, an int an absolute count."""
    keep = kept_terms(doc_freq(tc), n_docs, min_df, max_df).select("term")
    return tc.join(bounded(keep), "term", "left_semi")


def l2_normalise(weights: DataFrame, key: str, w: str = "weight") -> DataFrame:
    norm = F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy(key)))
    return weights.withColumn(w, F.col(w) / norm)


def smooth_idf(dfreq: DataFrame, n_docs: Column) -> DataFrame:
    return dfreq.select("term", (F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def tfidf(tc: DataFrame, key: str, n_docs: Column, binary: bool = False,
          idf_table: DataFrame | None = None) -> DataFrame:
    """(key, term, weight) with smooth idf and L2 row norm.

    ``idf_table`` (term, idf) replaces the idf fitted on ``tc`` itself (N7
    fits it on a lexicon)."""
    idf = idf_table if idf_table is not None else smooth_idf(doc_freq(tc), n_docs)
    tf = F.lit(1.0) if binary else F.col("tf").cast("double")
    w = tc.join(bounded(idf), "term").select(key, "term", (tf * F.col("idf")).alias("weight"))
    return l2_normalise(w, key)


def bm25(tc: DataFrame, key: str, n_docs: Column, avg_len: Column, k1: float = 2.0, b: float = 0.75) -> DataFrame:
    """(key, term, weight) Okapi BM25 with document length = the row's
    total term count and ``avg_len`` over all rows."""
    d = doc_freq(tc)
    idf = d.select("term", F.ln((n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))).alias("idf"))
    dl = F.sum("tf").over(Window.partitionBy(key)).cast("double")
    tf = F.col("tf").cast("double")
    sat = tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avg_len))
    return tc.join(bounded(idf), "term").select(key, "term", (sat * F.col("idf")).alias("weight"))
