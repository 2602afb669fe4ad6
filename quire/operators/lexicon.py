"""Lexicons as tables: phrases of several words, stop lists, ranked terms
(F8, F10, N7, A20 for lexicons of any size).

A phrase index holds every phrase of every lexicon once, by its first word
and its number of words. A text's words meet the first words; only windows
that begin a phrase of some length are put together and looked up. Both
lookups are joins that broadcast after measuring, so thousands of phrases
cost one scan of the texts, and millions a shuffle. Flags need no place: single
words, which are few and flag most rows, are looked up first, and only rows
with a flag still open are searched for longer phrases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.flags import lexicon_words
from quire.functions.text import col, tokenise_words
from quire.operators import ngrams as NG
from quire.operators.joins import bounded, fits_broadcast, materialize, max_broadcast_rows, side


def phrase_words(c) -> Column:
    """The words that phrases are matched by: space words in lower case,
    without brackets, stripped, none of them empty."""
    return F.filter(lexicon_words(c), lambda w: w != "")


def phrase_index(lexicons: dict[str, DataFrame]) -> DataFrame:
    """(first, n_words, phrase, names): every phrase of the lexicons, each a
    table with a column ``phrase``, once, with the names of its lexicons. Null
    and blank phrases are left out."""
    tagged = None
    for name, table in lexicons.items():
        part = table.select(phrase_words("phrase").alias("w"), F.lit(name).alias("name"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (tagged.where(F.size("w") > 0)
            .groupBy(F.array_join("w", " ").alias("phrase"), F.get("w", F.lit(0)).alias("first"),
                     F.size("w").alias("n_words"))
            .agg(F.collect_set("name").alias("names")))


def phrase_hits(df: DataFrame, key: str, words: Column, lexicons: dict[str, DataFrame]) -> DataFrame:
    """(key, at, phrase, names): every place, counted from 0, where a phrase
    begins among the row's words, overlaps included. Each row also has one
    row with nulls, so that it isn't lost to an aggregate by key."""
    index = materialize(phrase_index(lexicons), "phrases")
    found = index_hits(df.select(key, words.alias("_w")), key, index)
    # places without a phrase stay out of the joins: as null keys a shuffle would send them all to one task
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("at", "phrase", "names")]
    return found.unionByName(df.select(key, *none))


def index_hits(rows: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """(key, at, phrase, names): every place in the words ``_w`` of a row
    where a phrase of the written index begins."""
    small = fits_broadcast(index)
    longest = index.agg(F.max("n_words")).first()[0] or 1
    # distinct lengths, not phrases: a common first word multiplies a place
    # by the number of phrase lengths at most
    firsts = side(index.groupBy("first").agg(F.collect_set("n_words").alias("lengths")), small)
    known = side(index.select("phrase", "names"), small)
    windows = rows.select(key, F.explode(F.transform(
        "_w", lambda w, i: F.struct(i.alias("at"), w.alias("first"), F.slice("_w", i + 1, longest).alias("win")))).alias("_s"))
    tried = (windows.select(key, F.col("_s.at").alias("at"), F.col("_s.first").alias("first"), F.col("_s.win").alias("win"))
             .join(firsts, "first")
             .select(key, "at", "win", F.explode("lengths").alias("n"))
             .where(F.size("win") >= F.col("n"))
             .select(key, "at", F.array_join(F.slice("win", 1, F.col("n")), " ").alias("phrase")))
    return tried.join(known, "phrase").select(key, "at", "phrase", "names")


def lexicon_flags(df: DataFrame, key: str, text, lexicons: dict[str, DataFrame]) -> DataFrame:
    """F8 on lexicon tables: (key, one 0/1 column per lexicon): a phrase of
    the lexicon stands in the text. The flags of a row are combined in the
    task that read it, before the one shuffle by key. Null texts get 0."""
    index = materialize(phrase_index(lexicons), "phrases")
    rows = df.select(key, phrase_words(text).alias("_w"))

    def flags(hits: DataFrame) -> DataFrame:
        return hits.groupBy(key).agg(*[F.max(F.array_contains("names", name).cast("int")).alias(name) for name in lexicons])

    def combined(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.max(name).alias(name) for name in lexicons])
    single = bounded(index.where("n_words = 1").select(F.col("first").alias("word"), "names"), cheap=True)
    words = rows.select(key, F.explode(F.array_distinct("_w")).alias("word"))
    none = df.select(key, *[F.lit(0).alias(name) for name in lexicons])
    by_word = materialize(combined([flags(words.join(single, "word")), none]), "flags")
    still_open = by_word.where(reduce(lambda a, b: a | b, [F.col(name) == 0 for name in lexicons])).select(F.col(key).alias("_open"))
    # so many open rows that they can't be broadcast: all are searched, for a join would shuffle their texts
    if still_open.count() <= max_broadcast_rows(df.sparkSession):
        rows = rows.join(F.broadcast(still_open), F.col(key).eqNullSafe(F.col("_open")), "left_semi")
    return combined([by_word, flags(index_hits(rows, key, materialize(index.where("n_words > 1"), "phrases")))])


def joined_forms(lexicon: DataFrame) -> DataFrame:
    """The phrases, and those of several words once more without spaces."""
    phrase = F.trim("phrase")
    return lexicon.select(F.explode(F.when(F.contains(phrase, F.lit(" ")), F.array(phrase, F.replace(phrase, F.lit(" "))))
                                    .otherwise(F.array(phrase))).alias("phrase"))


def lexicon_tfidf(df: DataFrame, key: str, text, lexicon: DataFrame) -> DataFrame:
    """(key, term, weight): TF-IDF of the text's words with vocabulary and
    idf fitted on the lexicon, every phrase one document."""
    docs = materialize(lexicon.select("phrase").where("phrase is not null"), "lexicon")
    terms = docs.select(F.explode(F.array_distinct(tokenise_words("phrase"))).alias("term"))
    idf = NG.smooth_idf(NG.doc_freq(terms), NG.n_rows(docs))
    spaced = F.lower(F.replace(F.replace(col(text), F.lit("("), F.lit(" (")), F.lit(")"), F.lit(" )")))
    counts = NG.term_counts(df.select(key, spaced.alias("_t")), key, tokenise_words("_t"))
    return NG.tfidf(counts, key, NG.n_rows(docs), idf_table=idf)


def stop_word_counts(df: DataFrame, key: str, words: Column, stops: DataFrame) -> DataFrame:
    """A20 on a stop list table (word): (key, stopwords_count,
    stopwords_ratio). A row without words counts 0 and has no ratio."""
    stops = bounded(stops.select("word").distinct().withColumn("_stop", F.lit(1)))
    n = F.sum(F.coalesce("_stop", F.lit(0)))
    return (df.select(key, F.explode_outer(words).alias("word")).join(stops, "word", "left")
            .groupBy(key).agg(n.alias("stopwords_count"),
                              F.when(F.count("word") > 0, n / F.count("word")).alias("stopwords_ratio")))


def ranked_term_flags(df: DataFrame, text, ranked: DataFrame, k: int, prefix: str = "has_") -> DataFrame:
    """F10 on a table (rank from 0, term): the rows with one 0/1 column for
    each of the first ``k`` terms, whether it stands in the text in lower case.
    The k terms are a scalar of the plan; a missing rank's column is 0."""
    # by rank, with gaps kept: terms[i] is the term of rank i
    terms = (ranked.where((F.col("rank") >= 0) & (F.col("rank") < k))
             .select(F.map_from_entries(F.array_agg(F.struct(F.col("rank").cast("int"), "term")))).scalar())
    low = F.lower(col(text))
    return df.withColumns({f"{prefix}{i}": F.coalesce(F.contains(low, F.try_element_at(terms, F.lit(i))).cast("int"), F.lit(0))
                           for i in range(k)})
