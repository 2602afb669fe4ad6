"""Word-vector and token-sequence operators.

Token vectors are looked up with a join of (key, token) rows to the vector
table (size-checked broadcast). Per-row vector means and sums use the ML
``Summarizer`` aggregate over ``array_to_vector`` columns: a JVM aggregate
with partial aggregation, so a row's vectors are never exploded into one
row per dimension.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import bounded, materialize, max_broadcast_bytes, max_broadcast_rows, measure
from quire.operators.ordered import ordered_index

# Token characters removed by the sequence tokenizer (replaced by a space).
SEQ_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


#: Most slices of a vector table, each of which is broadcast.
MAX_SLICES = 16


def token_vectors(tokens: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, pos, word, vec) for tokens with a vector.

    A vector table over the broadcast bounds is dealt by word into slices that
    are each within them, and the tokens meet one slice after the other: a
    shuffle by word would carry a vector for each token, and once more to its
    key. Beyond MAX_SLICES slices it is a shuffle join."""
    vectors = materialize(vectors)
    spark = tokens.sparkSession
    n, size = measure(vectors)
    rows, most = max_broadcast_rows(spark), max_broadcast_bytes(spark)
    slices = max(-(-n // rows) if rows else n, -(-size // most) if most else n, 1)
    if slices == 1:
        parts = [F.broadcast(vectors)]
    elif slices > MAX_SLICES:
        parts = [vectors]
    else:
        # a quarter more than needed, for slices are not alike
        slices = -(-5 * slices // 4)
        place = F.pmod(F.xxhash64("word"), F.lit(slices))
        parts = [bounded(vectors.where(place == i), cheap=True) for i in range(slices)]
    return reduce(DataFrame.unionByName, [tokens.join(p, "word").select(key, "pos", "word", "vec") for p in parts])


def vector_aggregate(tv: DataFrame, key: str, how: str = "mean", weight: Column | None = None) -> DataFrame:
    """Per-key mean or sum of (optionally weighted) vectors."""
    v = array_to_vector(F.col("vec")) if weight is None else array_to_vector(
        F.transform("vec", lambda x: x.cast("double") * weight))
    agg = Summarizer.mean(v) if how == "mean" else Summarizer.sum(v)
    return tv.groupBy(key).agg(vector_to_array(agg).alias("vec"))


def fill_zero_vectors(rows: DataFrame, vecs: DataFrame, key: str, dim: int) -> DataFrame:
    """Rows without any known token get the zero vector."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return rows.join(vecs, key, "left").withColumn("vec", F.coalesce(F.col("vec"), zeros))


def sequence_tokens(c) -> Column:
    """Sequence tokenizer: lower case, filter characters to spaces, split
    on spaces, drop empties."""
    s = F.translate(F.lower(c if isinstance(c, Column) else F.col(c)), SEQ_FILTERS, " " * len(SEQ_FILTERS))
    return F.filter(F.split(s, " ", -1), lambda w: w != F.lit(""))


def frequency_vocabulary(tokens: DataFrame, num_words: int | None = None) -> DataFrame:
    """E5: (word, index, count): index 1 = most frequent (ties by word);
    with ``num_words`` only indices below it are kept."""
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    voc = ordered_index(counts, [F.col("count").desc(), F.col("word")], "index", start=1)
    return voc.where(F.col("index") < num_words) if num_words else voc


def pad_sequences(seq: Column, maxlen: int) -> Column:
    """Keep the last ``maxlen`` entries and left-pad with zeros."""
    n = F.size(seq)
    tail = F.when(n > maxlen, F.slice(seq, n - maxlen + 1, maxlen)).otherwise(seq)
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(maxlen) - n, F.lit(0))), tail)


def token_sequences(df: DataFrame, key: str, text: str, vocab: DataFrame, maxlen: int) -> DataFrame:
    """(key, seq): vocabulary indices in text order, unknown words
    dropped, padded / truncated at the front to ``maxlen``. The vocabulary
    is bounded by ``num_words``, so it is broadcast."""
    toks = df.select(key, F.posexplode(sequence_tokens(text)).alias("pos", "word"))
    hit = toks.join(bounded(vocab.select("word", "index")), "word")
    seq = (hit.groupBy(key)
           .agg(F.array_sort(F.collect_list(F.struct("pos", "index"))).alias("_s"))
           .select(key, F.transform("_s", lambda x: x["index"]).alias("_seq")))
    out = df.select(key).join(seq, key, "left")
    return out.select(key, pad_sequences(F.coalesce("_seq", F.array().cast("array<long>")), maxlen).alias("seq"))


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(index, word, vec) with zeros for words without a vector."""
    return (vocab.join(bounded(vectors), "word", "left")
            .select("index", "word", (F.col("vec").isNotNull()).cast("int").alias("known"),
                    F.coalesce(F.transform("vec", lambda x: x.cast("double")),
                               F.array_repeat(F.lit(0.0), dim)).alias("vec")))
