"""A training corpus from the documents table, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, packing, quality_rules, simhash, substring_dedup
from quire.llm.common import quoted, written
from quire.llm.queries import TOKENIZER
from quire.sources.tables import table


#: Size up to which ids are broadcast.
BROADCAST_BYTES = 32 << 20


def _with_text(out: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' columns with the cleaned text, and n_chars to match."""
    size = {"n_chars": F.length("clean_text").cast("long"), "text": F.col("clean_text")}
    return out.select(*[size[c].alias(c) if c in size else quoted(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejected documents go; kept ones lose their frequent lines."""
    return _with_text(quality_rules.quality_rules(docs).filter("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group the document with the smallest id stays, on
    one row if rows repeat it, the first by the text's digest and then by
    the other columns. Rows with a null id are in no group and stay.

    The ids that go are few next to the documents; they are broadcast while
    they take at most BROADCAST_BYTES, else joined by id."""
    found = written(simhash.near_duplicates(docs), "components")
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone-ids")
    small = 16 * gone.count() <= BROADCAST_BYTES
    out = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
    stays = found.filter("doc_id = component_id")
    if not stays.groupBy("doc_id").count().filter("count > 1").isEmpty():
        row = F.struct(*map(quoted, docs.columns))
        first = F.min_by(row, F.struct(F.sha2(F.col("text").cast("binary"), 256), F.to_json(row))).alias("row")
        out = (out.filter("doc_id is not null").groupBy("doc_id").agg(first).select("row.*")
               .union(out.filter("doc_id is null")))
    return out


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: words that repeat passages of earlier documents go."""
    return _with_text(substring_dedup.substring_dedup(docs), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: contaminated documents go."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.filter(~F.col("contaminated")).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, TOKENIZER, added_tokens=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substrings),
          ("benchmark_decontamination", benchmark), ("packing", pack)]

#: Fingerprints and token ids have no SQL form; tests compare run() with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus at ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
