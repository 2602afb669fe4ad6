"""Bounded samples of labelled rows for the fitted operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, quoted


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, size): the hash and the bytes of each text that has some."""
    return docs.select(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("key"),
                       F.octet_length(quoted(text)).alias("size")).filter("size > 0")


def learnable(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(id, key, size, label) of the labelled rows that aren't held out. A row
    with several labels has the largest; null labels count as none."""
    known = (labels.select(quoted(doc_id).alias("id"), quoted(label).alias("label"))
             .filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    return keyed(docs, doc_id, text).filter(~held_out(F.col("id"))).join(known, "id")


def sample_texts(docs: DataFrame, candidates: DataFrame, doc_id: str, text: str, rows: int, max_bytes: int) -> list[str]:
    """At most ``rows`` different texts among the ``candidates`` (id, key,
    size), together at most ``max_bytes`` long, in the order of their hash.
    Only ids and hashes are shuffled; the texts picked are read by their ids."""
    picked = (candidates.groupBy("key").agg(F.min("id").alias("id"), F.min("size").alias("size"))
              .orderBy("key").limit(rows).collect())
    wanted, total = [], 0
    for r in picked:
        if total + r["size"] <= max_bytes:
            total += r["size"]
            wanted.append((r["key"], r["id"]))
    if not wanted:
        return []
    wanted_rows = docs.sparkSession.createDataFrame(
        wanted, "key long, id " + candidates.select("id").schema["id"].dataType.simpleString())
    found = docs.select(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("key"), quoted(text).alias("text"))
    got = {r["key"]: r["text"] for r in found.join(F.broadcast(wanted_rows), ["id", "key"]).collect()}
    return [got[k] for k, _ in wanted if k in got]
