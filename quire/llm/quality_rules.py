"""Operator 5, quality rules: cross-document line frequency.

Each line is lower-cased, its white space collapsed, and hashed. For each
host the distinct documents that hold a line are counted; exact copies of a
document count once, so that a copied article doesn't turn its own lines
into boilerplate. Lines above a host's limit are removed, and documents that
lose most of their words are rejected, as are those that fail two base rules
(too few words, too many words in repeated 8-word windows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import packed, quoted, ready, row_ddl, signed, slices, texts, unpacked, written

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_frequent_words", "kept", "clean_text"]

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line is frequent in a host if more than this share of the host's distinct
#: documents hold it, and more than MIN_DOCS do. Notices that a host repeats lie
#: well above it, the commonest lines of its own texts below.
MAX_SHARE = 0.05
MIN_DOCS = 20
#: A document is depleted if fewer than this percentage of its words is left.
MIN_LEFT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines of a text, and the hash of each normalised line (0 for a
    line without a word)."""
    lines = text.split(b"\n")
    lowered = text.decode().lower().encode().split(b"\n")
    return lines, [xxhash.xxh64_intdigest(b" ".join(w)) or 1 if (w := x.split()) else 0 for x in lowered]


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for j in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[j:j + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    at: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(mixed, twice)).tolist():
        at.setdefault(tuple(ids[i:i + size].tolist()), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for starts in at.values():
        if len(starts) > 1:
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.array(starts) + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def _line_rows(batches):
    """(host, line, document's content) for each distinct line of a row."""
    for b in slices(batches):
        hosts, keys, whole = [], [], []
        for host, text in zip(b.column("host").to_pylist(), texts(b.column("text"))):
            distinct = set(line_keys(text)[1]) - {0}
            hosts += [host] * len(distinct)
            keys += distinct
            whole += [xxhash.xxh64_intdigest(text)] * len(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(signed(keys)), pa.array(signed(whole))],
                                         ["host", "line", "content"])


def frequent_lines(docs: DataFrame, text: str, host: str, max_share: float = MAX_SHARE,
                   min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, lines): for each host the sorted hashes of the lines above its
    limit. At most (lines of a host) / (max_share * its documents) lines
    qualify, about the lines of a document over ``max_share``."""
    source = docs.select(F.coalesce(quoted(host).cast("string"), F.lit("")).alias("host"), quoted(text).alias("text"))
    held = (source.mapInArrow(_line_rows, "host string, line long, content long").distinct()
            .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs))
    sizes = (source.select("host", F.xxhash64("text").alias("content")).distinct()
             .groupBy("host").agg(F.count(F.lit(1)).alias("docs")))
    return (held.join(sizes, "host").filter(F.col("n") > F.col("docs") * F.lit(max_share))
            .groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def _judged(min_words: int, max_repeat: int, min_left: int):
    def run(batches):
        for b in slices(batches):
            out = {k: [] for k in RESULTS}
            for raw, lines in zip(texts(b.column("text")), b.column("lines").to_pylist()):
                words = raw.split()
                n = len(words)
                source, keys = line_keys(raw)
                frequent = set(lines or ())
                spoken = [x for x, k in zip(source, keys) if k]
                if frequent:
                    gone = [(k if k < 1 << 63 else k - (1 << 64)) in frequent for k in keys]
                    removed = sum(len(x.split()) for x, g in zip(source, gone) if g)
                    clean = b"\n".join(x for x, g in zip(source, gone) if not g)
                else:
                    removed, clean = 0, raw
                repeat = repeated_window_words(words)
                failed = n < min_words or 100 * repeat > max_repeat * n
                for k, v in zip(RESULTS, (
                        n, len(raw.translate(None, SPACES).decode()), len(raw) - len(raw.translate(None, SYMBOLS)),
                        len(spoken) - len(set(spoken)), repeat, failed, removed,
                        not failed and 100 * (n - removed) >= min_left * n, clean.decode())):
                    out[k].append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(out[k], t) for k, t in zip(RESULTS, kinds))],
                                             ["row", *RESULTS])
    return run


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = MAX_SHARE,
                  min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT,
                  min_left: int = MIN_LEFT_PERCENT, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` with RESULTS.

    Words are runs of other characters than space and U+0009 to U+000D. A
    null text has no words and fails the base rules; a null host is the host
    "". Repeated rows count once towards a line's documents. An empty table
    gives an empty table. A result replaces an input column of its name.
    The frequent lines are written, measured, and broadcast only if they take
    at most ``broadcast_bytes``; else they are joined by host."""
    ready(docs.sparkSession)
    lines = written(frequent_lines(docs, text, host, max_share, min_docs), "frequent-lines")
    size = lines.agg(F.sum(8 * F.size("lines") + F.octet_length("host") + 32)).first()[0] or 0
    work = packed(docs, text=quoted(text), host=F.coalesce(quoted(host).cast("string"), F.lit("")))
    work = work.join(F.broadcast(lines) if size <= broadcast_bytes else lines, "host", "left")
    row = row_ddl(work)
    kinds = ", ".join(f"{k} {t}" for k, t in zip(RESULTS, ["long"] * 5 + ["boolean", "long", "boolean", "string"]))
    judged = work.select("row", "text", "lines").mapInArrow(
        _judged(min_words, max_repeat, min_left), f"row {row}, {kinds}")
    return unpacked(judged, docs.columns, RESULTS)
