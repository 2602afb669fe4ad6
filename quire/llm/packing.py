"""Operator 4, packing: non-negative least squares over length combinations.

Documents are tokenised once and cut into whole windows and a remainder. A
histogram counts the pieces by length. Shallow combinations of lengths that
fill a window exactly are enumerated, non-negative least squares finds how
often to repeat each, the repeats are rounded down, and what is left is
packed greedily, largest pieces first. The plan works on the histogram, so
its size depends on the window alone; pieces find their place by their rank
among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lists, quoted, ready, slices, written

WINDOW = 1024
#: Middle lengths of three-piece combinations are multiples of this.
GRID = 32
SWEEPS = 30
# Fixed value: how the byte-level pre-tokeniser cuts a text.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_names() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible
    Latin-1 characters are themselves, the other bytes follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str, added_tokens: bool = False):
    """A function from texts to arrays of token ids.

    The file is read by tokenizers. If it is a byte-level BPE whose ids follow
    the order of its merges, tiktoken runs the same merges, several times
    faster; any other file is run by tokenizers. With ``added_tokens`` the
    strings of the file's added tokens get their ids, as tokenizers does on
    its own: texts are cut at them, the longest first, and tiktoken runs on
    what lies between. Otherwise special tokens' strings are ordinary text."""
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = not added_tokens
    form = json.loads(model.to_str())
    bpe, cut = form["model"], form["pre_tokenizer"] or {}
    merged = [bpe["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in bpe.get("merges", ())]
    plain = (bpe["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not form["normalizer"]
             and not cut.get("add_prefix_space") and merged == sorted(set(merged), key=lambda x: (x is None, x)))
    added = {t["content"]: t["id"] for t in form["added_tokens"] if t["content"]}
    if added_tokens and any(t[k] for t in form["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        plain = False
    if not plain:
        return lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4")
    names = byte_names()
    ranks = {bytes(names[c] for c in token): i for token, i in bpe["vocab"].items() if all(c in names for c in token)}
    special = {t["content"].encode() for t in form["added_tokens"]}
    ranks = {token: i for token, i in ranks.items() if token not in special}
    fast = tiktoken.Encoding("merges", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def between(text: str) -> np.ndarray:
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    if not (added_tokens and added):
        return between
    cuts = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

    def whole(text: str) -> np.ndarray:
        parts = cuts.split(text)
        if len(parts) == 1:
            return between(text)
        return np.concatenate([np.array([added[p]], "<u4") if i % 2 else between(p) for i, p in enumerate(parts)])

    return whole


def _pieces(path: str, end_id: int, window: int, with_ids: bool, added_tokens: bool):
    def run(batches):
        encode, task = encoder(path, added_tokens), TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, np.int64)
        for b in slices(batches):
            rows, cols, ids = [], [[] for _ in range(5)], []
            for i, text in enumerate(b.column("text").to_pylist()):
                got = np.append(encode(text or ""), np.array([end_id], "<u4"))
                for start in range(0, len(got), window):
                    own = got[start:start + window]
                    rows.append(i)
                    for c, v in zip(cols, (start, len(own), zlib.crc32(own), len(got), ranks[len(own)])):
                        c.append(v)
                    ranks[len(own)] += 1
                    if with_ids:
                        ids.append(own)
            out = [b.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols),
                   pa.array([task] * len(rows), pa.int32())]
            out += [lists(ids, pa.int64())] if with_ids else []
            yield pa.RecordBatch.from_arrays(out, names[: len(out)])

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task", "ids"]
    return run


def combinations_of(window: int, grid: int = GRID) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths that sum to the window; the
    middle one of three is on a grid, so every length is in some of each."""
    out = [(window,)] + [(a, window - a) for a in range(1, window // 2 + 1)]
    seen = set()
    for middle in range(grid, window, grid):
        for a in range(1, window - middle):
            seen.add(tuple(sorted((a, middle, window - middle - a))))
    return out + sorted(seen)


def repeats_of(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by projected coordinate descent: how often
    to repeat each combination so that the lengths used come nearest to the
    histogram. Starting at zero, most repeats stay there."""
    left = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    norms = []
    for c in combos:
        norms.append(sum(c.count(v) ** 2 for v in set(c)))
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(combos):
            step = sum(left[v] for v in c) / norms[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for v in c:
                    left[v] -= step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.array(x)


def greedy(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that use up the pieces left: the longest, then again and
    again the longest that still fits, repeated while all its lengths last."""
    counts = {v: n for v, n in counts.items() if n}
    lengths, out = sorted(counts), []
    while lengths:
        used: dict[int, int] = {}
        room, pattern = window, []
        at = len(lengths)
        while (at := bisect_right(lengths, room, hi=at)):
            v = lengths[at - 1]
            if used.get(v, 0) < counts[v]:
                used[v] = used.get(v, 0) + 1
                pattern.append(v)
                room -= v
            else:
                at -= 1
        times = min(counts[v] // n for v, n in used.items())
        out.append((tuple(pattern), times))
        for v, n in used.items():
            counts[v] -= n * times
            if not counts[v]:
                lengths.remove(v)
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that hold every piece exactly once."""
    have = np.zeros(window + 1, np.int64)
    for v, n in histogram.items():
        have[v] = n
    combos = combinations_of(window)
    out, left = [], have.copy()
    for c, n in zip(combos, np.floor(repeats_of(combos, have) + 1e-6).astype(np.int64).tolist()):
        n = min(n, *(int(left[v]) // c.count(v) for v in c)) if n else 0
        if n:
            out.append((c, n))
            for v in c:
                left[v] -= n
    return out + greedy({v: int(n) for v, n in enumerate(left)}, window)


def runs_of(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first sequence, offset) of every slot of
    every pattern: the pieces of a length with these ranks, in turn, go to
    the sequences from the first one on, at this offset."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for v in pattern:
            at = taken.get(v, 0)
            out.append((v, at, at + times, sequence, offset))
            taken[v] = at + times
            offset += v
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
         window: int = WINDOW, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ``ids`` (array of long) if asked for.

    ``tokenizer`` is the path of a tokenizers file that every executor can
    read; ``added_tokens`` gives the strings of its added tokens their ids, as
    tokenizers does by default. A null or empty text is the end id alone. Repeated rows are packed
    each; a null id is carried as it is. An empty table gives no piece."""
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, task int"
    pieces = written(source.mapInArrow(_pieces(tokenizer, end_id, window, with_ids, added_tokens),
                                       schema + (", ids array<long>" if with_ids else "")), "pieces")
    # a piece's rank among those of its length: its place within the writing task, after all earlier tasks
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.withColumn("before", F.coalesce(before, F.lit(0))), "length-counts")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(runs_of(plan(histogram, window)) if histogram else [],
                                 "length long, low long, high long, sequence long, offset long")
    ranked = (pieces.join(offsets.drop("n"), ["length", "task"])
              .withColumn("rank", F.col("nth") + F.col("before")))
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("low"))
                         & (F.col("rank") < F.col("high")))
    return placed.select(F.col("id").alias("doc_id"), "start", ranked["length"].alias("length"), "ids_crc32", "doc_tokens",
                         (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
                         *(["ids"] if with_ids else []))
