"""Operator 3, benchmark decontamination with suffix arrays of the training
text.

Every batch of documents is a shard. Its words become numbers, and a suffix
array sorts its suffixes by their first words. All suffixes of the benchmark
items are searched in it together by binary search, one word deeper at a
time, which gives the places of every window; windows that follow each other
on both sides join into the longest verbatim matches with their locations.
A document lies in one shard, so nothing is shuffled.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import packed, quoted, ready, row_ddl, texts, unpacked

WINDOW = 13
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20
#: Text bytes of the benchmark items that are searched in one pass; a larger
#: benchmark is searched in several passes over the same rows of one job.
BLOCK_BYTES = 16 << 20

#: Word bytes: digits, letters in lower case, and all of other characters.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
                   for b in range(256))

RESULTS = ["n_words", "n_hit", "items", "matches", "contaminated"]
MATCHES = "array<struct<item:string,item_start:int,doc_start:int,n_words:int>>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def benchmark_of(items: list[tuple[str | None, bytes]], window: int) -> SimpleNamespace:
    """The items' words as numbers from 1, and every window's start."""
    numbers: dict[bytes, int] = {}
    parts, starts, sizes, owners, names, offsets, at = [], [], [], [], [], [], 0
    for name, text in items:
        words = split_words(text)
        if not words:
            continue
        size = min(window, len(words))
        count = len(words) - size + 1
        parts.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words] + [0], np.int32))
        starts.append(np.arange(at, at + count))
        sizes.append(np.full(count, size))
        owners.append(np.full(count, len(names)))
        names.append(name)
        offsets.append(at)
        at += len(words) + 1
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, starts, sizes, owners)]
    return SimpleNamespace(numbers=numbers, names=names, offsets=np.array(offsets, np.int64), words=joined[0],
                           starts=joined[1], sizes=joined[2], owners=joined[3],
                           least=int(joined[2].min()) if parts else 0, most=int(joined[2].max()) if parts else 0)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` words from there on (prefix
    doubling). Past the end is 0, which is less than any word."""
    rank, reach = words.astype(np.int64), 1
    while reach < depth:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
        reach *= 2
    return np.argsort(rank, kind="stable")


def search(words: np.ndarray, order: np.ndarray, bench: SimpleNamespace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, low, high): the range of the suffix array that starts with
    each window, for the windows that occur."""
    alive = np.arange(len(bench.starts))
    low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(order), np.int64)
    padded = np.append(words, np.zeros(bench.most, words.dtype))
    done = []
    for j in range(bench.most):
        wanted = bench.words[bench.starts[alive] + j]
        bounds = []
        for upper in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + j]
                right = open_ & ((seen <= wanted) if upper else (seen < wanted))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        low, high = bounds
        found = low < high
        full = found & (bench.sizes[alive] == j + 1)
        done.append((alive[full], low[full], high[full]))
        go_on = found & ~full
        alive, low, high = alive[go_on], low[go_on], high[go_on]
        if not len(alive):
            break
    return tuple(np.concatenate(x) for x in zip(*done))


def shard_matches(documents: list[np.ndarray], bench: SimpleNamespace):
    """(document, item, item start, document start, words) of the maximal
    verbatim matches of a shard.

    Suffixes whose next words, as many as the shortest window has, hold one
    that no item has can't match; they stay out of the suffix array."""
    none = (np.zeros(0, np.int64),) * 5
    flat = np.concatenate([x for d in documents for x in (d, [0])]) if documents else np.zeros(0, np.int64)
    gaps = np.flatnonzero(flat == 0)
    if not bench.least or not len(flat):
        return none
    begins = np.append(0, gaps[:-1] + 1)
    long = gaps - begins >= bench.least
    begins, ends = begins[long], gaps[long] + 1
    if not len(begins):
        return none
    sizes = ends - begins
    place = np.repeat(begins - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
    words = flat[place]
    order = suffix_array(words, bench.most)
    windows, low, high = search(words, order, bench)
    if not len(windows):
        return none
    counts = high - low
    at = np.repeat(low - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))
    there, which = place[order[at]], np.repeat(windows, counts)
    start, size = bench.starts[which], bench.sizes[which]
    # windows one further on both sides belong to the same match
    by = np.lexsort((there, there - start))
    there, start, size, which = there[by], start[by], size[by], which[by]
    new = np.ones(len(there), bool)
    new[1:] = (np.diff(there) != 1) | (np.diff(start) != 1) | (bench.owners[which][1:] != bench.owners[which][:-1])
    first = np.flatnonzero(new)
    n_words = size[first] + np.diff(np.append(first, len(there))) - 1
    doc_ends = np.cumsum([len(d) + 1 for d in documents])
    doc = np.searchsorted(doc_ends, there[first], side="right")
    owner = bench.owners[which[first]]
    return doc, owner, start[first] - bench.offsets[owner], there[first] - np.append(0, doc_ends)[doc], n_words


def _marked(block, share: int):
    def run(batches):
        bench = block.value
        number = bench.numbers.get
        for b in batches:
            documents = [np.fromiter((number(w, 0) for w in words), np.int32, len(words))
                         for words in map(split_words, texts(b.column("text")))]
            matches = b.column("matches").to_pylist()
            touched = set()
            for d, item, at, start, n in zip(*(x.tolist() for x in shard_matches(documents, bench))):
                matches[d].append({"item": bench.names[item], "item_start": at, "doc_start": start, "n_words": n})
                touched.add(d)
            n_words, n_hit, items = [], [], []
            for words, own in zip(documents, matches):
                edge = np.zeros(len(words) + 1, np.int64)
                for m in own:
                    edge[m["doc_start"]] += 1
                    edge[m["doc_start"] + m["n_words"]] -= 1
                n_words.append(len(words))
                n_hit.append(int((np.cumsum(edge) > 0).sum()) if own else 0)
                items.append(sorted({m["item"] for m in own if m["item"] is not None}))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array(matches, pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int32()),
                                                       ("doc_start", pa.int32()), ("n_words", pa.int32())]))),
                 pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words)], pa.bool_())],
                ["row", "text", *RESULTS])
    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, share: int = SHARE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with RESULTS: words, words inside any occurrence
    of an item's window, the items that occur (ids as sorted strings), the
    maximal verbatim matches of at least a window with their locations (in
    words), and whether 1 / ``share`` of the words is hit.

    A null or blank text has no words and is clean. An item without words has
    no window; one with fewer words than ``window`` is one window. An item
    with a null id counts towards hits and matches but isn't listed. Repeated
    items are listed once. Empty tables give no hits or no rows. Results
    replace input columns of their names.

    The benchmark goes to the executors in blocks of about ``block_bytes``
    of text; rows pass through one search for each block."""
    spark: SparkSession = docs.sparkSession
    ready(spark)
    source = items.select(quoted(item_id).cast("string").alias("id"), quoted(item_text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    work = packed(docs, text=quoted(text), matches=F.array().cast(MATCHES))
    row = row_ddl(work)
    schema = (f"row {row}, text string, n_words long, n_hit long, items array<string>, "
              f"matches {MATCHES}, contaminated boolean")
    for k in range(blocks):
        own = source.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(benchmark_of([(r["id"], (r["text"] or "").encode()) for r in own], window))
        work = work.select("row", "text", "matches").mapInArrow(_marked(block, share), schema)
    return unpacked(work, docs.columns, RESULTS)
