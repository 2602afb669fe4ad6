"""Operator 8, substring dedup with suffix automata of reference shards.

The corpus is its own reference, so a shard can't be all of it. Every window
of words is anchored at its least hashed word group (a minimizer), which
depends on the window's words alone. A shard is what documents hold around
one anchor that at least two documents share: equal windows always meet in
one shard, and text that nothing shares is never moved. In a shard, passages
stream in the order of document ids past an online suffix automaton of the
smaller ids' passages; matching statistics of at least a window give the
words to remove, and new passages extend the automaton.

The automata stay where their shards are instead of being broadcast: their
total size has no bound but the corpus. Exact copies are found first, by
digest: they are repeats as a whole, and only the first of them is matched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import quoted, ready, row_ddl, slices, texts, unpacked, written

WINDOW = 13
#: Words of an anchor.
GROUP = 7
#: An anchor in more documents than this is split by whole windows.
HOT_DOCS = 4096
#: Passages that a task remembers in order to answer copies on the spot.
REMEMBERED = 200_000
RESULTS = ["n_words", "n_removed", "removed", "clean_text"]


#: A number for each byte (0 for white space) and for each place in a word.
_BYTES = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a text, in whole-array steps. The
    hashes only choose anchors: a collision costs work, never a result."""
    flat = np.frombuffer(raw, np.uint8)
    value = _BYTES[flat]
    word = value > 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(flat))
    place -= np.repeat(starts, np.diff(np.append(starts, len(flat))))
    value = value[starts[0]:] * (_PLACES[place & 63] + (place >> 6).astype(np.uint64))
    return starts, np.add.reduceat(value, starts - starts[0])


def anchors_of(h: np.ndarray, window: int, group: int) -> np.ndarray:
    """The anchor of each window, from its words' hashes: the least mixed
    hash among its groups."""
    spread = window - group + 1
    if len(h) < window:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(h) - group + 1, np.uint64)
    for j in range(group):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j:j + len(g)]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    reach = 1
    while reach < spread:
        step = min(reach, spread - reach)
        g = np.minimum(g[:-step], g[step:])
        reach += step
    return g


def _anchored(column: pa.Array, window: int, group: int):
    """For each text: its bytes, the starts of its words, its anchors."""
    parts = texts(column)
    starts, hashes = word_hashes(b"\n".join(parts))
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    cuts = np.searchsorted(starts, begins)
    for k, raw in enumerate(parts):
        own = slice(cuts[k], cuts[k + 1])
        yield raw, starts[own] - begins[k], anchors_of(hashes[own], window, group)


def _anchor_rows(window: int, group: int, field: str):
    def run(batches):
        for b in slices(batches):
            found = [np.unique(a) for _, _, a in _anchored(b.column("row").field(field), window, group)]
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found).view(np.int64))],
                                             ["id", "anchor"])
    return run


def of_text(raw: bytes) -> int:
    """What tells the texts of one id apart: 64 bits, as a Spark long."""
    return int.from_bytes(xxhash.xxh64_digest(raw), "big", signed=True)


def _passages(window: int, group: int, field: str, remembered: int):
    """The passages around shared anchors. A passage that a smaller document
    of this task holds too is answered here; it travels without its words
    and by its document's key, so copies never pile up in one shard."""
    def run(batches):
        first: dict[bytes, int] = {}
        for b in slices(batches):
            out = [[] for _ in range(6)]
            anchored = _anchored(b.column("row").field(field), window, group)
            for doc, (raw, places, anchors), shared, hot in zip(b.column("id").to_pylist(), anchored,
                                                                b.column("shared").to_pylist(), b.column("hot").to_pylist()):
                if not len(anchors):
                    continue
                places = np.append(places, len(raw))
                many = np.array(hot or [], np.int64).view(np.uint64)
                split = np.isin(anchors, many)
                known = split | np.isin(anchors, np.array(shared or [], np.int64).view(np.uint64))
                new = np.ones(len(anchors), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | split[1:]
                starts, own_text = np.flatnonzero(new), of_text(raw)
                ends = np.append(starts[1:], len(anchors))
                for s, e in zip(starts[known[starts]].tolist(), ends[known[starts]].tolist()):
                    own = b" ".join(raw[places[s]:places[e + window - 1]].split())
                    digest = hashlib.blake2b(own, digest_size=16).digest()
                    least = first.get(digest)
                    if least is not None and least < doc:
                        row = (xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True)), doc, s, e - s, None, own_text)
                    else:
                        if len(first) >= remembered:
                            first.clear()
                        first[digest] = doc
                        key = int.from_bytes(digest[:8], "little") if split[s] else int(anchors[s])
                        row = (key, doc, s, e - s, own, own_text)
                    for c, v in zip(out, row):
                        c.append(v)
            key = np.array(out[0], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                              pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()),
                                              pa.array(out[5], pa.int64())],
                                             ["key", "id", "start", "n", "words", "of"])
    return run


class Automaton:
    """Online suffix automaton of several word sequences."""

    def __init__(self):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, of: int, size: int) -> int:
        self.step.append(dict(self.step[of]))
        self.link.append(self.link[of])
        self.size.append(size)
        return len(self.size) - 1

    def _redirect(self, at: int, word: bytes, to: int) -> int:
        """The state for ``word`` after ``at`` that is one word longer."""
        if self.size[at] + 1 == self.size[to]:
            return to
        clone = self._clone(to, self.size[at] + 1)
        self.link[to] = clone
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            to = self.step[last].get(word)
            if to is not None:
                last = self._redirect(last, word, to)
                continue
            new = len(self.size)
            self.step.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            at = last
            while at >= 0 and word not in self.step[at]:
                self.step[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._redirect(at, word, self.step[at][word])
            last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        step, link, size = self.step, self.link, self.size
        at = length = 0
        out = []
        for word in words:
            while at and word not in step[at]:
                at = link[at]
                length = size[at]
            to = step[at].get(word)
            if to is not None:
                at, length = to, length + 1
            out.append(length)
        return out


def spans_of(ends: list[bool], start: int, window: int) -> list[tuple[int, int]]:
    """Word spans covered by the windows that start where ``ends`` is true."""
    out: list[tuple[int, int]] = []
    for i, hit in enumerate(ends):
        if hit:
            low, high = start + i, start + i + window
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
    return out


def _matched(window: int):
    def run(batches):
        key = doc = None
        automaton, pending = Automaton(), []
        for b in slices(batches, 2048):
            ids, ofs, lows, highs = [], [], [], []
            for k, d, start, n, raw, of in zip(*(c.to_pylist() for c in b.columns)):
                if raw is None:
                    ids.append(d), ofs.append(of), lows.append(start), highs.append(start + n + window - 1)
                    continue
                if k != key:
                    key, doc, automaton, pending = k, d, Automaton(), []
                if d != doc:
                    for held in pending:
                        automaton.add(held)
                    doc, pending = d, []
                words = raw.split(b" ")
                hits = [x >= window for x in automaton.statistics(words)[window - 1:]]
                for low, high in spans_of(hits, start, window):
                    ids.append(d), ofs.append(of), lows.append(low), highs.append(high)
                if not all(hits):
                    pending.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ofs, pa.int64()), pa.array(lows, pa.int32()),
                                              pa.array(highs, pa.int32())], ["id", "of", "low", "high"])
    return run


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, white space after them included."""
    raw = np.frombuffer(text, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = np.flatnonzero(word & ~np.append(False, word[:-1]))
    keep = np.ones(len(raw), bool)
    change = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    for low, high in change.reshape(-1, 2).tolist():
        keep[starts[low]:starts[high] if high < len(starts) else len(raw)] = False
    return raw[keep].tobytes()


def _cleaned(window: int, field: str):
    def run(batches):
        for b in slices(batches):
            n_words, removed, clean = [], [], []
            for text, spans in zip(texts(b.column("row").field(field)), b.column("spans").to_pylist()):
                n = len(text.split())
                n_words.append(n)
                gone = np.zeros(n, bool)
                own_text = of_text(text) if spans and n >= window else None
                for s in (spans or ()) if n >= window else ():
                    if s["of"] is None or s["of"] == own_text:
                        gone[s["low"]:s["high"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                removed.append([{"low": x, "high": y} for x, y in edges])
                clean.append((cut(text, gone) if edges else text).decode())
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n_words, pa.int64()),
                 pa.array([sum(s["high"] - s["low"] for s in r) for r in removed], pa.int64()),
                 pa.array(removed, span), pa.array(clean, pa.string())], ["row", *RESULTS])
    return run


def _copies(digests: DataFrame) -> DataFrame:
    """(id,): documents whose whole text a smaller id has too, from (id,
    digest); an id with several texts is no copy. Written, as it is small."""
    single = (digests.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
              .filter("digest = other").select("id", "digest"))
    single = written(single, "digests")
    firsts = single.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(single.join(firsts, "digest").filter("id > least").select("id"), "copies")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                    group: int = GROUP, hot_docs: int = HOT_DOCS, remembered: int = REMEMBERED) -> DataFrame:
    """The rows of ``docs`` with RESULTS: words, words removed, the maximal
    spans removed (in words, end exclusive), and the text without them.

    A word is removed if it is covered by a window of ``window`` words whose
    sequence also starts in a document with a smaller id; windows are judged
    on the input. Null, empty and short texts have no window. Rows that
    repeat an id are one document and don't remove each other's words; each of
    its texts loses its own repeats only. A row
    with a null id removes nothing and loses nothing. An empty table gives an
    empty table. Results replace input columns of their names."""
    ready(docs.sparkSession)
    everything = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                             quoted(doc_id).cast("long").alias("id"))
    # all joins with the texts deal the same rows by id, so that Spark shuffles the texts once
    work = everything.filter("id is not null")
    copies = _copies(work.select("id", F.unhex(F.md5(F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary"))).alias("digest")))
    firsts = work.join(copies, "id", "left_anti")
    anchors = firsts.mapInArrow(_anchor_rows(window, group, text), "id long, anchor long")
    shared = (anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select("anchor", (F.col("n") > hot_docs).alias("many")))
    of_doc = anchors.join(shared, "anchor").groupBy("id").agg(
        F.collect_list(F.when(~F.col("many"), F.col("anchor"))).alias("shared"),
        F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("hot"))
    passages = work.join(of_doc, "id").select("id", "row", "shared", "hot").mapInArrow(
        _passages(window, group, text, remembered), "key long, id long, start int, n int, words binary, of long")
    spans = (passages.repartition("key").sortWithinPartitions("key", F.col("words").isNull(), "id", "start")
             .mapInArrow(_matched(window), "id long, of long, low int, high int")
             .union(copies.select("id", F.lit(None).cast("long"), F.lit(0), F.lit(2**31 - 1)))
             .groupBy("id").agg(F.collect_list(F.struct("of", "low", "high")).alias("spans")))
    row = row_ddl(work)
    spanned = work.join(spans, "id", "left").select("row", "spans").union(
        everything.filter("id is null").select("row", F.lit(None).cast("array<struct<of:bigint,low:int,high:int>>").alias("spans")))
    cleaned = spanned.mapInArrow(
        _cleaned(window, text), f"row {row}, n_words long, n_removed long, removed array<struct<low:int,high:int>>, clean_text string")
    return unpacked(cleaned, docs.columns, RESULTS)
