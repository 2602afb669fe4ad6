"""Operator 6, SimHash near-dedup with the generalised pigeonhole principle.

The 64 bits are grouped so that correlated bits share a partition. If the
thresholds t of the partitions sum to (distance - partitions + 1), where -1
leaves a partition out, any two fingerprints within the distance agree to
within t bits on some partition. Dynamic programming allots the thresholds
that make signatures and estimated candidates cheapest. A signature is a
partition's value with t bits masked out; fingerprints that share one are
verified, and the verified links are reduced to spanning forests inside
every task, so that a group of near copies never emits all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, quoted, ready, signed, slices, texts, written
from quire.llm.components import components

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Distinct fingerprints that bit correlation and candidate counts are
#: estimated from. They set the cost of the search only, never its result.
SAMPLE = 16384
#: Relative costs of shuffling one signature and of verifying one candidate.
SIGNATURE_COST, CANDIDATE_COST = 1.0, 0.01
#: Fingerprints of one signature that a task compares at once. Larger
#: groups are cut into blocks, and each pair of blocks is a task's group.
BLOCK = 4096


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; 0 if it has no word."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(size, len(words)) - 1:]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(signed(fingerprint(t, size) for t in texts(b.column("text"))))], ["id", "fp"])
    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): one row for each row of ``docs``."""
    return docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).alias("text")).mapInArrow(
        _fingerprints(size), "id long, fp long")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of equal size, each grown from a
    free bit by the bits that correlate with it most."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    spread = bits.std(0)
    like = np.abs(bits.T @ bits / max(len(bits), 1) / np.maximum(np.outer(spread, spread), 1e-9))
    free, groups = list(range(BITS)), []
    for p in range(parts):
        own = [free.pop(0)]
        while len(own) < BITS // parts + (p < BITS % parts):
            own.append(free.pop(int(np.argmax(like[np.ix_(own, free)].sum(0)))))
        groups.append(sorted(own))
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def allot(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions that are searched.

    For every number of partitions, dynamic programming over partitions and
    the sum of their thresholds minimises the signatures of all fingerprints
    plus the candidates estimated from the sample's pairs; the cheapest
    number of partitions wins."""
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    probe = sample[: 1024]
    pairs = max(len(probe) * (len(sample) - 1), 1)
    for parts in range(1, distance + 2):
        masks = [_mask(g) for g in bit_groups(sample, parts)]
        table: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for mask in masks:
            apart = np.zeros(distance + 2, np.int64)
            for x in probe:
                apart += np.bincount(np.minimum(np.bitwise_count((sample ^ x) & np.uint64(mask)), distance + 1),
                                     minlength=distance + 2)
            apart[0] -= len(probe)
            width, after = mask.bit_count(), {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, distance + 1):
                    n_masks = len(list(combinations(range(width), t))) if t >= 0 else 0
                    near = apart[: t + 1].sum() / pairs * total * total / 2
                    price = cost + SIGNATURE_COST * total * n_masks + CANDIDATE_COST * near
                    now = (price, chosen + ([(mask, t)] if t >= 0 else []))
                    after[used + t + 1] = min(after.get(used + t + 1, now), now, key=lambda x: x[0])
            table = after
        best = min(best, table[distance + 1], key=lambda x: x[0])
    return best[1]


def masks_of(allotted: list[tuple[int, int]]) -> list[int]:
    """Every mask under which two fingerprints within the distance agree at
    least once: each partition without any t of its bits."""
    out = []
    for mask, t in allotted:
        bits = [b for b in range(BITS) if mask >> b & 1]
        out += [mask & ~_mask(gone) for gone in combinations(bits, t)]
    return out


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among distinct
    fingerprints. Each one is compared once with those not yet reached."""
    links, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                found = rest[near].tolist()
                links += [(at, x) for x in found]
                queue += found
                rest = rest[~near]
    return links


def _links(distance: int):
    keys = ("mask", "key", "left", "right")

    def within(b: pa.Table):
        fps, nodes = (b.column(c).to_numpy() for c in ("fp", "node"))
        fps = fps.view(np.uint64)
        cols = [b.column(c).to_numpy() for c in keys]
        new = np.zeros(len(fps), bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fps))
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        a, c = [two], [two + 1]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            if got := forest(fps[s:e], distance):
                x = np.array(got) + s
                a.append(x[:, 0])
                c.append(x[:, 1])
        a, c = np.concatenate(a), np.concatenate(c)
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[c])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            first = [b.column(c)[0].as_py() for c in keys]
            last = [b.column(c)[b.num_rows - 1].as_py() for c in keys]
            if first == last and held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in keys] == last:
                held.append(b)
                continue
            table = pa.Table.from_batches([*held, b])
            # the last group may go on in the next batch
            cols = [table.column(c).to_numpy() for c in keys]
            other = np.zeros(table.num_rows, bool)
            for c, v in zip(cols, last):
                other |= c != v
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield within(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield within(pa.Table.from_batches(held))
    return run


def _search(classes: DataFrame, masks: list[int], distance: int, block: int) -> DataFrame:
    """(a, b): links that span every component of the fingerprints."""
    signed_masks = F.array(*[F.lit(_as_long(m)).cast("long") for m in masks])
    entries = (classes.select("fp", "node", F.posexplode(signed_masks).alias("mask", "m"))
               .select("mask", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp", "node"))
    large = (entries.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
             .select("mask", "key", F.ceil(F.col("n") / block * 2).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (entries.join(written(large, "large-signatures"), ["mask", "key"], "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .filter((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
             .select("mask", "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                     "fp", "node"))
    keys = ["mask", "key", "left", "right"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    fingerprint: 16 hex digits. component_id: the smallest id among the
    documents reachable over fingerprints that differ in at most ``distance``
    bits, itself included. A text without a word (null, empty, blank) has
    fingerprint 0, linked like any other. Rows that repeat an id are the same
    document. A null id gets a fingerprint, joins no component and has a null
    component_id. An empty table gives an empty table.

    Exact copies meet in one fingerprint by a grouped minimum before the
    search; only distinct fingerprints are searched, and the component goes
    back to documents by a join on the fingerprint, where AQE splits a hot
    one."""
    spark: SparkSession = docs.sparkSession
    ready(spark)
    prints = written(fingerprints(docs, doc_id, text, size), "fingerprints")
    classes = written(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "classes")
    total = classes.count()
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()],
                      np.int64).view(np.uint64)
    masks = masks_of(allot(sample, total, distance)) if total > 1 else []
    # an id on rows with several fingerprints is one document: its classes are one node already or linked here
    found = prints.filter("id is not null").join(classes, "fp").filter("id <> node").select(
        F.col("id").alias("a"), F.col("node").alias("b")) if _repeats(prints) else None
    links = _search(classes, masks, distance, block) if masks else classes.select(
        F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    roots = components(links if found is None else links.union(found))
    labelled = (classes.join(roots, "node", "left")
                .select("fp", F.coalesce("root", "node").alias("component_id")))
    return (prints.join(written(labelled, "labelled"), "fp", "left")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")))


def _repeats(prints: DataFrame) -> bool:
    """Whether some id has several fingerprints."""
    return not (prints.filter("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
                .filter("x <> y").isEmpty())
