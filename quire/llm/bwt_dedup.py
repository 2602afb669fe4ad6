"""Operator 13, suffix-array dedup by threshold-bounded interval expansion.

A byte goes if it lies in a string of 50 bytes that also starts in a document
with a smaller id. What decides is the Burrows-Wheeler transform of a shard:
its suffixes are sorted, intervals of equal prefixes are extended backwards by
one byte, breadth first, so that common prefixes are found by increasing
length, and the expansion stops at 50. Boundaries that no interval of a
shorter length has set separate groups of equal 50-byte strings, and a string
is a repeat if its group holds a smaller document.

Shards are small because text that nothing shares stays where it is. Every
window is anchored at its least hashed group of bytes, which depends on the
window alone, so equal windows have equal anchors. Documents are dealt into
parts by a hash; each part sends its distinct anchors, once however many of
its documents hold them, and learns which are shared and who is the smallest
holder (the owner). Round 1 matches stretches of text with shared anchors
against the owner's own stretches. Windows that the owner does not hold are
matched anchor by anchor in round 2, where all other holders meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import quoted, ready, texts, unpacked

WINDOW = 50
#: Bytes of an anchor.
GROUP = 30
#: Text of one part of the documents, and of the anchors that one task compares.
PART_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20
#: Parts that one copy of an owner's stretches serves.
PARTS_OF_OWNER = 8
#: An anchor in more documents than this is split by whole windows in round 2.
HOT_DOCS = 4096
#: Symbols of one transform, and bytes of one piece of a long text.
SHARD = 1 << 20
PIECE = 1 << 18
RESULTS = ["n_bytes", "n_removed", "n_spans", "removed", "kept"]

_BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15

MANY, PAIR, HOT = 0, 1, 2
_ROW = [("key", pa.int64()), ("ref", pa.int32()), ("id", pa.int64()), ("of", pa.int64()), ("part", pa.int32()),
        ("start", pa.int64()), ("n", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())]
_ROW_SQL = "key long, ref int, id long, of long, part int, start long, n int, kind int, body binary"


# ------------------------------------------------------------------ anchors
def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive bytes, built by doubling."""
    block, length, out, reach = _BYTES[flat], 1, None, 0
    while length <= size:
        if size & length:
            if out is None:
                out, reach = block, length
            else:
                n = len(flat) - reach - length + 1
                out = out[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + block[reach:reach + n]
                reach += length
        if 2 * length <= size:
            n = len(flat) - 2 * length + 1
            block = block[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + block[length:length + n]
        length *= 2
    return mixed(out)


def anchors(flat: np.ndarray, window: int, group: int) -> np.ndarray:
    """For each window, the least hash among its groups."""
    low, reach, spread = gram_hashes(flat, group), 1, window - group + 1
    while reach < spread:
        step = min(reach, spread - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return low


def anchor_runs(raws, window: int, group: int):
    """Runs of windows with one anchor, in blocks of bounded size: arrays of
    the text's number, first window, number of windows and anchor."""
    held, size = [], 0
    for k, raw in enumerate(raws):
        for at in range(0, len(raw) - window + 1, PIECE):
            held.append((k, at, raw[at:at + PIECE + window - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield _runs(held, window, group)
                held, size = [], 0
    if held:
        yield _runs(held, window, group)


def _runs(held, window, group):
    flat = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
    low = anchors(flat, window, group)
    sizes = np.array([len(h[2]) for h in held])
    piece = np.repeat(np.arange(len(held)), sizes)[:len(low)]
    place = np.arange(len(low)) - (np.cumsum(sizes) - sizes)[piece]
    whole = place <= sizes[piece] - window
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(low)))[whole[at]]
    at = at[whole[at]]
    return (np.array([h[0] for h in held])[piece[at]], np.array([h[1] for h in held])[piece[at]] + place[at], n,
            mixed(low[at] * np.uint64(_BASE)))


# ------------------------------------------------------------------ packed columns
def _planes(*columns: np.ndarray) -> bytes:
    """Columns as bytes, the first bytes of all values first: what is the
    same in all values then compresses."""
    return b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in map(np.ascontiguousarray, columns))


def _unplaned(body: bytes, n: int, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        raw = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _batches(table: pa.Table, field: str, rows: int = 256):
    """(ids, texts) of a part's rows, a few at a time."""
    for b in table.select(["id", "row"]).to_batches(max_chunksize=rows):
        yield b.column("id").to_pylist(), texts(b.column("row").field(field))


def _part_anchors(window: int, group: int, field: str, bits: int):
    """Of a part: its distinct anchors by bucket, each with the smallest
    document that holds it and the number of documents."""
    def run(key, table):
        pairs = np.zeros((2, 0), np.uint64)
        held = [pairs]
        for ids, raws in _batches(table, field):
            own = [(i, t) for i, t in zip(ids, raws) if i is not None and len(t) >= window]
            docs = np.array([i for i, _ in own], np.int64).view(np.uint64)
            for k, _, _, anchor in anchor_runs([t for _, t in own], window, group):
                held.append(np.stack([anchor, docs[k]]))
            if sum(h.shape[1] for h in held) > 1 << 21:
                held = [_distinct(held)]
        anchor, doc = _distinct(held)
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(anchor)))
        anchor, doc, n = anchor[at], doc[at], np.minimum(n, 65535).astype(np.uint16)
        buckets = (anchor >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else []
        ends = np.append(cuts[1:], len(buckets)) if len(buckets) else []
        low = ((anchor << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        return pa.table({"bucket": pa.array([int(buckets[s]) for s in cuts], pa.int32()),
                         "part": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
                         "n": pa.array([int(e - s) for s, e in zip(cuts, ends)], pa.int32()),
                         "body": pa.array([_planes(low[s:e], doc[s:e], n[s:e]) for s, e in zip(cuts, ends)], pa.binary())})
    return run


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    anchor, doc = np.concatenate(held, axis=1)
    order = np.lexsort((doc.view(np.int64), anchor))
    anchor, doc = anchor[order], doc[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    return np.stack([anchor[new], doc[new]])


def _shared_anchors(hot_docs: int, parts_of_owner: int):
    """Of a bucket: the anchors that two documents or more hold, sent to the
    parts that hold them with the owner, the copy of the owner's stretches to
    use, the number of copies to make (by the owner's part) and the kind."""
    def run(key, table):
        sizes = table.column("n").to_numpy()
        cols = [_unplaned(b, n, np.uint32, np.int64, np.uint16) for b, n in zip(table.column("body").to_pylist(), sizes)]
        low, doc, count = (np.concatenate([c[i] for c in cols]) for i in range(3))
        part = np.repeat(table.column("part").to_numpy(), sizes)
        order = np.lexsort((doc, low))
        low, doc, count, part = low[order], doc[order], count[order], part[order]
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        at = np.flatnonzero(new)
        held = np.diff(np.append(at, len(low)))
        n_docs = np.repeat(np.add.reduceat(count.astype(np.int64), at), held)
        owner = np.repeat(doc[at], held)
        copy = ((np.arange(len(low)) - np.repeat(at, held)) // parts_of_owner).astype(np.uint32)
        copies = np.where(owner == doc, np.repeat(-(-held // parts_of_owner), held), 0).astype(np.uint32)
        kind = np.where(n_docs > hot_docs, HOT, np.where(n_docs == 2, PAIR, MANY)).astype(np.uint8)
        take = np.flatnonzero(n_docs > 1)
        take = take[np.argsort(part[take], kind="stable")]
        of = part[take]
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
        ends = np.append(cuts[1:], len(of)) if len(of) else []
        return pa.table({"part": pa.array([int(of[s]) for s in cuts], pa.int32()),
                         "bucket": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
                         "n": pa.array([int(e - s) for s, e in zip(cuts, ends)], pa.int32()),
                         "body": pa.array([_planes(*(c[take[s:e]] for c in (low, owner, copy, copies, kind)))
                                           for s, e in zip(cuts, ends)], pa.binary())})
    return run


# ------------------------------------------------------------------ stretches
def of_text(raw: bytes) -> int:
    """What tells the texts of one id apart: 64 bits, as a Spark long."""
    return int.from_bytes(xxhash.xxh64_digest(raw), "big", signed=True)


def _emitted(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in _ROW]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _ROW)], names=[n for n, _ in _ROW])


def _stretches(window: int, group: int, field: str, bits: int):
    """Of a part: stretches of text whose anchors are shared, keyed by the
    owner's shard. The owner's own stretches come once for each copy."""
    def run(key, left, right):
        mask = np.uint64((1 << (32 + bits)) - 1) << np.uint64(32 - bits)
        blocks = [[np.zeros(0, t) for t in (np.uint64, np.int64, np.uint32, np.uint32, np.uint8)]]
        for bucket, n, body in zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "body"))):
            low, *rest = _unplaned(body, n, np.uint32, np.int64, np.uint32, np.uint32, np.uint8)
            blocks.append([(np.uint64(bucket) << np.uint64(64 - bits)) | (low.astype(np.uint64) << np.uint64(32 - bits)), *rest])
        known, owner, copy, copies, kind = (np.concatenate([b[i] for b in blocks]) for i in range(5))
        order = np.argsort(known)
        known, owner, copy, copies, kind = (x[order] for x in (known, owner, copy, copies, kind))
        part, out = key[0].as_py() if key else 0, []
        tables = []
        for ids, raws in _batches(left, field):
            if not len(known):
                break
            own = [(i, t) for i, t in zip(ids, raws) if i is not None and len(t) >= window]
            for k, start, n, anchor in anchor_runs([t for _, t in own], window, group):
                anchor &= mask
                at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                hit = known[at] == anchor
                k, start, n, at = k[hit], start[hit], n[hit], at[hit]
                doc = np.array([own[x][0] for x in k.tolist()], np.int64)
                mine = doc == owner[at]
                use = np.where(mine, copies[at], copy[at])
                new = np.ones(len(k), bool)
                new[1:] = ((k[1:] != k[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (owner[at][1:] != owner[at][:-1])
                           | (use[1:] != use[:-1]) | (kind[at][1:] != kind[at][:-1]))
                cut = np.flatnonzero(new)
                of = {x: of_text(own[x][1]) for x in np.unique(k).tolist()}
                for s, e in zip(cut.tolist(), np.append(cut[1:], len(k)).tolist()):
                    raw, low, high = own[int(k[s])][1], int(start[s]), int(start[e - 1] + n[e - 1])
                    for c in range(int(use[s])) if mine[s] else [int(use[s])]:
                        shard = xxhash.xxh64_intdigest(b"%d %d" % (owner[at[s]], c)) - (1 << 63)
                        out.append((shard, int(mine[s]), int(doc[s]), of[int(k[s])], part, low, high - low, int(kind[at[s]]),
                                    raw[low:high + window - 1]))
            if len(out) > 4096:
                tables.append(_emitted(out))
                out = []
        return pa.concat_tables([*tables, _emitted(out)])
    return run


# ------------------------------------------------------------------ the transform
def _sorted(keys: np.ndarray, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys); keys that leave room carry their place, so that
    values are sorted, which is faster than sorting places."""
    bits = np.uint64(len(keys).bit_length())
    if key_bits + int(bits) > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort((keys << bits) | np.arange(len(keys), dtype=np.uint64))
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits


def sorted_suffixes(sym: np.ndarray, depth: int) -> np.ndarray:
    """Cyclic suffixes in the order of their first ``depth`` symbols or more
    (symbols under 512), by doubling from four packed symbols."""
    packed, bits, reach = np.zeros(len(sym), np.uint64), len(sym).bit_length(), 4
    for j in range(reach):
        packed = (packed << np.uint64(9)) | np.roll(sym, -j).astype(np.uint64)
    order, values = _sorted(packed, 36)
    while True:
        rank = np.empty(len(sym), np.uint64)
        rank[order] = np.cumsum(np.append(False, values[1:] != values[:-1])).astype(np.uint64)
        if reach >= depth or rank[order[-1]] == len(sym) - 1:
            return order
        order, values = _sorted((rank << np.uint64(bits)) | np.roll(rank, -reach), 2 * bits)
        reach *= 2


def boundaries(sym: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix order, whether it shares fewer than
    ``length`` symbols with the place before it.

    Breadth first on the Burrows-Wheeler transform: intervals of suffixes
    that start with one string are extended backwards by every symbol that
    precedes them. A new interval of strings of length l + 1 whose end no
    shorter string has set gives the common prefix l there and is extended in
    turn. Intervals with one preceding symbol move by its rank; others are
    taken apart by their runs of equal symbols."""
    n = len(sym)
    bwt = sym[order - 1]
    rank = np.empty(n, np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(n)
    run = np.cumsum(np.append(False, bwt[1:] != bwt[:-1]))
    run_start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
    run_end = np.append(run_start[1:], n) - 1
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        first, last = run[low], run[high]
        one = first == last
        lows, highs = [rank[low[one]]], [rank[high[one]]]
        if not one.all():
            low, high, first, last = low[~one], high[~one], first[~one], last[~one]
            size = last - first + 1
            which = np.repeat(np.arange(len(low)), size)
            runs = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]
            begin, end = np.maximum(run_start[runs], low[which]), np.minimum(run_end[runs], high[which])
            by, key = _sorted((which.astype(np.uint64) << np.uint64(9)) | bwt[begin], len(low).bit_length() + 9)
            edge = np.append(True, key[1:] != key[:-1])
            lows.append(rank[begin[by[edge]]])
            highs.append(rank[end[by[np.append(edge[1:], True)]]])
        low, high = np.concatenate(lows), np.concatenate(highs)
        new = ~known[high + 1]
        low, high = low[new], high[new]
        if not len(low):
            break
        known[high + 1] = True
    return known[:n]


def repeats(rows: list[tuple[int, bytes]], window: int) -> list[np.ndarray]:
    """For each (id, bytes): which of its windows start in the bytes of a
    smaller id, too. Equal bytes are one text of the transform, held by the
    smallest of their ids."""
    least: dict[bytes, int] = {}
    for doc, body in rows:
        least[body] = min(doc, least.get(body, doc))
    bodies = list(least)
    sizes = np.array([len(b) for b in bodies])
    begin = np.cumsum(sizes + 1) - sizes - 1
    sym = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    sym[begin + sizes] = 0
    order = sorted_suffixes(sym, window)
    start = np.flatnonzero(boundaries(sym, order, window))
    text = np.repeat(np.arange(len(bodies)), sizes + 1)
    whole = np.arange(len(sym)) + window <= (begin + sizes)[text]
    ids = np.fromiter(least.values(), np.int64)
    holder = np.where(whole, ids[text], np.iinfo(np.int64).max)[order]
    group = np.minimum.reduceat(holder, start)
    found = np.empty(len(sym), bool)
    found[order] = np.repeat(group, np.diff(np.append(start, len(sym)))) < holder
    by_body = {b: found[s:s + max(0, n - window + 1)] for b, s, n in zip(bodies, begin.tolist(), sizes.tolist())}
    return [np.ones(len(by_body[b]), bool) if doc > least[b] else by_body[b] for doc, b in rows]


def _sharded(batches, window: int, shard: int, carried):
    """Rows of one key after the other, in loads of about ``shard`` symbols:
    yields (rows, which windows of each repeat). Rows of an unfinished key
    that ``carried`` names meet the later rows of that key as well, in the
    next load."""
    key, rows, size, held, before = None, [], 0, [], []

    def load():
        parts, at = [[]], 0
        for r in before:
            if at > shard:
                parts.append([])
                at = 0
            parts[-1].append(r)
            at += len(r["body"])
        found = [np.zeros(r["n"], bool) for r in rows]
        for p in parts:
            for f, g in zip(found, repeats([(r["id"], r["body"]) for r in rows + p], window)):
                f |= g
        return rows, found

    for b in batches:
        for r in b.to_pylist():
            if r["key"] != key:
                key, held = r["key"], []
            rows.append(r)
            size += len(r["body"])
            if carried(r):
                held.append(r)
            if size >= shard:
                yield load()
                rows, size, before = [], 0, list({(h["id"], h["body"]): h for h in held}.values())
    if rows:
        yield load()


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _row_spans(flags: list[np.ndarray]):
    """(row, start, end) of the runs of true flags of each row."""
    sizes = np.array([len(f) + 1 for f in flags])
    begin = np.cumsum(sizes) - sizes
    found = spans(np.concatenate([x for f in flags for x in (f, [False])]))
    rows = np.searchsorted(begin, [s for s, _ in found], "right") - 1
    return [(r, s - at, e - at) for (s, e), r, at in zip(found, rows.tolist(), begin[rows].tolist())]


def _round_one(window: int, group: int, shard: int):
    """Stretches against their owner's: repeats come out without a body,
    windows still open with one, keyed by their anchor (whole windows by
    their own hash where the anchor is hot)."""
    def run(batches):
        for rows, found in _sharded(batches, window, shard, lambda r: r["ref"]):
            keep = [i for i, r in enumerate(rows) if not r["ref"]]
            rows, found = [rows[i] for i in keep], [found[i] for i in keep]
            if not rows:
                continue
            same = [(0, r["id"], r["of"], r["part"]) for r in rows]
            out = [(xxhash.xxh64_intdigest(b"%d" % rows[i]["id"]) - (1 << 63), *same[i], rows[i]["start"] + s, e - s, rows[i]["kind"], None)
                   for i, s, e in _row_spans(found)]
            left = [(i, s, rows[i]["body"][s:e + window - 1]) for i, s, e in _row_spans([~f for f in found])
                    if rows[i]["kind"] != PAIR]
            for i, s, body in left:
                if rows[i]["kind"] == HOT:
                    keys = gram_hashes(np.frombuffer(body, np.uint8), window).view(np.int64).tolist()
                    out += [(k, *same[i], rows[i]["start"] + s + j, 1, HOT, body[j:j + window]) for j, k in enumerate(keys)]
            left = [x for x in left if rows[x[0]]["kind"] != HOT]
            for k, at, n, anchor in anchor_runs([body for _, _, body in left], window, group):
                for (i, s, body), key, j, m in zip((left[x] for x in k.tolist()), anchor.view(np.int64).tolist(), at.tolist(), n.tolist()):
                    out.append((key, *same[i], rows[i]["start"] + s + j, m, MANY, body[j:j + m + window - 1]))
            yield from _emitted(out).to_batches()
    return run


def _round_two(window: int, shard: int):
    """Open windows against all holders of their anchor; the repeats of both
    rounds come out as spans of bytes."""
    def run(batches):
        closed: list[pa.RecordBatch] = []

        def still_open():
            for b in batches:
                body = b.column("body").is_valid()
                closed.append(b.filter(pc.invert(body)))
                yield b.filter(body)

        def of_round_one():
            while closed:
                yield _spans_of(closed.pop().to_pylist(), window)
        for rows, found in _sharded(still_open(), window, shard, lambda r: True):
            yield from of_round_one()
            yield _spans_of([rows[i] | {"start": rows[i]["start"] + s, "n": e - s} for i, s, e in _row_spans(found)], window)
        yield from of_round_one()
    return run


def _spans_of(rows: list[dict], window: int) -> pa.RecordBatch:
    get = lambda c, t: pa.array([r[c] for r in rows], t)
    return pa.RecordBatch.from_arrays(
        [get("part", pa.int32()), get("id", pa.int64()), get("of", pa.int64()), get("start", pa.int64()),
         pa.array([r["start"] + r["n"] + window - 1 for r in rows], pa.int64())], ["part", "id", "of", "low", "high"])


# ------------------------------------------------------------------ the operator
def _cleaned(window: int, field: str):
    def run(key, left, right):
        of_doc: dict[tuple[int, int], list] = {}
        for doc, of, low, high in zip(*(right.column(c).to_pylist() for c in ("id", "of", "low", "high"))):
            of_doc.setdefault((doc, of), []).append((low, high))
        ids = {doc for doc, _ in of_doc}
        removed, kept, sizes = [], [], []
        for docs, raws in _batches(left, field):
            for doc, raw in zip(docs, raws):
                own = of_doc.get((doc, of_text(raw)), ()) if doc in ids else ()
                merged: list[list[int]] = []
                for low, high in sorted(own):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(high, merged[-1][1])
                    else:
                        merged.append([low, high])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                sizes.append(len(raw))
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])))
                removed.append([{"low": s, "high": e} for s, e in merged])
        span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        return pa.table({"row": left.column("row"), "n_bytes": pa.array(sizes, pa.int64()),
                         "n_removed": pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()),
                         "n_spans": pa.array([len(r) for r in removed], pa.int64()),
                         "removed": pa.array(removed, span), "kept": pa.array(kept, pa.binary())})
    return run


def bwt_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP,
              hot_docs: int = HOT_DOCS, part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES,
              parts_of_owner: int = PARTS_OF_OWNER, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` with RESULTS: bytes of the text, bytes removed,
    number of maximal removed runs, these runs (in bytes, end exclusive), and
    the bytes that are left (binary: a run may cut a character).

    A byte is removed if it is covered by a string of ``window`` bytes that
    also starts in a document with a smaller id (an integer); strings are
    judged on the input and never cross documents. Null texts are empty;
    texts under ``window`` bytes lose nothing. Rows that repeat an id are one
    document and don't remove each other's bytes. A row with a null id
    removes nothing and loses nothing. An empty table gives an empty table.
    Results replace input columns of their names.

    The texts are shuffled once, by part. ``hot_docs``, ``part_bytes``,
    ``bucket_bytes``, ``parts_of_owner`` and ``shard`` change cost only."""
    ready(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(quoted(text)).cast("long"))).first()[0] or 0
    parts = max(8, -(-size // part_bytes))
    bits = max(4, (size // bucket_bytes).bit_length())
    work = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(doc_id).cast("long").alias("id")) \
        .select("row", "id", F.pmod(F.xxhash64("id", F.col("row").getField(text)), F.lit(parts)).cast("int").alias("part"))
    packed = "n int, body binary"
    held = work.groupBy("part").applyInArrow(_part_anchors(window, group, text, bits), f"bucket int, part int, {packed}")
    shared = held.groupBy("bucket").applyInArrow(_shared_anchors(hot_docs, parts_of_owner), f"part int, bucket int, {packed}")
    stretches = work.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_stretches(window, group, text, bits), _ROW_SQL)
    first = (stretches.repartition("key").sortWithinPartitions("key", F.desc("ref"), "id")
             .mapInArrow(_round_one(window, group, shard), _ROW_SQL))
    gone = (first.repartition("key").sortWithinPartitions("key", "id")
            .mapInArrow(_round_two(window, shard), "part int, id long, of long, low long, high long"))
    results = T.StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, removed array<struct<low:bigint,high:bigint>>, kept binary")
    cleaned = work.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(
        _cleaned(window, text), T.StructType([work.schema["row"], *results.fields]))
    return unpacked(cleaned, docs.columns, RESULTS)
