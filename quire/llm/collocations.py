"""Operator 12, phrase collocations from suffix subtrees over word prefixes.

Vertical partitioning: word prefixes are counted, and a prefix with more
occurrences than the memory budget of a group is extended by one word until
all fit or the depth is reached. Prefixes that stand next to each other in
order share a group while their occurrences fit its budget. Every suffix of
a piece, cut off at the depth, goes to the group of its prefix; a group's
suffixes are sorted and form the subtrees below its prefixes, whose nodes
are the phrases and whose leaf totals add up to their frequencies. Groups
know nothing of each other; single words and prefixes above the groups have
their counts from the partitioning.

Only words that are frequent enough themselves can be part of a candidate.
They are kept in a bitmap of fixed size, hashed: a rare word that shares a
bit costs work, never a result. Suffixes end before a rare word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import conf, quoted, ready, slices, texts, written

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
#: A phrase goes for a longer one with at least this share (percent) of its occurrences.
SHARE = 80
SCALE = 2_000_000
#: Suffixes of a group; at most MAX_GROUPS budgets fill the corpus, so that
#: heavy prefixes and the borders of groups have a proven bound.
BUDGET = 1 << 20
MAX_GROUPS = 4096
#: Bits of the filter of frequent words.
FILTER_BITS = 1 << 25
#: Bytes of text that are counted at once.
CHUNK = 4 << 20
#: Sorted suffixes of an Arrow batch.
LEAVES = 1 << 14
RESULTS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

#: Between the words of a key: below any byte of a word, so that a prefix
#: stands right before its extensions.
SEP = "\x01"
BREAK = 0xFF
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes(BREAK if b in _DELIMITERS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ESCAPES = [(b"\x02", b"\x022"), (b"\x01", b"\x021"), (b"\x00", b"\x020")]
_KEY_SQL = "lang string, key string, n long"


# ------------------------------------------------------------------ reading
def _pieces(raw: bytes) -> bytes:
    """The text with lower case, single breaks for delimiters, and escapes
    for bytes that keys use themselves."""
    raw = raw.translate(_BYTES)
    for plain, escaped in _ESCAPES:
        if plain in raw:
            raw = raw.replace(plain, escaped)
    return raw


def _chunks(batches):
    """(lang, text) with whole pieces only, of about CHUNK bytes."""
    held, size = defaultdict(list), defaultdict(int)
    for b in slices(batches):
        for lang, raw in zip(b.column("lang").to_pylist(), texts(b.column("text"))):
            raw = _pieces(raw)
            while raw:
                cut = len(raw)
                if cut > CHUNK:
                    cut = raw.find(b"\xff", CHUNK) + 1 or len(raw)
                held[lang].append(raw[:cut])
                size[lang] += cut
                raw = raw[cut:]
                if size[lang] >= CHUNK:
                    yield lang, b"\xff".join(held.pop(lang))
                    del size[lang]
        if sum(size.values()) >= 2 * CHUNK:
            for lang in list(held):
                yield lang, b"\xff".join(held.pop(lang))
            size.clear()
    for lang in held:
        yield lang, b"\xff".join(held[lang])


def _numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers in order (0 for a break between pieces), and the words."""
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[b"\xff"] = 0
    found = text.replace(b"\xff", b" \xff ").split()
    return np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)), list(numbers)


def filter_bit(lang: str, word: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word) % bits


def _table(lang, keys: list[bytes], counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()),
                                       pa.array(counts, pa.int64())], ["lang", "key", "n"])


def _word_counts(batches):
    for lang, text in _chunks(batches):
        numbers, words = _numbered(text)
        counts = np.bincount(numbers, minlength=len(words))
        yield _table(lang, words[1:], counts[1:])


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and for each entry which it is. Codes
    that leave room are sorted together with their place."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    both = np.sort((codes << bits) | np.arange(len(codes)))
    values = both >> bits
    new = np.append(True, values[1:] != values[:-1])[:len(codes)]
    which = np.empty(len(codes), np.int64)
    which[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return values[new], which


def suffix_counts(numbers: np.ndarray, depth: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes at ``starts``, cut off after ``depth`` words or
    before a 0 (rows of word numbers, filled with 0), and their counts."""
    padded = np.append(numbers, np.zeros(depth, np.int64))
    cols = [padded[starts]]
    for d in range(1, depth):
        cols.append(np.where(cols[-1] == 0, 0, padded[starts + d]))
    code, distinct, width = None, None, int(numbers.max(initial=0)) + 1
    for at in range(0, depth, 2):
        pair = cols[at] * width + (cols[at + 1] if at + 1 < depth else 0)
        own, rank = _distinct(pair)
        rows = np.stack([own // width, own % width], axis=1)
        if code is None:
            code, distinct = rank, rows
            continue
        both, code = _distinct(code * len(own) + rank)
        distinct = np.concatenate([distinct[both // len(own)], rows[both % len(own)]], axis=1)
    return distinct, np.bincount(code, minlength=len(distinct))


def _joined(words: list[bytes], rows: np.ndarray) -> pa.Array:
    """The keys of rows of word numbers; 0 is no word."""
    pool = pa.array([None, *words[1:]], pa.binary())
    return pc.binary_join_element_wise(*(pool.take(pa.array(c)) for c in rows.T), SEP.encode(), null_handling="skip")


def _suffixes(depth: int, bitmap: bytes, heavy: set | None, borders: list[tuple[bytes, bytes]] | None = None):
    """Counts of the suffixes of two words and more of each chunk, cut off at
    ``depth``; with
    ``heavy``, of those that start with one of these (lang, key) alone; with
    ``borders``, with the group of their prefix."""
    firsts = None if heavy is None else {(lang, key.split(SEP)[0].encode()) for lang, key in heavy}
    bits, map_ = 8 * len(bitmap), np.frombuffer(bitmap, np.uint8)

    def group_of(lang: bytes, key: bytes) -> int:
        return max(0, bisect_right(borders, (lang, key)) - 1)

    def border_within(lang: bytes, word: bytes, group: int) -> bool:
        after = borders[group + 1] if group + 1 < len(borders) else (None, b"")
        return after[0] == lang and after[1].startswith(word + b"\x01")

    def run(batches):
        for lang, text in _chunks(batches):
            numbers, words = _numbered(text)
            used = np.ones(len(words), bool)
            if firsts is not None:  # words of no heavy prefix and after none are not looked at
                begin = np.array([(lang, w) in firsts for w in words])[numbers]
                used[:] = False
                for d in range(depth):
                    used[numbers[d:][begin[:len(numbers) - d]]] = True
            looked = np.flatnonzero(used)
            at = np.array([filter_bit(lang, words[i], bits) for i in looked.tolist()], np.int64)
            frequent = np.zeros(len(words), bool)
            frequent[looked] = (map_[at >> 3] >> (at & 7) & 1).astype(bool)
            frequent[0] = False
            numbers = np.where(frequent[numbers], numbers, 0)
            start = numbers > 0 if firsts is None else begin & (numbers > 0)
            distinct, counts = suffix_counts(numbers, depth, np.flatnonzero(start & (np.append(numbers[1:], 0) > 0)))
            keys = _joined(words, distinct)
            if heavy is not None:
                keep = pa.array([(lang, k.decode()) in heavy for k in _joined(words, distinct[:, :depth - 1]).to_pylist()], pa.bool_())
                keys, counts = keys.filter(keep), counts[keep.to_numpy(zero_copy_only=False)]
            out = [pa.array([lang] * len(keys), pa.string()), keys.cast(pa.string()), pa.array(counts, pa.int64())]
            if borders is not None:
                # one group for all suffixes of a first word, but where a border lies among them
                first = np.unique(distinct[:, 0]).tolist()
                low, cut = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
                code = lang.encode()
                low[first] = [group_of(code, words[w]) for w in first]
                cut[first] = [border_within(code, words[w], low[w]) for w in first]
                group, split = low[distinct[:, 0]], np.flatnonzero(cut[distinct[:, 0]])
                group[split] = [group_of(code, k) for k in keys.take(pa.array(split)).to_pylist()]
                out.insert(0, pa.array(group, pa.int32()))
            yield pa.RecordBatch.from_arrays(out, ["grp", "lang", "key", "n"][4 - len(out):])
    return run


# ------------------------------------------------------------------ partitioning
def _borders(budget: int):
    """Of one range of sorted prefixes: the first prefix of each group."""
    def run(batches):
        load = None
        for b in batches:
            langs, keys = [], []
            for lang, key, n in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "n"))):
                if load is None or load + n > budget:
                    langs.append(lang), keys.append(key)
                    load = 0
                load += n
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string())], ["lang", "key"])
    return run


def shared_words(keys: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number of words, and how many of its first words the
    key before it has too."""
    lists = pc.split_pattern(keys, SEP)
    start = lists.offsets.to_numpy()
    size, words = np.diff(start), lists.values
    shared, same = np.zeros(len(keys), np.int64), np.append(False, np.ones(len(keys) - 1, bool))
    for d in range(depth):
        same &= size > d
        same[1:] &= size[:-1] > d
        at = np.flatnonzero(same)
        same[at] = pc.equal(words.take(pa.array(start[at] + d)), words.take(pa.array(start[at - 1] + d))).to_numpy(zero_copy_only=False)
        shared[same] = d + 1
    return size, shared


def _subtrees(depth: int, min_count: int, heavy: set):
    """Nodes of two words and more of the subtrees from sorted suffixes: a
    node begins where its words change, and its frequency is the sum of its
    leaves. Heavy prefixes stand above several groups and are left out."""
    def run(batches):
        open_: dict[str, list[tuple | None]] = defaultdict(lambda: [None] * depth)
        for b in batches:
            out = []
            for lang in b.column("lang").unique().to_pylist():
                own = b.filter(pc.equal(b.column("lang"), lang))
                keys, n = own.column("key"), own.column("n").to_numpy()
                size, shared = shared_words(keys, depth)
                for d in range(1, depth):
                    rows = np.flatnonzero(size > d)
                    if not len(rows):
                        continue
                    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1] + 1) | (shared[rows[1:]] <= d)))
                    sums = np.add.reduceat(n[rows], at)
                    # the first and the last node may go on in other batches
                    show = np.union1d(np.flatnonzero(sums >= min_count), [0, len(at) - 1])
                    nodes = [(lang, SEP.join(k.split(SEP)[:d + 1]), s) for k, s in
                             zip(keys.take(pa.array(rows[at[show]])).to_pylist(), sums[show].tolist())]
                    last = open_[lang][d]
                    if last and last[1] == nodes[0][1]:
                        nodes[0] = (lang, last[1], nodes[0][2] + last[2])
                    elif last:
                        nodes.insert(0, last)
                    open_[lang][d] = nodes.pop()
                    out += [(*x, d + 1) for x in nodes if x[2] >= min_count and x[:2] not in heavy]
            yield _nodes(out)
        yield _nodes([(*x, d + 1) for own in open_.values() for d, x in enumerate(own)
                      if x and x[2] >= min_count and x[:2] not in heavy])
    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int32()))],
                                      ["lang", "key", "n", "depth"])


def _bitmap(frequent: DataFrame, bits: int) -> bytes:
    """The frequent words' bits: at most ``bits`` / 8 bytes on the driver."""
    def at(batches):
        for b in batches:
            found = [filter_bit(lang, w, bits) for lang, w in
                     zip(b.column("lang").to_pylist(), b.column("key").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bit"])
    rows = (frequent.select("lang", "key").mapInArrow(at, "bit long")
            .groupBy(F.expr("bit div 32768").alias("block")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("map")))
    out = bytearray(bits // 8)
    for r in rows.toLocalIterator():
        out[r["block"] * 4096:r["block"] * 4096 + 4096] = r["map"]
    return bytes(out)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, min_count: int = MIN_COUNT,
                  budget: int = BUDGET, max_groups: int = MAX_GROUPS, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all word occurrences of each language; and (lang, key, n,
    depth): every phrase of up to ``depth`` words with ``min_count``
    occurrences or more, its words joined by SEP. Both are written tables.

    ``budget`` is the number of suffixes of a group; it grows beyond
    ``max_groups`` groups. ``filter_bits`` is a multiple of 32,768."""
    spark = docs.sparkSession
    ready(spark)
    work = docs.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), quoted(text).alias("text"))
    words = written(work.mapInArrow(_word_counts, _KEY_SQL).groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = words.filter(F.col("n") >= min_count)
    bitmap = _bitmap(frequent, filter_bits)
    size = frequent.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-size // max_groups))

    prefixes, level, heavy = [], frequent, []
    for d in range(1, depth + 1):
        big = level.filter((F.col("n") > budget) & (F.size(F.split("key", SEP)) == d)).collect() if d < depth else []
        own = {(r["lang"], r["key"]) for r in big}
        if not own:
            prefixes.append(level)
            break
        heavy += [(r["lang"], r["key"], r["n"], d) for r in big]
        gone = spark.createDataFrame(sorted(own), "lang string, key string")
        prefixes.append(level.join(F.broadcast(gone), ["lang", "key"], "left_anti"))
        level = written(work.mapInArrow(_suffixes(d + 1, bitmap, own), _KEY_SQL).groupBy("lang", "key").agg(F.sum("n").alias("n")),
                        "prefixes")
    every = prefixes[0]
    for p in prefixes[1:]:
        every = every.unionByName(p)
    borders = sorted((r["lang"].encode(), r["key"].encode()) for r in
                     every.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
                     .mapInArrow(_borders(budget), "lang string, key string").collect())

    above = {(x[0], x[1]) for x in heavy}
    suffixes = work.mapInArrow(_suffixes(depth, bitmap, None, borders), "grp int, " + _KEY_SQL)
    leaves = suffixes.repartitionById(max(1, len(borders)), F.col("grp")).sortWithinPartitions("key")
    nodes = leaves.select("lang", "key", "n").mapInArrow(_subtrees(depth, min_count, above),
                                                         "lang string, key string, n long, depth int")
    nodes = nodes.unionByName(frequent.withColumn("depth", F.lit(1)))
    if heavy:
        nodes = nodes.unionByName(spark.createDataFrame(heavy, "lang string, key string, n long, depth int")
                                  .filter((F.col("n") >= min_count) & (F.col("depth") > 1)))
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(LEAVES)):
        return totals, written(nodes, "phrases")


def _phrase(key):
    out = F.replace(key, F.lit(SEP), F.lit(" "))
    for plain, escaped in reversed(_ESCAPES):
        out = F.replace(out, F.lit(escaped.decode()), F.lit(plain.decode()))
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, min_count: int = MIN_COUNT,
                 top: int = TOP, share: int = SHARE, scale: int = SCALE, budget: int = BUDGET, max_groups: int = MAX_GROUPS,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """RESULTS: for each language the ``top`` phrases of 2 to ``depth`` words.

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at
    ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``; a null
    language is ``und``. A phrase with a >= ``min_count`` occurrences inside
    pieces scores floor(scale * a / (l + r)) at its worst cut (the first of
    several) into parts with l and r occurrences; it goes if a longer phrase
    around it has ``share`` percent of its occurrences or more. Rows that
    repeat count each time. n is the number of word occurrences of the
    language. Ties go to the larger a, then to the phrase first in byte
    order. An empty table gives an empty table."""
    totals, nodes = phrase_counts(docs, text, lang, depth, min_count, budget, max_groups, filter_bits)
    phrases = nodes.filter("depth > 1").select("lang", "key", "depth", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k")).select(
        "*", F.expr(f"substring_index(key, '{SEP}', k)").alias("first"),
        F.expr(f"substring_index(key, '{SEP}', k - depth)").alias("rest"))
    of = lambda name, n: nodes.select("lang", F.col("key").alias(name), F.col("n").alias(n))
    scored = (cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
              .withColumn("score", F.expr(f"cast(a as decimal(38,0)) * {scale} div (cast(l as decimal(38,0)) + r)")))
    best = scored.groupBy("lang", "key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = phrases.filter("depth > 2").select(
        "lang", "a", "key", F.explode(F.expr("flatten(transform(sequence(2, depth - 1), m -> "
                                             "transform(sequence(m, depth), e -> struct(e, m))))")).alias("s"))
    around = (inner.select("lang", F.expr(f"substring_index(substring_index(key, '{SEP}', s.e), '{SEP}', -s.m)").alias("key"), "a")
              .groupBy("lang", "key").agg(F.max("a").alias("longer")))
    held = best.join(around, ["lang", "key"], "left").filter(
        F.expr(f"longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * {share}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = held.select("lang", _phrase(F.col("key")).alias("phrase"), "a", "best.l", "best.r", "best.score").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
