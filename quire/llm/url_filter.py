"""Operator 9, URL filters: a Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus's
complete key universe that level 1 lets through wrongly, level 3 the listed
keys that level 2 lets through wrongly, and so on until a level has no false
positive. The first level that rejects a key of the universe tells exactly
whether it is listed, without a join. Everything is DataFrame expressions.

All bits of a key lie in one 64-bit word of a level. A level of up to MAX_BITS
is one row, an array of words that queries read as a scalar; the words of a
larger one stay a table, split by their number, which the keys meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import packed, quoted, ready, unpacked, written

HASHES = 3
BITS_PER_KEY = 12
LEAST_WORDS = 64
#: A level's size in bits up to which it is held as one array (16 MiB).
MAX_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["host", "path", "rule", "verdict"]


class Level:
    """One Bloom filter over the column ``key``."""

    def __init__(self, keys: DataFrame, number: int, count: int):
        self.number, self.words = number, max(LEAST_WORDS, -(-count * BITS_PER_KEY // 64))
        key = F.col("key")
        words = keys.groupBy(self._word(key).alias("word")).agg(F.bit_or(self._mask(key)).alias("bits"))
        self.whole = 64 * self.words <= MAX_BITS
        if self.whole:
            # the words where no key falls are zero
            gaps = keys.sparkSession.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
            words = words.unionByName(gaps).groupBy("word").agg(F.bit_or("bits").alias("bits"))
            words = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
        self.bits = written(words, "bloom-level")

    def _word(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(0)), F.lit(self.words))

    def _mask(self, key: Column) -> Column:
        """HASHES bits of a word, from one second hash."""
        h = F.xxhash64(key, F.lit(self.number), F.lit(1))
        out = F.lit(0).cast("long")
        for i in range(HASHES):
            at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
        return out

    def has(self, key: Column) -> Column:
        """Whether a level held as one array lets the key through."""
        mask, bits = self._mask(key), F.element_at(self.bits.scalar(), (self._word(key) + 1).cast("int"))
        return bits.bitwiseAND(mask) == mask

    def passes(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with ``name``: whether the level lets the key through; a
        null key isn't let through."""
        if self.whole:
            return df.withColumn(name, F.col(key).isNotNull() & self.has(F.col(key)))
        mask = self._mask(F.col(key))
        # null keys are spread and meet no word
        place = F.when(F.col(key).isNotNull(), self._word(F.col(key))).otherwise(-1 - F.monotonically_increasing_id())
        words = self.bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        met = df.withColumn("_word", place).join(words, "_word", "left")
        return met.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_word", "_bits")

    def let(self, df: DataFrame) -> DataFrame:
        """The rows (key) that the level lets through."""
        return self.passes(df, "key", "_let").filter("_let").drop("_let")


class Cascade:
    """Exact membership of ``listed`` (key) for every key of ``universe``,
    both without repeats. Only the keys that level 1 lets through are ever
    compared with the list."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[Level] = []
        encoded, others = listed, None
        while (count := encoded.count()):
            level = Level(encoded, len(self.levels), count)
            self.levels.append(level)
            wrong = level.let(universe).join(listed, "key", "left_anti") if others is None else level.let(others)
            encoded, others = written(wrong, "passed"), encoded

    @property
    def whole(self) -> bool:
        return all(level.whole for level in self.levels)

    def _verdict(self, tests: list[Column]) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k, test in reversed(list(enumerate(tests))):
            out = F.when(~test, F.lit(k % 2 == 1)).otherwise(out)
        return out

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed; null stays null. For
        levels that are held as arrays."""
        return F.when(key.isNotNull(), self._verdict([level.has(key) for level in self.levels]))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with ``name``: whether the key, one of the universe, is
        listed; null stays null."""
        tests = [f"_{name}{k}" for k in range(len(self.levels))]
        for test, level in zip(tests, self.levels):
            df = level.passes(df, key, test)
        return df.withColumn(name, F.when(F.col(key).isNotNull(), self._verdict([F.col(t) for t in tests]))).drop(*tests)


def _address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with RESULTS.

    ``rules`` has the columns rule (host and path, such as ``example.org/a/``)
    and verdict (allow or block). A rule fits its host and all subdomains if
    the url's path starts with the rule's path; the longest rule wins, of
    equally long ones the last in string order, and block wins over allow for
    one rule. Without a rule, ``rule`` is null and the verdict is the
    cascade's for an unlisted key, ``default``. A null url, or one without
    ://, has an empty host and path. Repeated rows are judged each; an empty
    table gives an empty table. Results replace input columns of their names.

    A url's keys are its host's last labels joined to its path's first
    characters, for the numbers of labels and characters that rules have."""
    spark: SparkSession = pages.sparkSession
    ready(spark)
    at = F.locate("/", "rule")
    parts = rules.filter(at > 0).select(
        F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("host"),
        F.substr("rule", at).alias("path"), "verdict")
    listed = written(parts.select(F.concat("host", "path").alias("key"), "verdict").distinct(), "rules")
    shapes = parts.select((F.size(F.split("host", r"\."))).alias("labels"), F.length("path").alias("chars")).distinct()
    shapes = sorted((r["labels"], r["chars"]) for r in shapes.collect())
    host, path = _address(quoted(url))
    judged = packed(pages, host=host, path=path)
    keys = [F.when(F.length("path") >= chars,
                   F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))
            for labels, chars in shapes]
    if keys:
        universe = written(judged.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"))
                           .filter("key is not null").distinct(), "url-keys")
        judged = _by_cascade(judged, keys, universe, listed)
    else:
        judged = judged.withColumns({"rule": F.lit(None).cast("string"), "blocked": F.lit(False)})
    verdict = F.when(F.col("rule").isNull(), default).when(F.col("blocked"), "block").otherwise("allow")
    return unpacked(judged.withColumn("verdict", verdict), pages.columns, RESULTS)


def _longest(keys: list[Column]) -> Column:
    """The longest of the keys that aren't null."""
    sized = [F.when(k.isNotNull(), F.struct(F.length(k).alias("n"), k.alias("key"))) for k in keys]
    return (F.greatest(*sized) if len(sized) > 1 else sized[0])["key"]


def _by_cascade(judged: DataFrame, keys: list[Column], universe: DataFrame, listed: DataFrame) -> DataFrame:
    """One cascade tells a url's listed keys, a second one, over the listed
    keys alone, which of them block."""
    rules = listed.select("key").distinct()
    known = Cascade(rules, universe)
    blocks = Cascade(listed.filter("verdict = 'block'").select("key"), rules)
    names = [f"key{i}" for i in range(len(keys))]
    judged = judged.select("row", "host", "path", *[k.alias(n) for k, n in zip(keys, names)])
    if known.whole and blocks.whole:
        rule = _longest([F.when(known.has(F.col(n)), F.col(n)) for n in names])
        return judged.select("row", "host", "path", rule.alias("rule")).withColumn("blocked", blocks.has(F.col("rule")))
    # levels that are tables: keys alone travel to their words, rows once
    judged = written(judged.withColumn("at", F.monotonically_increasing_id()), "urls")
    found = judged.select("at", *names)
    for n in names:
        found = known.mark(found, n, f"has_{n}")
    found = found.select("at", _longest([F.when(F.col(f"has_{n}"), F.col(n)) for n in names]).alias("rule"))
    return judged.select("at", "row", "host", "path").join(blocks.mark(found, "rule", "blocked"), "at").drop("at")
