"""English stemming of tokens (P16, N6): the published Porter2 rules.

A stem depends on its word alone, so each distinct token is stemmed once and
the stems are joined back. The rules are built-in expressions, one projection
a step: the two regions of a word are kept as the lengths of what lies before
them, and a rule's suffix is the longest that a pattern finds at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import bounded

# ---------------------------------------------------------------- fixed values
# The suffix rules and exceptions of the published English algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOP_AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
LONG_PREFIXES = ["gener", "commun", "arsen"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "ion"]

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: Up to and with the first non-vowel after a vowel.
REGION = f"^{OTHER}*{VOWEL}+{OTHER}"
SHORT_SYLLABLE = f"^{VOWEL}{OTHER}$|{OTHER}{VOWEL}[^aeiouywxY]$"


def ending(w: Column, suffixes) -> Column:
    """The longest of the suffixes that the word ends with, else ''."""
    return F.regexp_extract(w, "(" + "|".join(suffixes) + ")$", 1)


def without(w: Column, n) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def literal_map(rules: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])


def stems(words: DataFrame, word: str = "token", out: str = "stem") -> DataFrame:
    """``words`` with the stem of the lower-case column ``word``; null has none."""
    w, p1, p2, suffix, base = F.col("_w"), F.col("_p1"), F.col("_p2"), F.col("_sx"), F.col("_b")
    keep = [F.col(f"`{c}`") for c in words.columns]
    held = [*keep, p1, p2]
    start = F.length(w) - F.length(suffix)

    def region(c: Column) -> Column:
        found = F.length(F.regexp_extract(c, REGION, 0))
        return F.when(found > 0, found).otherwise(F.length(c))

    def step(df: DataFrame, suffixes, changed: Column) -> DataFrame:
        """Suffix, then what is before it, then the changed word."""
        df = df.select(*held, w, ending(w, suffixes).alias("_sx"))
        df = df.select(*held, w, suffix, start.alias("_at"), F.substring(w, F.lit(1), start).alias("_b"))
        return df.select(*held, changed.alias("_w"))

    at = F.col("_at")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(f"`{word}`"), "^'", ""), "^y", "Y"), f"({VOWEL})y", "$1Y")
    df = words.select(*keep, marked.alias("_w"))
    prefix = F.length(F.regexp_extract(w, "^(" + "|".join(LONG_PREFIXES) + ")", 0))
    df = df.select(*keep, w, F.when(prefix > 0, prefix).otherwise(region(w)).alias("_p1"))
    rest = F.substring(w, p1 + 1, F.length(w))
    df = df.select(*keep, p1, (p1 + region(rest)).alias("_p2"), F.regexp_replace(w, "('s'|'s|')$", "").alias("_w"))

    df = step(df, ["sses", "ied", "ies", "us", "ss", "s"],
              F.when(suffix == "sses", without(w, 2))
              .when(suffix.isin("ied", "ies"), F.when(at > 1, without(w, 2)).otherwise(without(w, 1)))
              .when((suffix == "s") & base.rlike(VOWEL + "."), base).otherwise(w))
    done = w.isin(STOP_AFTER_1A)
    trimmed = (F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
               .when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), without(base, 1))
               .when((at <= p1) & base.rlike(SHORT_SYLLABLE), F.concat(base, F.lit("e"))).otherwise(base))
    df = step(df, ["eedly", "ingly", "edly", "eed", "ing", "ed"],
              F.when(done, w)
              .when(suffix.isin("eed", "eedly"), F.when(at >= p1, F.concat(base, F.lit("ee"))).otherwise(w))
              .when((suffix != "") & base.rlike(VOWEL), trimmed).otherwise(w))
    df = step(df, ["[yY]"], F.when((suffix != "") & base.rlike(f".{OTHER}$"), F.concat(base, F.lit("i"))).otherwise(w))
    fits = (F.when(suffix == "ogi", base.endswith("l")).when(suffix == "li", base.rlike("[cdeghkmnrt]$")).otherwise(F.lit(True)))
    df = step(df, STEP_2, F.when((suffix != "") & (at >= p1) & fits,
                                 F.concat(base, F.element_at(literal_map(STEP_2), suffix))).otherwise(w))
    df = step(df, STEP_3, F.when((suffix != "") & (at >= p1) & ((suffix != "ative") | (at >= p2)),
                                 F.concat(base, F.element_at(literal_map(STEP_3), suffix))).otherwise(w))
    df = step(df, STEP_4, F.when((suffix != "") & (at >= p2) & ((suffix != "ion") | base.rlike("[st]$")), base).otherwise(w))
    df = step(df, ["e", "l"],
              F.when((suffix == "e") & ((at >= p2) | ((at >= p1) & ~base.rlike(SHORT_SYLLABLE))), base)
              .when((suffix == "l") & (at >= p2) & base.endswith("l"), base).otherwise(w))
    own = F.col(f"`{word}`")
    return df.select(*keep, F.when(F.length(own) <= 2, own)
                     .otherwise(F.coalesce(F.try_element_at(literal_map(EXCEPTIONS), own), F.replace(w, F.lit("Y"), F.lit("y")))).alias(out))


def stem_table(tokens: DataFrame, col: str = "token") -> DataFrame:
    """(token, stem) of the distinct tokens."""
    return stems(tokens.select(F.col(col).alias("token")).where("token is not null").distinct())


def stemmed_counts(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of words -> the same of their stems, the counts of
    words with one stem added up. The dictionary of stems is broadcast only
    within the measured bound."""
    found = counts.join(bounded(stem_table(counts, "term")), counts["term"] == F.col("token"))
    return found.groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def stem_arrays(df: DataFrame, key: str, tokens: str, out: str = "stems") -> DataFrame:
    """(key, stems): the tokens of each row in their order, stemmed; null
    for a null array. ``key`` is unique; a row's stems are as many as its tokens."""
    placed = df.select(key, F.col(tokens).isNotNull().alias("_has"), F.posexplode_outer(tokens).alias("_i", "token"))
    table = bounded(stem_table(placed))
    own = F.when(F.col("stem").isNotNull(), F.struct("_i", "stem"))
    return (placed.join(table, "token", "left").groupBy(key)
            .agg(F.max("_has").alias("_has"), F.sort_array(F.collect_list(own)).alias("_s"))
            .select(key, F.when(F.col("_has"), F.col("_s.stem")).alias(out)))
