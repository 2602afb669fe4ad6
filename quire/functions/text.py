"""Row-local text expressions: cleaning (P*), scalar measures (T*).

Every function takes and returns ``Column`` objects built from Spark SQL
built-ins, so they stay inside whole-stage codegen and work unchanged on
batch and streaming DataFrames. String semantics follow Python's ``str``:
``len`` counts code points, ``split(' ')`` keeps empty pieces, ``split()``
splits on runs of Unicode whitespace and drops empties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Character set counted by the special-character measures (32 ASCII
# punctuation characters followed by a space).
SPECIAL_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ "

# Price conversion to one currency: rate per country code, default otherwise.
PRICE_RATES = {"sg": 1.0, "my": 0.32}
PRICE_DEFAULT_RATE = 0.074


# Python's str.isspace() set: Unicode White_Space plus the separators U+001C..U+001F.
PY_WHITESPACE = r"(?U)[\s\x{1c}-\x{1f}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- tokenising
def words_ws(c) -> Column:
    """``s.split()``: runs of Unicode whitespace, no empty pieces."""
    return F.filter(F.split(col(c), PY_WHITESPACE + "+", -1), lambda w: w != F.lit(""))


def words_space(c) -> Column:
    """``s.split(' ')``: every single space splits, empty pieces kept."""
    return F.split(col(c), " ", -1)


def chars(c) -> Column:
    """Array of the code points of ``c`` (empty array for '')."""
    return F.filter(F.split(col(c), "", -1), lambda ch: ch != F.lit(""))


# ---------------------------------------------------------------- P: cleaning
def clean_html(c) -> Column:
    """Remove ``<...>`` non-greedily; a tag never spans a newline."""
    return F.regexp_replace(col(c), r"<[^\n]*?>", "")


def strip_tags_strict(c) -> Column:
    """Remove ``<...>`` without another ``<`` inside (may span lines)."""
    return F.regexp_replace(col(c), r"<[^<]+?>", "")


def decode_entities(c) -> Column:
    """``&amp;`` -> ``&`` then ``&nbsp;`` -> space."""
    return F.replace(F.replace(col(c), F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" "))


def space_punctuation(c, chars_: str = "()/") -> Column:
    """Put a space on both sides of each bracket / slash, then collapse
    one round of double spaces and turn tabs into spaces."""
    out = col(c)
    for ch in chars_:
        out = F.replace(out, F.lit(ch), F.lit(f" {ch} "))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    return F.replace(out, F.lit("\t"), F.lit(" "))


def normalise_category_words(c) -> Column:
    """P5: lower case; ``', '``, ``'/ '``, ``'& '`` become a space; double
    spaces collapse once."""
    out = F.lower(col(c))
    for sep in (", ", "/ ", "& "):
        out = F.replace(out, F.lit(sep), F.lit(" "))
    return F.replace(out, F.lit("  "), F.lit(" "))


def strip_category_punct(c) -> Column:
    """Delete ``&``, ``/`` and ``,``."""
    return F.translate(col(c), "&/,", "")


def convert_price(price="price", country="country", rates: dict | None = None,
                  default: float = PRICE_DEFAULT_RATE) -> Column:
    """Local price to one currency by country rate."""
    rates = PRICE_RATES if rates is None else rates
    expr = None
    for code, rate in rates.items():
        cond = col(country) == F.lit(code)
        expr = F.when(cond, col(price) * F.lit(rate)) if expr is None else expr.when(cond, col(price) * F.lit(rate))
    return expr.otherwise(col(price) * F.lit(default))


def combo_key(*cols, fill: str = "NA", sep: str = "-") -> Column:
    """Categories joined with ``-`` after the null fill."""
    return F.concat_ws(sep, *[F.coalesce(col(c), F.lit(fill)) for c in cols])


def py_slice(c, start: int | None, stop: int | None) -> Column:
    """Python ``s[start:stop]`` on code points (negative indices allowed)."""
    s = col(c)
    n = F.length(s)

    def norm(i, default):
        if i is None:
            return default
        if i >= 0:
            return F.least(F.lit(i), n)
        return F.greatest(n + F.lit(i), F.lit(0))

    a = norm(start, F.lit(0))
    b = norm(stop, n)
    return F.when(b > a, F.substring(s, a + 1, b - a)).otherwise(F.lit(""))


def token_at(c, i: int, missing: str = "NA", sep: str = " ") -> Column:
    """The i-th (0-based) ``sep`` token, ``missing`` if absent."""
    return F.coalesce(F.get(F.split(col(c), sep, -1), i), F.lit(missing))


def ws_token_at(c, i: int, missing: str = "NA") -> Column:
    """The i-th (0-based) whitespace word, ``missing`` if absent."""
    return F.coalesce(F.get(words_ws(c), i), F.lit(missing))


def char_shape(c) -> Column:
    """Upper-case letter -> A, other letter -> a, digit -> N, rest kept.

    Letters and digits are first mapped to private control characters so an
    input 'A', 'a' or 'N' is classified like any other letter."""
    s = F.regexp_replace(col(c), r"(?U)\d", "\u0001")
    s = F.regexp_replace(s, r"[\p{L}&&[\p{IsUppercase}]]", "\u0002")
    s = F.regexp_replace(s, r"\p{L}", "\u0003")
    return F.translate(s, "\u0001\u0002\u0003", "NAa")


def tokenise_alpha(c) -> Column:
    """Non-ASCII-letters to space, lower case, whitespace split."""
    s = F.lower(F.regexp_replace(col(c), r"[^a-zA-Z]", " "))
    return F.filter(F.split(s, " +", -1), lambda w: w != F.lit(""))


def tokenise_unique_filtered(c, drop: Column) -> Column:
    """Distinct P13 tokens minus the array ``drop``."""
    return F.array_except(F.array_distinct(tokenise_alpha(c)), drop)


def tokenise_words(c) -> Column:
    """The default word pattern ``\\b\\w\\w+\\b`` on lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\b\w\w+\b"), 0)


def stem_token(w: Column) -> Column:
    """P16 helper: the S-stemmer (plural stripping; first matching rule)."""
    return (F.when(w.endswith("ies") & ~w.endswith("eies") & ~w.endswith("aies"),
                   F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
            .when(w.endswith("es") & ~w.endswith("aes") & ~w.endswith("ees") & ~w.endswith("oes"),
                  F.substring(w, F.lit(1), F.length(w) - 1))
            .when(w.endswith("s") & ~w.endswith("us") & ~w.endswith("ss"),
                  F.substring(w, F.lit(1), F.length(w) - 1))
            .otherwise(w))


def stem_tokens(tokens: Column) -> Column:
    """Stem every token of an array."""
    return F.transform(tokens, stem_token)


def one_hot_label(y) -> Column:
    """0/1 label -> [1-y, y]."""
    return F.array((F.lit(1) - col(y)).cast("double"), col(y).cast("double"))


def zero_fill(c) -> Column:
    """Null and NaN -> 0.0."""
    return F.nanvl(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


# ---------------------------------------------------------------- T: measures
def char_len(c) -> Column:
    """Code points."""
    return F.length(col(c))


def word_len_ws(c) -> Column:
    """Whitespace words."""
    return F.size(words_ws(c))


def word_len_space(c) -> Column:
    """Single-space pieces (``''`` counts as one)."""
    return F.size(words_space(c))


def word_nunique(c) -> Column:
    """T4: distinct single-space pieces."""
    return F.size(F.array_distinct(words_space(c)))


def digit_count(c) -> Column:
    """T5: Unicode decimal digits."""
    return F.regexp_count(col(c), F.lit(r"(?U)\d"))


def contains_number(c) -> Column:
    return (digit_count(c) > 0).cast("int")


def uppercase_count(c) -> Column:
    """Characters with the Unicode Uppercase property."""
    return F.regexp_count(col(c), F.lit(r"\p{IsUppercase}"))


def lowercase_count(c) -> Column:
    return F.regexp_count(col(c), F.lit(r"\p{IsLowercase}"))


def special_char_count(c, special: str = SPECIAL_CHARS) -> Column:
    """Characters from the special set."""
    return F.length(col(c)) - F.length(F.translate(col(c), special, ""))


def contain_special_char(c) -> Column:
    return (special_char_count(c) >= 1).cast("int")


def chinese_run_count(c) -> Column:
    """Maximal runs of CJK unified ideographs (U+4E00..U+9FFF)."""
    return F.regexp_count(col(c), F.lit(r"[\x{4e00}-\x{9fff}]+"))


def removed_char_counts(c) -> dict[str, Column]:
    """Characters outside ``[a-zA-Z0-9\\-_*.]`` / outside ``[a-zA-Z\\-_*.]``."""
    n = F.length(col(c))
    special = n - F.length(F.regexp_replace(col(c), r"[^a-zA-Z0-9\-_*.]", ""))
    num = n - F.length(F.regexp_replace(col(c), r"[^a-zA-Z\-_*.]", ""))
    return {"num_special": special, "num_num": num, "diff_num": special - num}


def distinct_chars(c) -> Column:
    return F.array_distinct(chars(c))


def distinct_char_counts(c) -> dict[str, Column]:
    """Distinct letters / digits / printable characters of ``c``."""
    d = distinct_chars(c)
    return {
        "c_set_len": F.size(d),
        "c_alpha_len": F.size(F.filter(d, lambda ch: ch.rlike(r"^\p{L}$"))),
        "c_digit_len": F.size(F.filter(d, lambda ch: ch.rlike(r"^(?U)\d$"))),
        "c_printable_len": F.size(F.filter(d, lambda ch: ~ch.rlike(r"^[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}]$") | (ch == F.lit(" ")))),
    }


def distinct_word_count_ws(c) -> Column:
    """Distinct whitespace words."""
    return F.size(F.array_distinct(words_ws(c)))


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL (never NaN/inf) on a zero divisor."""
    return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double"))


def char_ratio_block(c, ex: bool = True) -> dict[str, Column]:
    """Distinct-character counts and their ratios on the lower text.

    ``ex=False``: c_set_len = distinct whitespace words, r1-r3 divide by it.
    ``ex=True``: c_set_len = distinct characters, r4-r7 divide by the word count.
    """
    low = F.lower(col(c))
    dc = distinct_char_counts(low)
    if not ex:
        dc["c_set_len"] = distinct_word_count_ws(low)
    out = dict(dc)
    for i, k in enumerate(["c_alpha_len", "c_digit_len", "c_printable_len"], start=1):
        out[f"r{i}"] = safe_div(dc[k], dc["c_set_len"])
    if ex:
        n_words = word_len_ws(low)
        out["r4"] = safe_div(dc["c_alpha_len"], n_words)
        out["r5"] = safe_div(dc["c_digit_len"], n_words)
        out["r6"] = safe_div(dc["c_printable_len"], n_words)
        out["r7"] = safe_div(dc["c_set_len"], n_words)
    return out


def space_stats(c) -> dict[str, Column]:
    """Spaces and tabs, ratio to space-words, first-character tests."""
    s = col(c)
    cnt = F.regexp_count(s, F.lit(r"[ \t]"))
    return {
        "space_cnt": cnt,
        "space_ratio": safe_div(cnt, word_len_space(s)),
        "startswith_alpha": s.rlike(r"^\p{L}").cast("int"),
        "startswith_space": s.startswith(" ").cast("int"),
    }


def word_length_stats(c) -> dict[str, Column]:
    """Min / max / mean / population std of single-space word lengths."""
    lens = F.transform(words_space(c), lambda w: F.length(w).cast("double"))
    n = F.size(lens).cast("double")
    total = F.aggregate(lens, F.lit(0.0), lambda acc, x: acc + x)
    mean = total / n
    # lengths are whole numbers, so n * sum(x^2) - sum(x)^2 is exact and nothing cancels;
    # the lambda stays free of outer aggregates (no per-element re-evaluation)
    sq = F.aggregate(lens, F.lit(0.0), lambda acc, x: acc + x * x)
    var = (n * sq - total * total) / (n * n)
    return {
        "word_len_min": F.array_min(lens),
        "word_len_max": F.array_max(lens),
        "word_len_mean": mean,
        "word_len_std": F.sqrt(var),
    }


def shape_nunique(c) -> Column:
    """Distinct single-space words of the P12 shape."""
    return F.size(F.array_distinct(words_space(char_shape(c))))


def has_duplicate_words(c) -> Column:
    """Some single-space word repeats."""
    return (word_len_space(c) != word_nunique(c)).cast("int")


def found_after_start(text, needle, match_at_start: bool = False) -> Column:
    """``text.find(needle) > 0`` (default, see D3) or ``>= 0``.

    ``needle`` is a literal string or a Column."""
    pos = F.instr(col(text), needle)
    return pos >= 1 if match_at_start else pos > 1


def category_word_in_text(category, text, match_at_start: bool = False) -> Column:
    """Some space word of the category occurs in the text."""
    return F.exists(words_ws(category),
                    lambda w: found_after_start(text, w, match_at_start)).cast("int")


WORD_BANDS = [(None, 5), (5, 10), (10, 13), (13, 20), (20, 30), (30, None)]
CHAR_BANDS = [(None, 20), (20, 50), (50, 75), (75, 100), (100, 150), (150, None)]


def band_flags(x: Column, bands, prefix: str) -> dict[str, Column]:
    """0/1 columns for ``lo <= x < hi`` bands."""
    out = {}
    for i, (lo, hi) in enumerate(bands):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (x >= lo)
        if hi is not None:
            cond = cond & (x < hi)
        out[f"{prefix}{i}"] = cond.cast("int")
    return out


CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
UPPERISH = r"[\p{IsUppercase}\p{Lt}]"


def case_flags(c) -> dict[str, Column]:
    """Python ``islower`` / ``isupper`` / ``istitle``."""
    s = col(c)
    return {
        "is_lower": (s.rlike(r"\p{IsLowercase}") & ~s.rlike(UPPERISH)).cast("int"),
        "is_upper": (s.rlike(r"\p{IsUppercase}") & ~s.rlike(r"[\p{IsLowercase}\p{Lt}]")).cast("int"),
        # title: upper only after uncased, lower only after cased
        "is_title": (s.rlike(CASED)
                     & ~s.rlike(CASED + UPPERISH)
                     & ~s.rlike(r"(^|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}])\p{IsLowercase}")).cast("int"),
    }


def purity_measures(p) -> dict[str, Column]:
    """Gini, entropy (bits) and classification error of probability p."""
    p = col(p).cast("double")
    q = F.lit(1.0) - p
    ent = -(F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q)).otherwise(F.lit(0.0)))
    return {
        "gini": p * q + q * p,
        "entropy": ent,
        "class_error": F.lit(1.0) - F.greatest(p, q),
    }
