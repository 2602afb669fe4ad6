"""Readability indices (T25) from counts computed with Spark expressions.

Re-aimed definition (no bundled word lists): characters are letters and
digits, words are whitespace words, sentences are runs of ``.!?`` (at
least one), syllables are vowel groups ``[aeiouy]+`` of the lower-case
word (at least one), polysyllables are words with three or more syllables.
The formulas are the published ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, safe_div, words_ws


def _counts(c) -> dict[str, Column]:
    s = col(c)
    words = words_ws(s)
    syl = F.transform(words, lambda w: F.greatest(F.lit(1), F.regexp_count(F.lower(w), F.lit("[aeiouy]+"))))
    n_words = F.size(words)
    return {
        "chars": F.regexp_count(s, F.lit(r"[\p{L}\p{Nd}]")),
        "words": n_words,
        "sentences": F.greatest(F.lit(1), F.regexp_count(s, F.lit("[.!?]+"))),
        "syllables": F.aggregate(syl, F.lit(0), lambda a, x: a + x),
        "poly": F.size(F.filter(syl, lambda x: x >= 3)),
        "difficult": F.size(F.array_distinct(F.filter(
            F.transform(words, lambda w: F.when(
                F.greatest(F.lit(1), F.regexp_count(F.lower(w), F.lit("[aeiouy]+"))) >= 3, F.lower(w))),
            lambda w: w.isNotNull()))),
    }


def indices(c) -> dict[str, Column]:
    k = _counts(c)
    wps = safe_div(k["words"], k["sentences"])
    spw = safe_div(k["syllables"], k["words"])
    cpw = safe_div(k["chars"], k["words"])
    poly_w = safe_div(k["poly"], k["words"])
    easy = k["words"] - k["poly"]
    lin = safe_div(easy + k["poly"] * 3, k["sentences"])
    return {
        "flesch_reading_ease": F.lit(206.835) - F.lit(1.015) * wps - F.lit(84.6) * spw,
        "flesch_kincaid_grade": F.lit(0.39) * wps + F.lit(11.8) * spw - F.lit(15.59),
        "automated_readability_index": F.lit(4.71) * cpw + F.lit(0.5) * wps - F.lit(21.43),
        "smog_index": F.lit(1.043) * F.sqrt(k["poly"] * F.lit(30.0) / k["sentences"]) + F.lit(3.1291),
        "gunning_fog": F.lit(0.4) * (wps + F.lit(100.0) * poly_w),
        "difficult_words": k["difficult"].cast("double"),
        "linsear_write": F.when(lin > 20, lin / 2).otherwise(lin / 2 - 1),
    }


def oracle_select(src: str) -> str:
    """The same indices as DuckDB SQL over column ``src`` (rounded to 6)."""
    ws = (r"list_filter(regexp_split_to_array({0}, '[\t\n\x0b\x0c\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}"
          r"\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '')").format(src)
    syl = f"list_transform({ws}, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))))"
    words = f"len({ws})"
    sent = f"greatest(1, len(regexp_extract_all({src}, '[.!?]+')))"
    chars = f"len(regexp_extract_all({src}, '[\\p{{L}}\\p{{Nd}}]'))"
    sylls = f"list_sum({syl})"
    poly = f"len(list_filter({syl}, lambda x: x >= 3))"
    diff = (f"len(list_distinct(list_filter(list_transform({ws}, lambda w: case when greatest(1, "
            f"len(regexp_extract_all(lower(w), '[aeiouy]+'))) >= 3 then lower(w) end), lambda x: x is not null)))")
    wps = f"(cast({words} as double) / nullif({sent}, 0))"
    spw = f"(cast({sylls} as double) / nullif({words}, 0))"
    cpw = f"(cast({chars} as double) / nullif({words}, 0))"
    pw = f"(cast({poly} as double) / nullif({words}, 0))"
    lin = f"(cast(({words} - {poly}) + {poly} * 3 as double) / nullif({sent}, 0))"
    parts = {
        "flesch_reading_ease": f"206.835 - 1.015 * {wps} - 84.6 * {spw}",
        "flesch_kincaid_grade": f"0.39 * {wps} + 11.8 * {spw} - 15.59",
        "automated_readability_index": f"4.71 * {cpw} + 0.5 * {wps} - 21.43",
        "smog_index": f"1.043 * sqrt({poly} * 30.0 / {sent}) + 3.1291",
        "gunning_fog": f"0.4 * ({wps} + 100.0 * {pw})",
        "difficult_words": f"cast({diff} as double)",
        "linsear_write": f"case when {lin} > 20 then {lin} / 2 else {lin} / 2 - 1 end",
    }
    return ", ".join(f"round({e}, 6) as {k}" for k, e in parts.items())
