"""HTML list-item operators (I1-I5) as array expressions.

Items are the texts of ``<li>`` elements of well-formed HTML: the element
content with inner tags removed, the common named entities decoded and the
ends stripped. A description without ``<li`` has no item list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.flags import py_strip
from quire.functions.text import col, words_space, words_ws

LI_PATTERN = r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"

# ---------------------------------------------------------------- fixed values
# HTML named entities decoded in item text (``&amp;`` last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_html(c) -> Column:
    out = col(c)
    for k, v in ENTITIES:
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def has_list(c) -> Column:
    return F.contains(col(c), F.lit("<li"))


def extract_items(c) -> Column:
    """Item texts; an empty array when the text has no ``<li``."""
    raw = F.regexp_extract_all(col(c), F.lit(LI_PATTERN), 1)
    items = F.transform(raw, lambda x: py_strip(decode_html(F.regexp_replace(x, r"<[^>]*>", ""))))
    return F.when(has_list(c), items).otherwise(F.array().cast("array<string>"))


def item_count(c) -> Column:
    """I2."""
    return F.size(extract_items(c))


def clean_item_ratio(c, smoothing: float = 0.1) -> Column:
    """(items with ':' after position 0 + s) / (items + s); 0 if none."""
    items = extract_items(c)
    n = F.size(items)
    clean = F.size(F.filter(items, lambda x: F.instr(x, ":") > 1))
    return F.when(n > 0, (clean + F.lit(smoothing)) / (n + F.lit(smoothing))).otherwise(F.lit(0.0))


def _median(sorted_arr: Column, n: Column) -> Column:
    lo = F.get(sorted_arr, ((n - 1) / 2).cast("int")).cast("double")
    hi = F.get(sorted_arr, (n / 2).cast("int")).cast("double")
    return (lo + hi) / 2


def array_stats(values: Column, prefix: str) -> dict[str, Column]:
    """min / max / sum / mean / median / population std of an int array;
    0 for an empty array (D20)."""
    n = F.size(values)
    dv = F.transform(values, lambda x: x.cast("double"))
    total = F.aggregate(dv, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    # the values are whole numbers, so n * sum(x^2) - sum(x)^2 is exact and nothing cancels;
    # the lambda stays free of outer aggregates (no per-element re-evaluation)
    sq = F.aggregate(dv, F.lit(0.0), lambda a, x: a + x * x)
    dn = n.cast("double")
    var = (dn * sq - total * total) / (dn * dn)
    srt = F.sort_array(dv)
    stats = {
        f"{prefix}_min": F.array_min(dv),
        f"{prefix}_max": F.array_max(dv),
        f"{prefix}_sum": total,
        f"{prefix}_mean": mean,
        f"{prefix}_median": _median(srt, n),
        f"{prefix}_std": F.sqrt(var),
    }
    return {k: F.when(n > 0, v).otherwise(F.lit(0.0)) for k, v in stats.items()}


def item_word_stats(c, items: Column | None = None) -> dict[str, Column]:
    """I4: single-space word counts per item: nonzero count and stats.

    Pass ``items`` (a column holding ``extract_items``) to run the regex
    extraction once per row instead of once per statistic."""
    items = extract_items(c) if items is None else items
    lens = F.transform(items, lambda x: F.size(words_space(x)))
    out = {"item_len_nonzero": F.size(F.filter(lens, lambda x: x != 0)).cast("double")}
    out.update(array_stats(lens, "item_len"))
    return out


def item_word_char_stats(c, items: Column | None = None) -> dict[str, Column]:
    """Whitespace words and characters per item."""
    items = extract_items(c) if items is None else items
    out = array_stats(F.transform(items, lambda x: F.size(words_ws(x))), "item_word_cnt")
    out.update(array_stats(F.transform(items, lambda x: F.length(x)), "item_char_cnt"))
    return out
