"""Row-local predicates and flags (F1-F11) as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, found_after_start, words_ws

# ---------------------------------------------------------------- fixed values
# Term lists of the title flags (matched as substrings of the lower title).
# The empty term of the screen-size list is dropped (it would match always).
STORAGE_SIZE_TERMS = ["gb", "tb", " mb"]
STORAGE_TERMS = ["hdd", "ssd", " card", "mirco", "rom", "ram", "rpm"]
SCREEN_SIZE_TERMS = ['"', "'", "in"]
SCREEN_TERMS = ["screen", "display", "lcd"]
CPU_TERMS = ["gb", "tb", " mb"]

TITLE_UNIT_FLAGS = {
    "title_has_year": ["2015", "2016", "2017"],
    "title_has_weight": ["kg"],
    "title_has_ssize": ["gb"],
    "title_has_len": [" m ", "cm"],
    "title_has_size": ['"', "inch"],
    "title_has_wh": [" * ", " x "],
    "title_has_pcs": [" pcs "],
}
TITLE_NOUN_FLAGS = {
    "title_has_women": ["women"],
    "title_has_men": [" men"],
    "title_has_fashion": ["fashion"],
    "title_has_watch": ["watch"],
    "title_has_brand_word": ["brand"],
    "title_has_bag": ["bag"],
    "title_has_shoe": ["shoe"],
}
DESC_TOPIC_FLAGS = {
    "has_condition": ["condition", "brand new", "warranty"],
    "has_size": ["size"],
    "has_color": ["color"],
    "has_material": ["material"],
    "has_capacity": ["capacity"],
    "has_style": ["style"],
}
PUNCT_FLAGS = {"title_with_eq": ["="], "title_with_single_quote": ["'"], "title_with_colon": [":"],
               "title_with_bracket": ["(", ")"]}
HTML_START = {"start_with_ul": "<ul", "start_with_div": "<div", "start_with_p": "<p"}
HTML_END = {"end_with_ul": "ul>", "end_with_div": "div>", "end_with_p": "p>"}


def contains_any(c, terms: list[str], lower: bool = True) -> Column:
    """1 when any term occurs in the (lower-cased) text."""
    s = F.lower(col(c)) if lower else col(c)
    if not terms:
        return F.lit(0)
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(t)) for t in terms]).cast("int")


def flag_block(c, spec: dict[str, list[str]], lower: bool = True) -> dict[str, Column]:
    return {name: contains_any(c, terms, lower) for name, terms in spec.items()}


def device_flags(c) -> dict[str, Column]:
    """F1."""
    return {
        "has_storage_size": contains_any(c, STORAGE_SIZE_TERMS),
        "has_storage": contains_any(c, STORAGE_TERMS),
        "has_screen_size": contains_any(c, SCREEN_SIZE_TERMS),
        "has_screen": contains_any(c, SCREEN_TERMS),
        "has_cpu": contains_any(c, CPU_TERMS),
    }


def punctuation_flags(c, match_at_start: bool = False) -> dict[str, Column]:
    """character found after position 0 (``find > 0``)."""
    return {name: reduce(lambda a, b: a | b, [found_after_start(c, t, match_at_start) for t in terms]).cast("int")
            for name, terms in PUNCT_FLAGS.items()}


def html_entity_flags(title, desc) -> dict[str, Column]:
    """F6."""
    return {
        "title_has_html_and": F.contains(col(title), F.lit("&amp;")).cast("int"),
        "title_has_html_space": F.contains(col(title), F.lit("&nbsp;")).cast("int"),
        "desc_has_html_and": F.contains(col(desc), F.lit("&amp;")).cast("int"),
        "desc_has_html_space": F.contains(col(desc), F.lit("&nbsp;")).cast("int"),
        "desc_has_html_class": F.contains(col(desc), F.lit("class=")).cast("int"),
        "desc_has_html_style": F.contains(col(desc), F.lit("style=")).cast("int"),
    }


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def html_boundary_flags(desc) -> dict[str, Column]:
    """stripped description starts / ends with a block tag."""
    s = py_strip(desc)
    out = {k: s.startswith(v).cast("int") for k, v in HTML_START.items()}
    out.update({k: s.endswith(v).cast("int") for k, v in HTML_END.items()})
    return out


def lexicon_words(c) -> Column:
    """Lower single-space words with brackets removed and ends stripped."""
    return F.transform(F.split(F.lower(col(c)), " ", -1),
                       lambda w: py_strip(F.translate(w, "()[]", "")))


def lexicon_hit(c, lexicon: list[str]) -> Column:
    """F8: some word is in a small literal lexicon (lower-cased, stripped)."""
    lex = F.array(*[F.lit(x.strip().lower()) for x in lexicon])
    return F.arrays_overlap(lexicon_words(c), lex).cast("int")


def looks_like_model(c) -> Column:
    """the last whitespace word mixes letters and digits (see D5)."""
    words = words_ws(c)
    last = F.get(words, F.size(words) - 1)
    return F.coalesce((last.rlike("[0-9]") & last.rlike("[A-Za-z]")).cast("int"), F.lit(0))


def term_flags(c, terms: list[str], prefix: str = "has_") -> dict[str, Column]:
    """one 0/1 column per term, substring of the lower text."""
    s = F.lower(col(c))
    return {f"{prefix}{i}": F.contains(s, F.lit(t)).cast("int") for i, t in enumerate(terms)}
