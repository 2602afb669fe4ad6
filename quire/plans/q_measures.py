"""Queries: scalar text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import ngrams as NG
from quire.functions import readability as RD
from quire.functions.unicode_blocks import bucket_rows, values_sql
from quire.operators.joins import bounded
from quire.plans.common import C, D, P, r
from quire.plans.oracle_views import views
from quire.plans.registry import query

# DuckDB (RE2) spellings of the Python character classes used below.
PYWS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
        r"\x{205f}\x{3000}]")
WS_WORDS = ("list_filter(regexp_split_to_array({0}, '" + PYWS.replace("{", "{{").replace("}", "}}")
            + "+'), lambda x: x <> '')")
SP_WORDS = "string_split({0}, ' ')"
CHARS = "list_filter(string_split({0}, ''), lambda x: x <> '')"


def _both(fn, name):
    return [fn("title").alias(f"title_{name}"), fn("short_description").alias(f"desc_{name}")]


def _both_sql(expr: str, name: str, cast: str = "bigint") -> str:
    return (f"cast({expr.format('title')} as {cast}) as title_{name}, "
            f"cast({expr.format('short_description')} as {cast}) as desc_{name}")


@query("t1_char_len", oracle=views("d") + "select sku_id, " + _both_sql("length({0})", "len") + " from d")
def t1_char_len(spark, sf_dir):
    """Characters (code points) of title and description."""
    return D(spark, sf_dir).select("sku_id", X.char_len("title").cast("long").alias("title_len"),
                                   X.char_len("short_description").cast("long").alias("desc_len"))


@query("t2_word_len_ws", oracle=views("d") + "select sku_id, " + _both_sql("len(" + WS_WORDS + ")", "word_len")
       + " from d")
def t2_word_len_ws(spark, sf_dir):
    """Whitespace words (Python ``split()``)."""
    return D(spark, sf_dir).select("sku_id", X.word_len_ws("title").cast("long").alias("title_word_len"),
                                   X.word_len_ws("short_description").cast("long").alias("desc_word_len"))


@query("t3_word_len_space", oracle=views("d") + "select sku_id, " + _both_sql("len(" + SP_WORDS + ")", "space_len")
       + " from d")
def t3_word_len_space(spark, sf_dir):
    """Single-space pieces (Python ``split(' ')``)."""
    return D(spark, sf_dir).select("sku_id", X.word_len_space("title").cast("long").alias("title_space_len"),
                                   X.word_len_space("short_description").cast("long").alias("desc_space_len"))


@query("t4_word_nunique", oracle=views("d") + "select sku_id, " + _both_sql(
    "len(list_distinct(" + SP_WORDS + "))", "word_nunique") + " from d")
def t4_word_nunique(spark, sf_dir):
    """Distinct single-space pieces."""
    return D(spark, sf_dir).select("sku_id", X.word_nunique("title").cast("long").alias("title_word_nunique"),
                                   X.word_nunique("short_description").cast("long").alias("desc_word_nunique"))


@query("t5_digit_count", oracle=views("d") + "select sku_id, " + _both_sql(
    r"len(regexp_extract_all({0}, '\p{{Nd}}'))", "digits")
    + r", cast(regexp_matches(title, '\p{Nd}') as int) as contains_number from d")
def t5_digit_count(spark, sf_dir):
    """Unicode digits, and whether the title has any."""
    return D(spark, sf_dir).select("sku_id", X.digit_count("title").cast("long").alias("title_digits"),
                                   X.digit_count("short_description").cast("long").alias("desc_digits"),
                                   X.contains_number("title").alias("contains_number"))


@query("t6_case_counts", oracle=views("d") + "select sku_id, " + _both_sql(
    r"len(regexp_extract_all({0}, '\p{{Lu}}'))", "upper") + ", " + _both_sql(
    r"len(regexp_extract_all({0}, '\p{{Ll}}'))", "lower") + " from d")
def t6_case_counts(spark, sf_dir):
    """Upper- and lower-case characters."""
    d = D(spark, sf_dir)
    return d.select("sku_id",
                    X.uppercase_count("title").cast("long").alias("title_upper"),
                    X.uppercase_count("short_description").cast("long").alias("desc_upper"),
                    X.lowercase_count("title").cast("long").alias("title_lower"),
                    X.lowercase_count("short_description").cast("long").alias("desc_lower"))


SPECIAL_RE = r"[!-/:-@\[-`{-~ ]"


@query("t7_special_char_count", oracle=views("d") + "select sku_id, " + _both_sql(
    "len(regexp_extract_all({0}, '" + SPECIAL_RE.replace("{", "{{").replace("}", "}}") + "'))", "special")
    + ", cast(regexp_matches(title, '" + SPECIAL_RE + "') as int) as contain_special_char from d")
def t7_special_char_count(spark, sf_dir):
    """ASCII punctuation and space characters."""
    return D(spark, sf_dir).select(
        "sku_id", X.special_char_count("title").cast("long").alias("title_special"),
        X.special_char_count("short_description").cast("long").alias("desc_special"),
        X.contain_special_char("title").alias("contain_special_char"))


@query("t8_chinese_run_count", oracle=views("d") + "select sku_id, " + _both_sql(
    r"len(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'))", "cjk_runs") + " from d")
def t8_chinese_run_count(spark, sf_dir):
    """Runs of CJK unified ideographs."""
    return D(spark, sf_dir).select("sku_id", X.chinese_run_count("title").cast("long").alias("title_cjk_runs"),
                                   X.chinese_run_count("short_description").cast("long").alias("desc_cjk_runs"))


@query("t9_unicode_block_histogram", oracle=views("d") + f"""
, blocks(block, lo, hi) as (values {values_sql()}),
ch as (select sku_id, length(short_description) as n, unnest({CHARS.format('short_description')}) as c from d)
select sku_id, block, count(*) as cnt, round(count(*) / any_value(n), 6) as freq
from ch join blocks on unicode(c) between lo and hi
group by sku_id, block""")
def t9_unicode_block_histogram(spark, sf_dir):
    """Per document and Unicode block: character count and share of the
    text (long form: blocks with no character are absent).

    Counted inside the row: the code points are sorted and their runs taken,
    so a row leaves as one count per distinct ``code_point >> 4``, which meets
    the 4,096-row bucket table (broadcast, size fixed by the rule). Only the
    counts of a row's few distinct buckets are summed by block."""
    d = D(spark, sf_dir).select("sku_id", F.length("short_description").alias("n"), X.chars("short_description").alias("cs"))
    buckets = F.broadcast(spark.createDataFrame(bucket_rows(), "bucket int, block string"))
    d = d.select("sku_id", "n", F.transform("cs", lambda c: F.shiftright(F.ascii(c), 4)).alias("cs"))
    found = NG.term_counts(d.select(F.struct("sku_id", "n").alias("row"), "cs"), "row", F.col("cs"))
    return (found.select("row.sku_id", "row.n", F.col("term").alias("bucket"), "tf").join(buckets, "bucket")
            .groupBy("sku_id", "block", "n").agg(F.sum("tf").alias("cnt"))
            .select("sku_id", "block", "cnt", r(F.col("cnt") / F.col("n")).alias("freq")))


@query("t10_removed_char_counts", oracle=views("d") + r"""
select sku_id,
  cast(length(title) - length(regexp_replace(title, '[^a-zA-Z0-9\-_*.]', '', 'g')) as bigint) as num_special,
  cast(length(title) - length(regexp_replace(title, '[^a-zA-Z\-_*.]', '', 'g')) as bigint) as num_num,
  -cast(length(regexp_replace(title, '[^0-9]', '', 'g')) as bigint) as diff_num,
  cast(length(short_description) - length(regexp_replace(short_description, '[^a-zA-Z0-9\-_*.]', '', 'g')) as bigint)
    as num_special_desc,
  cast(length(short_description) - length(regexp_replace(short_description, '[^a-zA-Z\-_*.]', '', 'g')) as bigint)
    as num_num_desc,
  -cast(length(regexp_replace(short_description, '[^0-9]', '', 'g')) as bigint) as diff_num_desc
from d""")
def t10_removed_char_counts(spark, sf_dir):
    """Characters outside [a-zA-Z0-9-_*.] and outside [a-zA-Z-_*.]."""
    d = D(spark, sf_dir)
    t = X.removed_char_counts("title")
    s = X.removed_char_counts("short_description")
    return d.select("sku_id", *[v.cast("long").alias(k) for k, v in t.items()],
                    *[v.cast("long").alias(f"{k}_desc") for k, v in s.items()])


def _distinct_char_sql(src: str) -> dict[str, str]:
    dc = f"list_distinct({CHARS.format(src)})"
    return {
        "c_set_len": f"len({dc})",
        "c_alpha_len": f"len(list_filter({dc}, lambda x: regexp_matches(x, '^\\p{{L}}$')))",
        "c_digit_len": f"len(list_filter({dc}, lambda x: regexp_matches(x, '^\\p{{Nd}}$')))",
        "c_printable_len": (f"len(list_filter({dc}, lambda x: x = ' ' or not regexp_matches(x, "
                            f"'^[\\p{{Cc}}\\p{{Cf}}\\p{{Cs}}\\p{{Co}}\\p{{Zl}}\\p{{Zp}}\\p{{Zs}}]$')))"),
    }


@query("t11_distinct_char_counts", oracle=views("d") + "select sku_id, " + ", ".join(
    f"cast({e} as bigint) as {k}" for k, e in _distinct_char_sql("lower(title)").items()) + " from d")
def t11_distinct_char_counts(spark, sf_dir):
    """Distinct characters / letters / digits / printable characters of the
    lower-case title."""
    dc = X.distinct_char_counts(F.lower(F.col("title")))
    return D(spark, sf_dir).select("sku_id", *[v.cast("long").alias(k) for k, v in dc.items()])


@query("t12_distinct_word_count_ws", oracle=views("d") + "select sku_id, " + _both_sql(
    "len(list_distinct(" + WS_WORDS + "))", "distinct_words") + " from d")
def t12_distinct_word_count_ws(spark, sf_dir):
    """Distinct whitespace words."""
    return D(spark, sf_dir).select(
        "sku_id", X.distinct_word_count_ws("title").cast("long").alias("title_distinct_words"),
        X.distinct_word_count_ws("short_description").cast("long").alias("desc_distinct_words"))


def _ratio_sql() -> str:
    dc = _distinct_char_sql("lower(title)")
    nw = f"len({WS_WORDS.format('lower(title)')})"
    parts = [f"cast({e} as bigint) as {k}" for k, e in dc.items()]
    for i, k in enumerate(["c_alpha_len", "c_digit_len", "c_printable_len"], start=1):
        parts.append(f"cast({dc[k]} as double) / nullif({dc['c_set_len']}, 0) as r{i}")
    for i, k in zip((4, 5, 6, 7), ["c_alpha_len", "c_digit_len", "c_printable_len", "c_set_len"]):
        parts.append(f"cast({dc[k]} as double) / nullif({nw}, 0) as r{i}")
    return ", ".join(parts)


@query("t13_char_ratio_block", oracle=views("d") + "select sku_id, " + _ratio_sql() + " from d")
def t13_char_ratio_block(spark, sf_dir):
    """Distinct-character counts and ratios r1-r7 (the ``_ex`` block)."""
    block = X.char_ratio_block("title", ex=True)
    cols = [v.cast("long").alias(k) if k.startswith("c_") else v.alias(k) for k, v in block.items()]
    return D(spark, sf_dir).select("sku_id", *cols)


@query("t14_space_stats", oracle=views("d") + r"""
select sku_id, cast(len(regexp_extract_all(title, '[ \t]')) as bigint) as space_cnt,
  len(regexp_extract_all(title, '[ \t]')) / len(string_split(title, ' ')) as space_ratio,
  cast(regexp_matches(title, '^\p{L}') as int) as startswith_alpha,
  cast(starts_with(title, ' ') as int) as startswith_space
from d""")
def t14_space_stats(spark, sf_dir):
    """Spaces and tabs, ratio to space-words, first-character tests."""
    s = X.space_stats("title")
    s["space_cnt"] = s["space_cnt"].cast("long")
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in s.items()])


@query("t15_word_length_stats", oracle=views("d") + r"""
select sku_id, cast(list_min(l) as double) as word_len_min, cast(list_max(l) as double) as word_len_max,
  round(list_avg(l), 6) as word_len_mean, round(list_aggregate(l, 'stddev_pop'), 6) as word_len_std
from (select sku_id, list_transform(string_split(title, ' '), lambda w: length(w)) as l from d)""")
def t15_word_length_stats(spark, sf_dir):
    """Min / max / mean / population std of the title's word lengths."""
    s = X.word_length_stats("title")
    return D(spark, sf_dir).select("sku_id", s["word_len_min"].alias("word_len_min"),
                                   s["word_len_max"].alias("word_len_max"),
                                   r(s["word_len_mean"]).alias("word_len_mean"),
                                   r(s["word_len_std"]).alias("word_len_std"))


def _shape(src: str) -> str:
    return ("translate(regexp_replace(regexp_replace(regexp_replace(" + src + ", '\\p{Nd}', chr(1), 'g'), "
            "'\\p{Lu}', chr(2), 'g'), '\\p{L}', chr(3), 'g'), chr(1) || chr(2) || chr(3), 'NAa')")


@query("t16_shape_nunique", oracle=views("d") + "select sku_id, " + ", ".join([
    f"cast(len(list_distinct(string_split({_shape('title')}, ' '))) as bigint) as title_shape_nunique",
    f"cast(len(list_distinct(string_split({_shape('short_description')}, ' '))) as bigint) as desc_shape_nunique"])
    + " from d")
def t16_shape_nunique(spark, sf_dir):
    """Distinct shape words of title and description."""
    return D(spark, sf_dir).select("sku_id", X.shape_nunique("title").cast("long").alias("title_shape_nunique"),
                                   X.shape_nunique("short_description").cast("long").alias("desc_shape_nunique"))


@query("t17_has_duplicate_words", oracle=views("d") + """
select sku_id, cast(len(string_split(title, ' ')) <> len(list_distinct(string_split(title, ' '))) as int)
  as title_has_duplicates,
  cast(len(string_split(short_description, ' ')) <> len(list_distinct(string_split(short_description, ' '))) as int)
  as desc_has_duplicates
from d""")
def t17_has_duplicate_words(spark, sf_dir):
    """Some single-space word repeats."""
    return D(spark, sf_dir).select("sku_id", X.has_duplicate_words("title").alias("title_has_duplicates"),
                                   X.has_duplicate_words("short_description").alias("desc_has_duplicates"))


@query("t18_common_word_pairs", oracle=views("d") + """
, a as (select sku_id, w, count(*) as n from (select sku_id, unnest(string_split(lower(title), ' ')) as w from d)
        group by sku_id, w),
b as (select sku_id, w, count(*) as n from (select sku_id, unnest(string_split(lower(short_description), ' ')) as w
        from d) group by sku_id, w)
select d.sku_id, cast(coalesce((select sum(a.n * b.n) from a join b on a.sku_id = b.sku_id and a.w = b.w
                                 where a.sku_id = d.sku_id), 0) as bigint) as equ1
from d""")
def t18_common_word_pairs(spark, sf_dir):
    """Number of equal (title word, description word) pairs, lower case:
    sum over words of count_in_title * count_in_description.

    Both sides' words are tagged, sorted together and passed once: a
    description word adds the number of equal title words, which stand
    right before it. The work is that of the sort, whatever the words."""
    tagged = lambda c, side: F.transform(X.words_space(F.lower(c)), lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    d = D(spark, sf_dir).select("sku_id", F.concat(tagged("title", 0), tagged("short_description", 1)).alias("both"))
    d = d.select("sku_id", F.sort_array("both").alias("both"))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pairs"))

    def step(at, e):
        n = F.when(at["w"].eqNullSafe(e["w"]), at["n"]).otherwise(F.lit(0).cast("long"))
        return F.struct(e["w"].alias("w"), (n + 1 - e["side"]).alias("n"), (at["pairs"] + n * e["side"]).alias("pairs"))
    pairs = F.aggregate("both", start, step, lambda at: at["pairs"])
    return d.select("sku_id", F.coalesce(pairs, F.lit(0)).cast("long").alias("equ1"))


def _norm_cat_sql(c: str) -> str:
    return f"replace(replace(replace(replace(lower(coalesce({c}, '')), ', ', ' '), '/ ', ' '), '& ', ' '), '  ', ' ')"


@query("t19_category_word_in_text", oracle=views("c") + "select sku_id, " + ", ".join(
    f"cast(coalesce(list_bool_or(list_transform(" + WS_WORDS.format(_norm_cat_sql(c)) +
    f", lambda w: strpos(lower(title), w) > 1)), false) as int) as cat{i}_in_title"
    for i, c in enumerate(["category_lvl_1", "category_lvl_2", "category_lvl_3"], start=1)) + " from c")
def t19_category_word_in_text(spark, sf_dir):
    """Some word of the normalised category occurs in the lower title
    after its first character (``find > 0``)."""
    c = C(spark, sf_dir)
    return c.select("sku_id", *[
        X.category_word_in_text(X.normalise_category_words(F.coalesce(F.col(k), F.lit(""))),
                                F.lower(F.col("title"))).alias(f"cat{i}_in_title")
        for i, k in enumerate(["category_lvl_1", "category_lvl_2", "category_lvl_3"], start=1)])


def _band_sql(x: str, bands, prefix: str) -> str:
    out = []
    for i, (lo, hi) in enumerate(bands):
        cond = " and ".join(([f"{x} >= {lo}"] if lo is not None else []) + ([f"{x} < {hi}"] if hi is not None else []))
        out.append(f"cast({cond} as int) as {prefix}{i}")
    return ", ".join(out)


@query("t20_length_band_flags_words", oracle=views("d") + "select sku_id, " + _band_sql(
    "len(string_split(lower(title), ' '))", X.WORD_BANDS, "title_len_band") + " from d")
def t20_length_band_flags_words(spark, sf_dir):
    """Word-count bands <5, 5-9, 10-12, 13-19, 20-29, >=30."""
    n = X.word_len_space(F.lower(F.col("title")))
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in X.band_flags(n, X.WORD_BANDS, "title_len_band").items()])


@query("t21_length_band_flags_chars", oracle=views("d") + "select sku_id, " + _band_sql(
    "length(title)", X.CHAR_BANDS, "title_clen_band") + " from d")
def t21_length_band_flags_chars(spark, sf_dir):
    """Character-count bands <20, 20-49, 50-74, 75-99, 100-149, >=150."""
    n = F.length("title")
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in X.band_flags(n, X.CHAR_BANDS, "title_clen_band").items()])


DESC_SQL = r"lower(regexp_replace(coalesce(short_description, ''), '<[^\n]*?>', '', 'g'))"


def _desc():
    return F.lower(X.clean_html(F.coalesce("short_description", F.lit(""))))


@query("t20_length_band_flags_words_description", oracle=views("d") + "select sku_id, " + _band_sql(
    f"len(string_split({DESC_SQL}, ' '))", X.WORD_BANDS, "desc_len_band") + " from d")
def t20_length_band_flags_words_description(spark, sf_dir):
    """Word-count bands of the description."""
    n = X.word_len_space(_desc())
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in X.band_flags(n, X.WORD_BANDS, "desc_len_band").items()])


@query("t21_length_band_flags_chars_description", oracle=views("d") + "select sku_id, " + _band_sql(
    f"length({DESC_SQL})", X.CHAR_BANDS, "desc_clen_band") + " from d")
def t21_length_band_flags_chars_description(spark, sf_dir):
    """Character-count bands of the description."""
    n = F.length(_desc())
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in X.band_flags(n, X.CHAR_BANDS, "desc_clen_band").items()])


@query("t22_length_histogram_bin", oracle=views("d") + """
, m as (select max(len(string_split(title, ' '))) as mw, max(length(title)) as mc from d)
select sku_id,
  case when tw > 0 and tw <= 5 * floor(mw / 5) then cast(ceil(tw / 5.0) - 1 as bigint) end as title_bin,
  case when tc > 0 and tc <= 10 * floor(mc / 10) then cast(ceil(tc / 10.0) - 1 as bigint) end as title_cbin
from (select sku_id, len(string_split(title, ' ')) as tw, length(title) as tc from d), m""")
def t22_length_histogram_bin(spark, sf_dir):
    """Right-closed bins of width 5 (words) and 10 (characters) up to the
    last multiple not above the maximum; outside -> null.

    The maxima are scalar sub-queries (one row each), not a collect."""
    d = D(spark, sf_dir).select("sku_id", X.word_len_space("title").alias("tw"), F.length("title").alias("tc"))
    mw = d.select(F.max("tw")).scalar()
    mc = d.select(F.max("tc")).scalar()

    def bin_(x, w, m):
        top = F.lit(w) * F.floor(m / F.lit(w))
        return F.when((F.col(x) > 0) & (F.col(x) <= top), F.ceil(F.col(x) / F.lit(float(w))) - 1).cast("long")

    return d.select("sku_id", bin_("tw", 5, mw).alias("title_bin"), bin_("tc", 10, mc).alias("title_cbin"))


@query("t23_case_flags", oracle=views("d") + r"""
select sku_id,
  cast(regexp_matches(title, '\p{Ll}') and not regexp_matches(title, '[\p{Lu}\p{Lt}]') as int) as is_lower,
  cast(regexp_matches(title, '\p{Lu}') and not regexp_matches(title, '[\p{Ll}\p{Lt}]') as int) as is_upper,
  cast(regexp_matches(title, '[\p{Ll}\p{Lu}\p{Lt}]')
       and not regexp_matches(title, '[\p{Ll}\p{Lu}\p{Lt}][\p{Lu}\p{Lt}]')
       and not regexp_matches(title, '(^|[^\p{Ll}\p{Lu}\p{Lt}])\p{Ll}') as int) as is_title
from d""")
def t23_case_flags(spark, sf_dir):
    """Python islower / isupper / istitle of the title."""
    return D(spark, sf_dir).select("sku_id", *[v.alias(k) for k, v in X.case_flags("title").items()])


@query("t24_purity_measures", oracle=views("p") + """
select sku_id, model, round(2 * pred * (1 - pred), 6) as gini,
  round(-(case when pred > 0 then pred * log2(pred) else 0 end)
        - (case when pred < 1 then (1 - pred) * log2(1 - pred) else 0 end), 6) as entropy,
  round(1 - greatest(pred, 1 - pred), 6) as class_error
from p""")
def t24_purity_measures(spark, sf_dir):
    """Gini, entropy (bits) and classification error of each prediction."""
    m = X.purity_measures("pred")
    return P(spark, sf_dir).select("sku_id", "model", *[r(v).alias(k) for k, v in m.items()])


@query("t25_readability_indices", oracle=views("d") + "select sku_id, " + RD.oracle_select("title") + " from d")
def t25_readability_indices(spark, sf_dir):
    """Readability of the title from character, word, sentence and
    vowel-group counts (ARI exact; syllables = vowel groups)."""
    return D(spark, sf_dir).select("sku_id", *[r(v).alias(k) for k, v in RD.indices("title").items()])
