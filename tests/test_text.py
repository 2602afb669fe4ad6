"""Row-local text expressions against Python's own str semantics on the
inline edge rows of FIXTURES.md section 4."""

import pytest
from pyspark.sql import functions as F

from quire.functions import flags as FL
from quire.functions import text as X

EDGE = ["", " ", "tail ", "a  b", "a\tb", "x\xa0y", "a\rb", "<b\n>x</b>", "٣ digits", "ǅab",
        "Ⓐbc", "中文 字", "Hello World", "HELLO", "hello", "Hello world", "can't (do) / it", "AbC123 x9"]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i int, s string")


def collect(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_lengths_and_splits(edge):
    out = edge.select("i", X.char_len("s").alias("a"), X.word_len_ws("s").alias("b"),
                      X.word_len_space("s").alias("c"), X.word_nunique("s").alias("d")).orderBy("i").collect()
    for r, s in zip(out, EDGE):
        assert r["a"] == len(s)
        assert r["b"] == len(s.split())
        assert r["c"] == len(s.split(" "))
        assert r["d"] == len(set(s.split(" ")))


def test_counts(edge):
    out = edge.select("i", X.digit_count("s").alias("d"), X.uppercase_count("s").alias("u"),
                      X.special_char_count("s").alias("sp"), X.chinese_run_count("s").alias("cjk")
                      ).orderBy("i").collect()
    specials = X.SPECIAL_CHARS
    for r, s in zip(out, EDGE):
        assert r["d"] == sum(c.isdigit() and c.isdecimal() for c in s)
        assert r["u"] == sum(c.isupper() for c in s)
        assert r["sp"] == sum(c in specials for c in s)
    assert out[EDGE.index("中文 字")]["cjk"] == 2


def test_case_flags(edge):
    f = X.case_flags("s")
    out = edge.select("i", f["is_lower"].alias("l"), f["is_upper"].alias("u"), f["is_title"].alias("t")) \
        .orderBy("i").collect()
    for r, s in zip(out, EDGE):
        assert (r["l"], r["u"], r["t"]) == (int(s.islower()), int(s.isupper()), int(s.istitle())), s


def test_clean_html_not_across_newline(spark):
    df = spark.createDataFrame([("<b\n>x</b>",), ("a<i>b</i>c",)], "s string")
    assert [r[0] for r in df.select(X.clean_html("s")).collect()] == ["<b\n>x", "abc"]


def test_char_shape_and_slices(edge):
    out = collect(edge.select("i", X.char_shape("s").alias("x")), "x")

    def shape(x):
        return "".join("A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else
                       "N" if c.isdecimal() else c for c in x)
    assert out == [shape(s) for s in EDGE]
    sl = collect(edge.select("i", X.py_slice("s", -5, -4).alias("x")), "x")
    assert sl == [s[-5:-4] for s in EDGE]


def test_word_length_stats_population_std(spark):
    import numpy as np
    df = spark.createDataFrame([("ab c defg",)], "s string")
    st = X.word_length_stats("s")
    r = df.select(*[v.alias(k) for k, v in st.items()]).first()
    lens = [2, 1, 4]
    assert r["word_len_std"] == pytest.approx(np.std(lens))
    assert r["word_len_mean"] == pytest.approx(np.mean(lens))


def test_model_flag_and_lexicon(spark):
    df = spark.createDataFrame([("phone X200",), ("phone",), ("",), ("Red (Ring)",)], "s string")
    out = df.select(FL.looks_like_model("s"), FL.lexicon_hit("s", ["ring"])).collect()
    assert [r[0] for r in out] == [1, 0, 0, 0]
    assert [r[1] for r in out] == [0, 0, 0, 1]
