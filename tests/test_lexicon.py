"""Lexicon tables: phrases against a plain loop, odd rows, both join paths."""

import pytest
from pyspark.sql import functions as F

from quire.functions.text import words_space
from quire.operators import lexicon as LT
from tests.test_entry import test_query_matches_oracle as same_as_oracle

BRANDS = ["Acme", "old navy", "a b c d", "b", " ", None, "the (north) face", "Old  Navy", "z z"]
COLORS = ["navy", "b c", "north face"]
ROWS = [("1", "Old navy shirt"), ("2", "the north face"), ("3", "a b c d"), ("4", ""), ("5", None), ("6", "old [NAVY]"),
        ("7", "xacme acmex"), ("8", "z  z z"), ("9", "old"), ("10", "a b c " * 3000)]


def words(text):
    return [w for w in (x.translate(str.maketrans("", "", "()[]")).strip() for x in (text or "").lower().split(" ")) if w]


def brute(text, lexicon):
    ws = words(text)
    known = {tuple(words(p)) for p in lexicon} - {()}
    longest = max(map(len, known))
    return [(i, " ".join(ws[i:i + n])) for i in range(len(ws)) for n in range(1, longest + 1)
            if i + n <= len(ws) and tuple(ws[i:i + n]) in known]


@pytest.fixture
def tables(spark):
    return (spark.createDataFrame(ROWS, "k string, t string"),
            {"brand": spark.createDataFrame([(p,) for p in BRANDS], "phrase string"),
             "color": spark.createDataFrame([(p,) for p in COLORS], "phrase string")})


@pytest.mark.parametrize("most", [None, "0"])
def test_phrases_equal_a_plain_loop(spark, tables, most):
    df, lexicons = tables
    if most is not None:
        spark.conf.set("quire.broadcast.maxRows", most)
    try:
        flags = {r["k"]: (r["brand"], r["color"]) for r in LT.lexicon_flags(df, "k", "t", lexicons).collect()}
        hits = LT.phrase_hits(df, "k", LT.phrase_words("t"), lexicons).where("phrase is not null").collect()
    finally:
        spark.conf.unset("quire.broadcast.maxRows")
    assert flags == {k: (int(bool(brute(t, BRANDS))), int(bool(brute(t, COLORS)))) for k, t in ROWS}
    got = sorted((r["k"], r["at"], r["phrase"]) for r in hits)
    assert got == sorted({(k, *h) for k, t in ROWS for h in brute(t, BRANDS) + brute(t, COLORS)})


def test_empty_lexicon_and_empty_table(spark, tables):
    df, lexicons = tables
    none = {"brand": lexicons["brand"].limit(0)}
    assert {r["brand"] for r in LT.lexicon_flags(df, "k", "t", none).collect()} == {0}
    assert LT.lexicon_flags(df.limit(0), "k", "t", lexicons).count() == 0


def test_joined_forms(spark, tables):
    got = sorted(r["phrase"] for r in LT.joined_forms(tables[1]["color"]).collect())
    assert got == ["b c", "bc", "navy", "north face", "northface"]


def test_stop_words_and_ranked_terms(spark):
    df = spark.createDataFrame([("1", "the cat the"), ("2", None), ("3", "dog")], "k string, t string")
    stops = spark.createDataFrame([("the",), ("the",), ("of",)], "word string")
    got = {r["k"]: (r["stopwords_count"], r["stopwords_ratio"]) for r in
           LT.stop_word_counts(df, "k", words_space("t"), stops).collect()}
    assert got == {"1": (2, pytest.approx(2 / 3)), "2": (0, None), "3": (0, 0.0)}
    ranked = spark.createDataFrame([(0, "at"), (2, "og"), (7, "the")], "rank long, term string")
    flags = LT.ranked_term_flags(df, "t", ranked, 4).orderBy("k").select(*[F.col(f"has_{i}") for i in range(4)]).collect()
    assert [tuple(r) for r in flags] == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0)]


@pytest.mark.parametrize("name", ["f8_lexicon_hit_table", "f8_lexicon_hit_table_description",
                                  "f10_ranked_term_flags_table", "n7_lexicon_tfidf_description",
                                  "a20_stop_word_count_table"])
def test_queries_match_their_oracles(spark, name):
    same_as_oracle(spark, name)
