"""Flags of lexicon tables: rows that single words flag whole are not searched for longer phrases."""

import pytest
from pyspark.sql import functions as F

from quire.operators import lexicon as LT

ROWS = [("1", "red box of tea"), ("2", "green tea box"), ("3", None), ("4", "red acme"), (None, "old tea box"), (None, "acme"),
        ("5", "green"), ("5", "tea box"), ("6", "tea box big blue sky"), ("7", "")]
LEXICONS = {"brand": ["acme", "tea box", "box of", None, " "], "color": ["red", "big blue sky", "old"]}


def brute():
    out: dict = {}
    for key, text in ROWS:
        words = (text or "").split()
        spans = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        old = out.get(key, (0, 0))
        out[key] = tuple(max(o, int(any(p in spans for p in phrases if p))) for o, phrases in zip(old, LEXICONS.values()))
    return out


@pytest.mark.parametrize("bound", [None, 1])
def test_flags_and_the_rows_still_searched(spark, monkeypatch, bound):
    df = spark.createDataFrame(ROWS, "k string, t string")
    lexicons = {n: spark.createDataFrame([(p,) for p in ps], "phrase string") for n, ps in LEXICONS.items()}
    searched = []
    index_hits = LT.index_hits

    def seen(rows, key, index):
        searched.append(sorted(r["k"] or "" for r in rows.collect()))
        assert index.agg(F.min("n_words")).first()[0] > 1
        return index_hits(rows, key, index)
    monkeypatch.setattr(LT, "index_hits", seen)
    if bound is not None:
        spark.conf.set("quire.broadcast.maxRows", str(bound))
    try:
        got = {r["k"]: (r["brand"], r["color"]) for r in LT.lexicon_flags(df, "k", "t", lexicons).collect()}
    finally:
        spark.conf.unset("quire.broadcast.maxRows")
    assert got == brute()
    open_keys = ["", "", "1", "2", "3", "5", "5", "6", "7"]
    # the null key is flagged whole by its two rows, 4 by its words alone
    assert searched == [[k for k in open_keys if k] if bound is None else sorted(k or "" for k, _ in ROWS)]
