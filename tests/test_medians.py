"""Medians by narrowed bounds against plain ones."""

import math
import random
from statistics import median

from quire.operators import groups as G


def table(spark):
    rng = random.Random(5)
    rows = [("even", "a", float(rng.randint(0, 10 ** 6))) for _ in range(1000)]
    rows += [("heaped", "a", rng.choice([1.0, 1.0, 1.0, 1e12, -1e12])) for _ in range(501)]
    rows += [("tail", "b", math.exp(rng.gauss(0, 6))) for _ in range(700)]
    rows += [("two", "b", 1.0), ("two", "b", 2.0), ("one", None, -0.5), ("none", "a", None), ("nan", "a", float("nan")),
             ("nan", "a", 4.0), (None, "c", 3.0), (None, None, 8.0), ("inf", "d", float("inf")), ("inf", "d", 1.0), ("inf", "d", 2.0),
             ("minus", "d", float("-inf")), ("minus", "d", 5.0), ("minus", "d", 5.0), ("gap", "e", 0.0), ("gap", "e", 1e9)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, j string, x double").repartition(7)


SETS = {"one": ["k"], "both": ["j", "k"], "j": ["j"]}


def want(rows, keys):
    at = {"k": 0, "j": 1}
    groups = {}
    for row in rows:
        key = tuple(row[at[k]] for k in keys)
        if None not in key and row[2] is not None and not math.isnan(row[2]):
            groups.setdefault(key, []).append(row[2])
    return {k: median(v) for k, v in groups.items()}


def test_medians_of_several_key_sets(spark):
    rows, df = table(spark)
    for bins in (2, G.MEDIAN_BINS):
        got = G.selected_median_sets(df, SETS, "x", bins=bins)
        for name, keys in SETS.items():
            found = {tuple(r[k] for k in keys): r["_m"] for r in got[name].collect()}
            assert found == want(rows, keys), (bins, name)


def test_given_ranges_and_shuffled_sides(spark):
    rows, df = table(spark)
    spark.conf.set("quire.broadcast.maxRows", "0")
    try:
        ranges = G.grouping_sets_stats(df, SETS, G.range_aggs("x"))
        assert not ranges.small
        got = G.selected_median_sets(df, SETS, "x", ranges)
        assert {(r["k"],): r["_m"] for r in got["one"].collect()} == want(rows, ["k"])
    finally:
        spark.conf.unset("quire.broadcast.maxRows")


def test_no_rows(spark):
    _, df = table(spark)
    assert G.selected_median_sets(df.where("false"), SETS, "x")["both"].count() == 0
