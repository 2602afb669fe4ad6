"""Whitening, collocations and suffix-array dedup against brute force and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bwt_dedup, collocations, queries, whitening
from quire.sources.tables import table
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_llm import CLASH, odd_docs


# 11: whitening

def test_inertia():
    rng = np.random.default_rng(0)
    for t in range(40):
        a = rng.normal(size=(12, 12))
        a = a + a.T
        if t % 5 == 0:
            a[:6, :6] = 0
        if t % 7 == 0:
            a = np.diag(np.diag(a))
        assert whitening.inertia(a) == (np.linalg.eigvalsh(a) > 1e-12).sum()


def test_leading_values(spark):
    """Equal, missing and close eigenvalues are all found."""
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(10, 10)))[0]
    for want in ([5.0] * 5 + [1.0] * 5, [3.0, 2.0] + [0.0] * 8, [0.0] * 10, [4.0, 3.0, 2.0, 1.0 + 1e-7, 1.0] + [0.5] * 5):
        v = turn @ np.diag(want) @ turn.T
        values, axes = whitening.leading(spark, (v + v.T) / 2, 4)
        assert np.allclose(values, [w for w in want if w][:4], atol=1e-12)
        assert np.abs(v @ axes - axes * values).max(initial=0) < 1e-11 and np.allclose(axes.T @ axes, np.eye(len(values)))


def test_whitening_is_exact(spark):
    vectors = table(spark, SF_SMALL, "embeddings")
    rows = vectors.collect()
    vectors = vectors.unionByName(vectors.limit(40).withColumn("vec_id", F.col("vec_id") + 100_000)).unionByName(
        spark.createDataFrame([(-1, None, 0), (-2, [1.0, None], 0), (-3, [float("nan")] * 64, 0), (-4, [float("-inf")] * 64, 0)],
                              vectors.schema))
    got = {r["vec_id"]: r for r in whitening.whiten(vectors).collect()}
    x = np.floor(np.array([r["embedding"] for r in rows], float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    want = (x - sums / n) @ (axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4]))
    assert len(got) == len(rows) + 40 and min(got) >= 0
    for r, own, w in zip(rows, x, want):
        g = got[r["vec_id"]]
        assert g["n"] == n and int(g["deviation"]) == int(((n * own - sums) ** 2).sum())
        assert np.allclose(np.abs(g["whitened"]), np.abs(w), atol=1e-9)
        assert np.allclose(g["explained"], values[::-1][:4] / values.sum(), rtol=1e-9) and g["identity_error"] < 1e-9


def test_whitening_query(spark):
    got = queries.op11_embedding_whitening(spark, SF_SMALL)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    assert got.groupBy("component").count().orderBy("component").collect() == [(c, 500) for c in (1, 2, 3, 4)]


def test_odd_vectors(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, []), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1e300, -1e300]),
            (7, [0.5]), (None, [0.25, 1.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in [*CLASH, "x", "deviation", "n"]})
    got = whitening.whiten(odd).collect()
    assert [r["vec_id"] for r in got] == [4, 5, 5, 6, 7, None] and all(r["n"] == 5 and r["row"] == "clash" for r in got)
    small = whitening.whiten(odd.filter("vec_id in (4, 5, 7)")).collect()
    assert [int(r["deviation"]) for r in small if r["vec_id"] == 7] == [(3 * 128 - 384) ** 2 + 512 ** 2]
    for part, count in (("vec_id < 4", 0), ("vec_id = 4", 1), ("vec_id = 5", 2), ("false", 0)):
        rows = whitening.whiten(odd.filter(part)).collect()
        assert len(rows) == count and all(r["whitened"] == [] and r["identity_error"] is None for r in rows)


# 12: collocations

def phrases(rows, min_count, top, depth=4):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for m in range(1, min(depth, len(w) - i) + 1):
                    counts[lang or "und"][tuple(w[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s:s + m]] = max(longer[p[s:s + m]], a)
        rows = []
        for p, a in cand.items():
            if not longer[p] or 100 * longer[p] < 80 * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"budget": 300, "max_groups": 1 << 30, "filter_bits": 32768}, {"budget": 60, "max_groups": 64}])
def test_collocations(spark, settings):
    """Few and many groups, heavy prefixes of several words, a full filter."""
    docs = table(spark, SF_SMALL, "documents")
    got = collocations.collocations(docs, min_count=4, top=60, **settings).collect()
    assert sorted(map(tuple, got)) == phrases([(r["text"], r["lang"]) for r in docs.collect()], 4, 60)


def test_heavy_prefixes(spark):
    rows = [("a a a a a a a a", "x")] * 40 + [("a b, a b! c\x01 d \x00\x02 c\x01 d", None)] * 35 + [("A\tB", "und")] * 5 + [(None, "x")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("key", "n", "score")})
    for settings in ({}, {"budget": 10, "max_groups": 1 << 30}):
        got = collocations.collocations(df, **settings).collect()
        assert sorted(map(tuple, got)) == phrases(rows, 30, 2000)


def test_odd_collocations(spark):
    docs = odd_docs(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs, min_count=2).collect())) == phrases(rows, 2, 2000)
    assert collocations.collocations(odd_docs(spark, True)).collect() == []


def test_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    import pyarrow as pa
    text = "one two. three four, " * 40 + "x" * 300 + " y. z"
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    chunks = [c for _, c in collocations._chunks([batch])]
    words = [w for c in chunks for w in c.replace(b"\xff", b" ").split()]
    assert len(chunks) > 10 and [w.decode() for w in words] == re.findall("[^ .,]+", text)


# 13: suffix-array dedup

def repeated(rows, window=50):
    least = {}
    for doc, t in rows:
        for i in range(len(t) - window + 1) if doc is not None else ():
            least[t[i:i + window]] = min(doc, least.get(t[i:i + window], doc))
    out = []
    for doc, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1) if doc is not None else ():
            if least[t[i:i + window]] < doc:
                gone[i:i + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc or -1, len(t), int(gone.sum()), len(bwt_dedup.spans(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in
                  df.withColumn("sha", F.sha2("kept", 256)).collect())


def test_boundaries_are_common_prefixes():
    rnd = random.Random(2)
    for length in (1, 2, 3, 7, 50):
        sym = np.array([rnd.randrange(3) for _ in range(200)] + [0], np.uint16)
        order = bwt_dedup.sorted_suffixes(sym, length)
        turned = [tuple(np.roll(sym, -int(i))[:length]) for i in order]
        assert turned == sorted(turned)
        assert bwt_dedup.boundaries(sym, order, length).tolist() == [True] + [a != b for a, b in zip(turned, turned[1:])]


def test_repeats_of_random_rows():
    rnd = random.Random(3)
    for window in (3, 5, 8, 50):
        for alphabet in (b"ab", b"abcd", bytes(range(256))):
            rows = [(rnd.randrange(6), bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(window, window + 60)))) for _ in range(7)]
            rows += [(rnd.randrange(6), rows[0][1][2:] + rows[1][1]), rows[2]]
            least = {}
            for doc, t in rows:
                for i in range(len(t) - window + 1):
                    least[t[i:i + window]] = min(doc, least.get(t[i:i + window], doc))
            for (doc, t), found in zip(rows, bwt_dedup.repeats(rows, window)):
                assert found.tolist() == [least[t[i:i + window]] < doc for i in range(len(t) - window + 1)]


@pytest.mark.parametrize("settings", [{}, {"hot_docs": 3, "part_bytes": 1 << 15, "bucket_bytes": 1 << 13, "parts_of_owner": 1,
                                           "shard": 1 << 12}])
def test_bwt_dedup(spark, settings):
    """One shard and many; hot anchors, several copies of owners, keys over several loads."""
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert digests(bwt_dedup.bwt_dedup(docs, **settings)) == repeated(rows)


def test_odd_documents(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark).filter("doc_id = 5").withColumn("text", F.concat("text", F.lit(" and more")))) \
        .withColumns({c: F.lit("clash") for c in ("part", "kept", "removed", "n_bytes")})
    got = bwt_dedup.bwt_dedup(docs)
    assert digests(got) == repeated([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])
    assert "clash" == got.first()["part"]
    assert bwt_dedup.bwt_dedup(odd_docs(spark, True)).count() == 0


def test_removed_runs_fit_the_bytes(spark):
    docs = table(spark, SF_SMALL, "documents")
    for r in bwt_dedup.bwt_dedup(docs).filter("n_spans > 0").collect():
        raw, edges = r["text"].encode(), [0] + [x for s in r["removed"] for x in (s["low"], s["high"])] + [r["n_bytes"]]
        assert edges == sorted(edges) and b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])) == bytes(r["kept"])
        assert all(s["high"] - s["low"] >= 50 for s in r["removed"]) and len(r["removed"]) == r["n_spans"]
