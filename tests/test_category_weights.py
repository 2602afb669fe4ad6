"""Category probabilities: what crosses a shuffle."""

from quire.operators import models as MD
from quire.sources.fixtures import document_listings


def test_weights_that_carry_labels_give_the_same_probabilities(spark):
    weights = spark.createDataFrame([(k, t, float(1 + (i * j) % 3)) for i, k in enumerate("abcde") for j, t in enumerate("xyzuv") if (i + j) % 3],
                                    "k string, term string, weight double").unionByName(
        spark.createDataFrame([(None, "x", 1.0)], "k string, term string, weight double"))
    rows = spark.createDataFrame([("a", "p", 1), ("a", "q", None), ("b", "p", 2), ("c", "q", 2), ("d", None, 1), ("e", "q", 1), ("e", "q", 1),
                                  (None, "p", 1)], "k string, c1 string, c2 int")
    carrying = MD.with_labels(weights, rows, "k", ["c1", "c2"])
    for label in ("c1", "c2"):
        score = lambda w: sorted((str(r["k"]), str(r[label]), round(r["prob"], 9)) for r in
                                 MD.multinomial_nb(w, rows.select("k", label), "k", label).collect())
        assert score(carrying) == score(weights)


def test_titles_are_cut_before_texts_would_be_shuffled(spark, tmp_path):
    docs = [(i, f"title {i}\n" + "word " * 50, "en", "web", 260) for i in range(20)] + [(20, None, "de", "web", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = document_listings(spark, str(tmp_path)).select("sku_id", "title")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r["sku_id"], r["title"] or "") for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((f"D{i:09d}{lang}", (text or "").split("\n")[0]) for i, text, lang, _, _ in docs)
    above = plan[:plan.index("Join")]
    assert "substring_index" not in above and "substring_index" in plan
