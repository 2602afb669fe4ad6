"""Queries: models, feature selection, SVD and category probabilities
(M2-M12, M14, M24, G6, N9). Iteratively fitted models have no SQL oracle;
``tests/test_models.py`` checks their properties. The queries fit the
operators' default sizes (rounds, trees, depths)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import blocks as BL
from quire.operators import models as MD
from quire.operators.folds import stratified_folds
from quire.operators.joins import bounded, materialize
from quire.operators.ngrams import char_ngrams, doc_freq, filtered_tfidf, kept_terms, n_rows, smooth_idf, term_counts, word_ngrams
from quire.operators.ordered import ordered_index
from quire.operators.random_trees import select_per_fold
from quire.operators.svd import singular_coordinates
from quire.plans.common import D, r
from quire.plans.oracle_views import views
from quire.plans.registry import query

LABEL = "conciseness"
N_FOLDS = 10
SEEDS = list(range(111, 1000, 111))
#: Most rounds of the early-stopped trees.
MAX_ROUNDS = 4000


def feature_columns():
    """Row-local title/description measures used as model features."""
    return {
        "title_len": X.char_len("title").cast("double"),
        "title_words": X.word_len_ws("title").cast("double"),
        "title_digits": X.digit_count("title").cast("double"),
        "title_upper": X.uppercase_count("title").cast("double"),
        "title_special": X.special_char_count("title").cast("double"),
        "title_dups": X.has_duplicate_words("title").cast("double"),
        "title_shapes": X.shape_nunique("title").cast("double"),
        "desc_len_log": F.log1p(X.char_len("short_description").cast("double")),
        "desc_words_log": F.log1p(X.word_len_ws("short_description").cast("double")),
        "desc_digits_log": F.log1p(X.digit_count("short_description").cast("double")),
    }


def model_tables(spark, sf_dir, label=LABEL):
    """(train with folds, test, feature names): labelled rows get the
    stratified folds, unlabelled rows are the test part."""
    d = D(spark, sf_dir)
    feats = feature_columns()
    rows = d.select("sku_id", label, *[v.alias(k) for k, v in feats.items()])
    folds = stratified_folds(d, "sku_id", label, N_FOLDS, 2017).select("sku_id", "fold")
    train = MD.assemble(rows.join(folds, "sku_id"), list(feats))
    test = MD.assemble(rows.where(F.col(label).isNull()), list(feats))
    return MD.by_rows(materialize(train)), MD.by_rows(materialize(test)), list(feats)


#: Listings that a title word of the sparse blocks needs.
BLOCK_MIN_DF = 3
HOT = ["category_lvl_1", "category_lvl_2"]


def feature_blocks(d):
    """The blocks that linear models stand on, in order: row-local measures,
    one-hot categories, TF-IDF of title words, a constant."""
    n = n_rows(d)
    words = term_counts(d.select("sku_id", X.tokenise_words("title").alias("tok")), "sku_id", F.col("tok"))
    weights = filtered_tfidf(materialize(words), "sku_id", n, BLOCK_MIN_DF, 1.0)
    return [BL.measure_block(d, "sku_id", feature_columns()), BL.one_hot_block(d, "sku_id", HOT),
            weights.withColumnRenamed("weight", "value"), BL.constant_block(d, "sku_id")]


def sparse_vectors(d, columns):
    """(columns of ``columns``, features): a sparse vector for each listing."""
    stacked = BL.stack_blocks(feature_blocks(d), "sku_id")
    index = BL.block_columns(stacked)
    return BL.block_vectors(d.select(*columns), BL.block_entries(stacked, index, "sku_id"), "sku_id", index.count())


def sparse_tables(spark, sf_dir, labels):
    """For each label (train with folds, test) on the sparse blocks; the
    vectors are built once for all labels."""
    d = D(spark, sf_dir)
    vectors = sparse_vectors(d, ["sku_id", *labels])
    out = {}
    for label in labels:
        folds = stratified_folds(d, "sku_id", label, N_FOLDS, 2017).select("sku_id", "fold")
        train = materialize(vectors.join(folds, "sku_id"))
        out[label] = (MD.by_gradients(train), MD.by_rows(materialize(vectors.where(F.col(label).isNull()))))
    return out


def _blocks_sql() -> str:
    return views("d") + f""",
m as (select sku_id, 0 as block, lpad(cast(i as varchar), 1, '0') as term, v as value
      from (select sku_id, unnest(features) as v, unnest(range(0, 11)) as i from ({_feature_sql()})) where i < 10 and v <> 0),
h as (select sku_id, 1 as block, 'category_lvl_1=' || category_lvl_1 as term, 1.0::double as value from d where category_lvl_1 is not null
      union all select sku_id, 1, 'category_lvl_2=' || category_lvl_2, 1.0 from d where category_lvl_2 is not null),
btc as (select sku_id, term, count(*) as tf from (select sku_id, unnest({TOKEN_SQL}) as term from d) group by sku_id, term),
bdf as (select term, count(*) as df from btc group by term having count(*) >= {BLOCK_MIN_DF}),
bw as (select sku_id, term, tf * (ln((1.0 + (select count(*) from d)) / (1.0 + df)) + 1.0) as x from btc join bdf using (term)),
w as (select sku_id, 2 as block, term, x / sqrt(sum(x * x) over (partition by sku_id)) as value from bw),
every as (select * from m union all select * from h union all select * from w union all select sku_id, 3, '1', 1.0 from d)
select sku_id, cast(dense_rank() over (order by block, term) - 1 as integer) as index, round(value, 6) as value from every"""


def _oof_query(spark, sf_dir, make_factory, label=LABEL, tables=None):
    train, test = tables or model_tables(spark, sf_dir, label)[:2]
    oof, tst = MD.oof_predict(train, test, "sku_id", label, "fold", N_FOLDS, make_factory(label), is_written=True)
    out = oof.select("sku_id", F.col("fold").cast("int"), "pred").unionByName(
        tst.select("sku_id", F.lit(-1).alias("fold"), "pred"))
    return out.select("sku_id", "fold", r("pred").alias("pred"))


@query("m2_out_of_fold_predict")
def m2_out_of_fold_predict(spark, sf_dir):
    """For both labels, out-of-fold logistic predictions on the sparse blocks
    for labelled rows (their fold) and fold-averaged predictions for
    unlabelled rows (fold -1)."""
    labels = (LABEL, "clarity")
    tables = sparse_tables(spark, sf_dir, labels)
    parts = [_oof_query(spark, sf_dir, MD.logistic, label, tables[label]).withColumn("label", F.lit(label)) for label in labels]
    return parts[0].unionByName(parts[1])


@query("m3_seed_bagging")
def m3_seed_bagging(spark, sf_dir):
    """Boosted trees whose rounds see a seeded sample of 80 % of the rows and
    half of the features, averaged over nine seeds: out of fold for labelled
    rows, over all fold models for the others."""
    train, test, _ = model_tables(spark, sf_dir)
    oof, tst = MD.bagged(train, test, "sku_id", LABEL, "fold", N_FOLDS, MD.gbt_classifier(LABEL, subsample=0.8, colsample=0.5), SEEDS)
    out = oof.withColumn("part", F.lit("train")).unionByName(tst.withColumn("part", F.lit("test")))
    return out.select("sku_id", "part", r("pred").alias("pred"))


def _fit_all(spark, sf_dir, factory, clip=False):
    train, test, names = model_tables(spark, sf_dir)
    model = factory(train, names)(7, train.count()).fit(MD.by_gradients(train))
    out = MD.positive_score(model.transform(train.unionByName(test.withColumn("fold", F.lit(-1)))))
    if clip:
        out = out.withColumn("pred", F.least(F.greatest("pred", F.lit(0.0)), F.lit(1.0)))
    return out.select("sku_id", r("pred").alias("pred"))


@query("m4_logistic_regression")
def m4_logistic_regression(spark, sf_dir):
    """L2 logistic regression on the sparse blocks, fitted on all labelled
    rows, scored on all rows."""
    train, test = sparse_tables(spark, sf_dir, (LABEL,))[LABEL]
    model = MD.logistic(LABEL)(7, train.count()).fit(train)
    out = MD.positive_score(model.transform(train.select("sku_id", "features").unionByName(test.select("sku_id", "features"))))
    return out.select("sku_id", r("pred").alias("pred"))


@query("m5_l1_logistic")
def m5_l1_logistic(spark, sf_dir):
    """L1-penalised logistic regression."""
    return _fit_all(spark, sf_dir, lambda tr, names: MD.l1_logistic(LABEL))


NB_SQL = """
{pre}_cls as (select y, count(*) as n from {pre}_y group by y),
{pre}_ct as (select term, y, sum(weight) as w from {pre}_w join {pre}_y using (sku_id) group by term, y),
{pre}_norm as (select y, ln(n / (select count(*) from {pre}_y)) as prior,
                      (select coalesce(sum(w), 0) from {pre}_ct t where t.y = c.y)
                      + (select count(distinct term) from {pre}_ct) as norm from {pre}_cls c),
{pre}_s as (select sku_id, y, prior + coalesce((select sum(x.weight * ln((coalesce(t.w, 0) + 1) / norm))
                from {pre}_w x left join {pre}_ct t on t.term = x.term and t.y = k.y where x.sku_id = r.sku_id), 0) as s
            from (select sku_id from {pre}_y) r, {pre}_norm k),
{pre}_p as (select sku_id, y, exp(s - max(s) over (partition by sku_id)) as e from {pre}_s),
{pre}_prob as (select sku_id, y, e / sum(e) over (partition by sku_id) as prob from {pre}_p)"""
TOKEN_SQL = "regexp_extract_all(lower(title), '[\\p{{L}}\\p{{Mn}}\\p{{Nd}}_]{{2,}}')".replace("{{", "{").replace("}}", "}")


@query("m6_naive_bayes", oracle=views("d") + f""",
m_y as (select sku_id, conciseness as y from d where conciseness is not null),
m_w as (select sku_id, term, count(*) as weight from (select sku_id, unnest({TOKEN_SQL}) as term from d
        where conciseness is not null) group by sku_id, term),""" + NB_SQL.replace("{pre}", "m") + """
select sku_id, round(prob, 6) as pred from m_prob where y = 1""")
def m6_naive_bayes(spark, sf_dir):
    """Multinomial naive Bayes on the word counts of the title."""
    d = D(spark, sf_dir).where(F.col(LABEL).isNotNull()).select("sku_id", LABEL, X.tokenise_words("title").alias("tok"))
    weights = term_counts(d, "sku_id", F.col("tok")).select("sku_id", "term", F.col("tf").cast("double").alias("weight"))
    out = MD.multinomial_nb(materialize(weights), d, "sku_id", LABEL)
    return out.where(F.col(LABEL) == 1).select("sku_id", r("prob").alias("pred"))


@query("m7_ridge_regression")
def m7_ridge_regression(spark, sf_dir):
    """Ridge regression (alpha = 1) of the label on the features."""
    def factory(tr, names):
        stats = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(LABEL).cast("double")).alias("s")).first()
        return MD.ridge(LABEL, stats["s"] or 1.0)
    return _fit_all(spark, sf_dir, factory)


@query("m8_gbt_classifier")
def m8_gbt_classifier(spark, sf_dir):
    """Gradient-boosted trees, out of fold."""
    return _oof_query(spark, sf_dir, MD.gbt_classifier)


@query("m9_gbt_regressor_clipped")
def m9_gbt_regressor_clipped(spark, sf_dir):
    """Boosted regression trees, predictions clipped to [0, 1]."""
    return _fit_all(spark, sf_dir, lambda tr, names: MD.gbt_regressor(LABEL), clip=True)


@query("m10_random_forest")
def m10_random_forest(spark, sf_dir):
    """Random forest with entropy impurity."""
    return _fit_all(spark, sf_dir, lambda tr, names: MD.random_forest(LABEL))


@query("m10_extra_trees")
def m10_extra_trees(spark, sf_dir):
    """1,000 extra-random trees of at most 18 levels, fitted on all labelled
    rows, scored on all rows."""
    return _fit_all(spark, sf_dir, lambda tr, names: MD.extra_trees(LABEL))


@query("m11_multilayer_perceptron")
def m11_multilayer_perceptron(spark, sf_dir):
    """One hidden layer of 128 units, L-BFGS, 5 iterations."""
    return _fit_all(spark, sf_dir, lambda tr, names: MD.mlp(LABEL, len(names)))


@query("m12_importance_select")
def m12_importance_select(spark, sf_dir):
    """Forest importances per feature, and whether the feature is kept
    (importance >= mean)."""
    train, _, names = model_tables(spark, sf_dir)
    kept, imp = MD.importance_select(train, LABEL, names)
    rows = [(n, float(v), int(i in kept), i) for i, (n, v) in enumerate(zip(names, imp))]
    table = spark.createDataFrame(rows, "feature string, importance double, kept int, index int")
    return table.select("feature", r("importance").alias("importance"), "kept", "index")


@query("m12_select_per_fold")
def m12_select_per_fold(spark, sf_dir):
    """For each fold, features selected by 500 extra-random trees of six
    levels fitted on the other folds, and out-of-fold logistic predictions of
    models that are fitted on the kept slice alone; ``n_kept`` features."""
    train, _, _ = model_tables(spark, sf_dir)
    kept = [k for k, _ in select_per_fold(train, LABEL, "fold", N_FOLDS)]
    out = MD.oof_selected(train, "sku_id", LABEL, "fold", kept, MD.logistic(LABEL))
    sizes = F.array(*[F.lit(len(k)) for k in kept])
    return out.select("sku_id", F.col("fold").cast("int"), r("pred").alias("pred"), sizes[F.col("fold").cast("int")].alias("n_kept"))


@query("m14_early_stopping")
def m14_early_stopping(spark, sf_dir):
    """Boosted trees of at most 4,000 rounds, stopped on a validation fold after
    33 rounds without gain: scores of all labelled rows by the trees of the
    best round, plus their number."""
    train, _, _ = model_tables(spark, sf_dir)
    data = train.withColumn("is_val", F.col("fold") == 0)
    model = MD.gbt_classifier(LABEL, max_iter=MAX_ROUNDS, validation="is_val")(5, 0).fit(data)
    out = MD.positive_score(model.transform(data))
    return out.select("sku_id", r("pred").alias("pred"), F.lit(model.getNumTrees).alias("n_trees"))


def _feature_sql() -> str:
    from quire.plans import q_measures  # noqa: F401  its oracles give the measures
    from quire.plans.registry import REGISTRY
    names = ("t1_char_len", "t2_word_len_ws", "t5_digit_count", "t6_case_counts", "t7_special_char_count",
             "t17_has_duplicate_words", "t16_shape_nunique")
    joined = " join ".join(f"({REGISTRY[n].oracle}) q{i}" + (" using (sku_id)" if i else "") for i, n in enumerate(names))
    plain = ("title_len", "title_word_len", "title_digits", "title_upper", "title_special", "title_has_duplicates",
             "title_shape_nunique")
    values = [f"cast({c} as double)" for c in plain] + [f"round(ln(1 + {c}), 6)" for c in ("desc_len", "desc_word_len", "desc_digits")]
    return f"select sku_id, [{', '.join(values)}, 1.0::double] as features from {joined}"


@query("m24_assemble_features", oracle=_feature_sql())
def m24_assemble_features(spark, sf_dir):
    """Ordered feature blocks assembled into one vector with a trailing
    constant 1.0 (shown as an array)."""
    d = D(spark, sf_dir)
    feats = feature_columns()
    rows = d.select("sku_id", *[v.alias(k) for k, v in feats.items()])
    out = MD.assemble(rows, list(feats), add_const=True).select("sku_id", vector_to_array("features").alias("features"))
    return out.select("sku_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query("m24_sparse_blocks", oracle=_blocks_sql())
def m24_sparse_blocks(spark, sf_dir):
    """Measures, one-hot categories, TF-IDF of title words and a constant side
    by side, one sparse vector for each listing; shown by its entries."""
    vectors = sparse_vectors(D(spark, sf_dir), ["sku_id"])
    return BL.stored_entries(vectors, "sku_id").select("sku_id", "index", r("value").alias("value"))


def _category_sql(level: int) -> str:
    p = f"g{level}"
    return f""",
{p}_y as (select sku_id, category_lvl_{level} as y from d where category_lvl_{level} is not null),
{p}_w as (select * from w),""" + NB_SQL.replace("{pre}", p)


@query("g6_category_membership_probabilities", oracle=views("d") + f""",
toks as (select sku_id, {TOKEN_SQL} as t from d),
grams as (select sku_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from toks),
tc as (select sku_id, term, count(*) as tf from grams group by sku_id, term),
df as (select term, count(*) as df from tc group by term
       having count(*) >= 2 and count(*) <= 0.9 * (select count(*) from d)),
raw as (select sku_id, term, tf * (ln((1.0 + (select count(*) from d)) / (1.0 + df)) + 1.0) as x from tc join df using (term)),
w as (select sku_id, term, x / sqrt(sum(x * x) over (partition by sku_id)) as weight from raw)"""
       + _category_sql(1) + _category_sql(2) + """
select 1 as level, sku_id, y as category, round(prob, 5) as prob from g1_prob
union all select 2, sku_id, y, round(prob, 5) from g2_prob""")
def g6_category_membership_probabilities(spark, sf_dir):
    """Class probabilities of categories 1 and 2 from the TF-IDF (smooth idf,
    unit rows) of title word 1-2-grams (min_df 2, max_df 0.9) with multinomial
    naive Bayes, long form (level, sku_id, category, prob); scored in-sample."""
    d = D(spark, sf_dir)
    grams = (d.select("sku_id", X.tokenise_words("title").alias("tk"))
             .select("sku_id", word_ngrams(F.col("tk"), 1, 2).alias("grams")))
    n = n_rows(d)
    tc = materialize(term_counts(grams, "sku_id", F.col("grams")))
    labels = ["category_lvl_1", "category_lvl_2"]
    weights = materialize(MD.with_labels(filtered_tfidf(tc, "sku_id", n, 2, 0.9), d, "sku_id", labels))
    parts = [MD.multinomial_nb(weights, d.select("sku_id", k), "sku_id", k).select(
        F.lit(level).alias("level"), "sku_id", F.col(k).alias("category"), F.round("prob", 5).alias("prob"))
        for level, k in enumerate(labels, 1)]
    return parts[0].unionByName(parts[1])


SVD_K = 15


@query("n9_truncated_svd")
def n9_truncated_svd(spark, sf_dir):
    """15 leading singular directions of the character 2-5-gram TF-IDF (N4
    weights; grams of at least 3 rows) of the titles; each listing's
    coordinates (rows of U * S). Rows and grams are numbered by ordered
    indexes, so neither is hashed."""
    d = D(spark, sf_dir)
    n = n_rows(d)
    tc = materialize(term_counts(d.select("sku_id", char_ngrams("title", 2, 5).alias("grams")), "sku_id", F.col("grams")))
    grams = materialize(ordered_index(smooth_idf(kept_terms(doc_freq(tc), n, 3, 1.0), n), ["term"], name="col"))
    listings = materialize(ordered_index(d.select("sku_id"), ["sku_id"], name="row"))
    width = grams.count()
    entries = tc.join(bounded(grams, cheap=True), "term").select(
        "sku_id", F.col("col").cast("int").alias("index"), (F.col("tf").cast("double") * F.col("idf")).alias("value"))
    coords, size = singular_coordinates(listings.join(BL.unit_rows(entries, "sku_id"), "sku_id"), "row", width, min(SVD_K, width))
    out = listings.join(coords, "row", "left")
    return out.select("sku_id", *[F.coalesce(r(F.col("coords")[i]), F.lit(0.0)).alias(f"svd_{i}") for i in range(size)])
