"""The driver contract and a sample of oracle comparisons at sf0.001."""

import duckdb
import pytest

from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "entropy12" in df.columns


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 150


@pytest.mark.parametrize("name", ["j1_left_join_group_stats", "t13_char_ratio_block", "n4_tfidf",
                                  "a10_category_entropy", "m22_roc_auc", "w2_running_flag_block"])
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    from quire.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = sorted(tuple(r[c] for c in cols) for r in sdf.collect())
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    want = sorted(tuple(r[dcols.index(c)] for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["a5_group_word_totals_description", "a6_group_word_totals_log_description",
                                  "a7_group_length_stats_description", "a17_value_counts_key_parts",
                                  "t20_length_band_flags_words_description", "t21_length_band_flags_chars_description",
                                  "g3_one_hot_block_description", "g5_leave_one_out_encode_cat_title_len",
                                  "g5_leave_one_out_encode_conciseness"])
def test_description_and_label_parts_match_their_oracles(spark, name):
    test_query_matches_oracle(spark, name)
