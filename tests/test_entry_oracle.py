"""Driver contract and Spark-vs-DuckDB agreement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.oracle_check import TABLES, compare

FAST = ["scan_lines", "split_sentences", "token_freq", "most_common", "filter_special_words", "slice_rows",
        "rule_sentence_split", "char_index", "corpus_size_stats", "size_histogram", "head_mass",
        "embed_tokens_default", "split_train_val_test", "mask_tokens", "library_star", "centroids",
        "knn_join", "cv_silhouette", "cv_s_dbw", "cs_db", "ranksum_test", "vector_ngrams",
        "recon_r2"]


def test_contract_shapes():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 100 and df.columns == ["token", "cnt"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", FAST)
def test_query_matches_sql(spark, con, key):
    spd = entry.queries()[key](spark, SMALL).toPandas()
    opd = con.execute(entry.oracle_sql()[key]).fetchdf()
    assert compare(spd, opd) == []
