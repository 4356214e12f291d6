"""Every registered query with SQL agrees with it; the others run."""

import pytest

import __spark_entry__ as contract
from check import compare, connect
from courtline.catalog import QUERIES as CATALOG

# What trained models say; their *_error and *_coverage queries and test_models hold them to account.
NO_SQL = {
    "m7_score_regression", "m8_round_scores", "m9_winner_classifier", "m9_sequence_model", "m9_all_pairs_scores",
    "m10_search_leaderboard", "m10_search_generations",
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(set(CATALOG)))
def test_query(name, spark, con, small):
    ok, note = compare(name, spark, con, small)
    assert ok, note


def test_only_predictions_lack_sql():
    assert set(CATALOG) - set(contract.oracle_sql()) == NO_SQL


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[:4] == ["season", "day_num", "team", "outcome"] and rows.limit(1).count() == 1
