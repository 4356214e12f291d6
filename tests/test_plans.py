"""Shapes of the physical plans that the scaling claims rest on."""

import re

import pytest

from courtline.operators.games import team_games
from courtline.operators.history import latest_games, recent_games
from courtline.operators.lookups import latest
from courtline.operators.matchups import pairings, seeded_field
from courtline.operators.rolling import trailing_stats
from courtline.sources import tables
from tests_plan import exchanges, plan


@pytest.fixture(scope="module")
def log(spark, small):
    return tables.game_log(spark, small)


def test_trailing_combines_before_each_shuffle(log):
    text = plan(trailing_stats(team_games(log, opponent=False)))
    assert len(exchanges(text)) == 2
    assert "partial_sum" in text and text.count("FileScan") == 1
    assert "w_num_ot" not in text and "num_ot#" not in text


def test_game_log_limits_lines_before_the_shuffle(spark, small):
    text = plan(tables.build_game_log(tables.table(spark, small, "lineitem"), tables.table(spark, small, "orders")))
    assert re.search(r"WindowGroupLimit.*Partial", text) and "partial_min" in text
    assert "l_discount" not in text and "l_shipdate" not in text


@pytest.mark.parametrize("build", [
    lambda facts: recent_games(facts, 5), lambda facts: latest_games(facts, 5),
    lambda facts: latest(facts, ["season", "team"], "day_num"),
])
def test_per_group_limits_apply_before_the_shuffle(log, build):
    assert re.search(r"WindowGroupLimit.*Partial", plan(build(team_games(log, stats=()))))


def test_pairings_join_on_the_field(log):
    text = plan(pairings(seeded_field(team_games(log, stats=()))))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert re.search(r"(HashJoin|SortMergeJoin) \[league", text)
