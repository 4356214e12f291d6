"""The as-of join against a plain search, and its plan."""

import random

import pytest

from courtline.operators.asof import asof_join
from tests_plan import exchanges, plan  # noqa: F401


def rows(rng, n, times):
    pick = lambda values: rng.choice(values)
    return [(k, pick([1, 1, 1, 1, 2, 3, None]), pick([*range(times), None]), pick("abc")) for k in range(n)]


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
@pytest.mark.parametrize("strict", [True, False])
def test_equals_plain_search(spark, strict, width):
    rng = random.Random(5)
    left, right = rows(rng, 150, 60), rows(rng, 60, 70)
    l = spark.createDataFrame(left, "id int, team int, day int, `value` string")
    r = spark.createDataFrame(right, "id int, team int, day int, elo string")
    got = asof_join(l, r, ["team"], "day", "day", {"elo": "elo", "id": "from_id"}, strict=strict, width=width)
    assert got.columns == ["id", "team", "day", "value", "elo", "from_id"]
    want = []
    for id_, team, day, value in left:
        before = [
            (d, e, k) for k, t, d, e in right
            if None not in (team, day, t, d) and t == team and (d < day if strict else d <= day)
        ]
        best = max(before, default=(None, None, None))
        want.append((id_, team, day, value, best[1], best[2]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_sides(spark):
    l = spark.createDataFrame([(1, 5)], "team int, day int")
    r = spark.createDataFrame([], "team int, day int, elo double")
    assert [tuple(x) for x in asof_join(l, r, ["team"], "day", "day", {"elo": "elo"}, width=3).collect()] == [(1, 5, None)]
    assert asof_join(l.limit(0), r, ["team"], "day", "day", {"elo": "elo"}).collect() == []


def test_one_shuffle_and_no_join_without_spans(spark):
    l = spark.range(100).selectExpr("id as team", "id as day")
    text = plan(asof_join(l, l.selectExpr("team", "day", "day as elo"), ["team"], "day", "day", {"elo": "elo"}))
    assert "Join" not in text and len(exchanges(text)) == 1
