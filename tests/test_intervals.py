"""The interval join against plain comparison, and how many rows it joins."""

import random

import pytest
from pyspark.sql import functions as F

from courtline.operators.lookups import covering
from tests_plan import plan


@pytest.mark.parametrize("how", ["left", "inner"])
def test_equals_plain_comparison(spark, how):
    rng = random.Random(3)
    day = lambda: rng.choice([None, *range(-40, 90)])
    team = lambda: rng.choice([1, 1, 1, 2, 3, None])
    rows = [(n, team(), day()) for n in range(120)] + [(500, 1, 7), (501, 1, 7)]
    spans = [(team(), day(), day(), f"c{n}") for n in range(80)]
    spans += [(1, d, d + w, "w") for d in (-3, 0, 1, 5, 8) for w in (0, 1, 2, 6, 7, 8, 15)] + [(2, -5, 70, "same")] * 2
    l = spark.createDataFrame(rows, "id int, team int, day int")
    r = spark.createDataFrame(spans, "team int, first_day int, last_day int, coach string")
    got = covering(l, r, ["team"], "day", "first_day", "last_day", how)
    assert got.columns == ["id", "team", "day", "coach"]
    want = []
    for id_, t, d in rows:
        found = [c for k, a, b, c in spans if None not in (t, d, k, a, b) and k == t and a <= d <= b]
        want += [(id_, t, d, c) for c in found or ([None] if how == "left" else [])]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_sides_and_clashing_names(spark):
    l = spark.createDataFrame([(1, 5)], "team int, day int")
    r = spark.createDataFrame([], "team int, first_day int, last_day int, coach string")
    assert [tuple(x) for x in covering(l, r, ["team"], "day", "first_day", "last_day").collect()] == [(1, 5, None)]
    assert covering(l.limit(0), r, ["team"], "day", "first_day", "last_day").collect() == []
    with pytest.raises(ValueError):
        covering(l.withColumn("COACH", F.lit("x")), r, ["team"], "day", "first_day", "last_day")


def test_ten_thousand_tenures_of_one_team(spark):
    """Each day is covered by few of them; the plan compares none but those."""
    r = spark.range(10_000).selectExpr("1 as team", "id * 10 as first_day", "id * 10 + 14 as last_day", "id as coach")
    l = spark.range(50_000).selectExpr("1 as team", "id * 2 as day")
    got = covering(l, r, ["team"], "day", "first_day", "last_day", "inner")
    assert got.count() == sum(len([i for i in (d // 10, d // 10 - 1) if 0 <= i < 10_000 and i * 10 <= d <= i * 10 + 14]) for d in range(0, 100_000, 2))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "level" in text


def test_pairs_are_not_shuffled_again(spark):
    """Each side is moved once, and few long intervals among short ones are cut to no more blocks than there are intervals."""
    r = spark.range(1000).selectExpr("1 as team", "id as first_day", "if(id = 3, 1000000, id + 3) as last_day", "id as coach")
    l = spark.range(-3, 2000).selectExpr("1 as team", "id as day", "id")
    got = covering(l.hint("merge"), r, ["team"], "day", "first_day", "last_day")
    assert plan(got).count("Exchange hashpartitioning") <= 2
    assert got.filter("coach is not null").count() == 999 * 4 + 1997
    assert got.filter("coach is null").count() == 3
