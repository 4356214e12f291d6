"""Vocabularies, splits, encodings and model plans."""

import random

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from courtline.catalog.modelling import bounds
from courtline.operators.games import team_games
from courtline.operators.indexing import dense_index, frequency_index, hash_split, with_index
from courtline.plans import models as m
from courtline.plans import sequences as q
from courtline.sources import tables


def test_frequency_index_equals_string_indexer(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aabbbccdeé"),) for _ in range(400)]
    df = spark.createDataFrame(rows, "v string")
    labels = StringIndexer(inputCol="v", outputCol="i", stringOrderType="frequencyDesc").fit(df).labels
    got = {r.v: r["index"] for r in frequency_index(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(labels)}


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_dense_index_has_no_gaps(spark, partitions):
    values = spark.range(0, 500).select((F.col("id") * 7919 % 100003).alias("v"))
    got = [(r.v, r["index"]) for r in dense_index(values, [F.col("v")], partitions=partitions).collect()]
    assert sorted(got) == [(v, i) for i, v in enumerate(sorted(v for v, _ in got))]


def test_unknown_values(spark):
    known = spark.createDataFrame([("a", 0), ("b", 1)], "v string, index int")
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert {r.c: r.i for r in with_index(df, known, "v", "c", "i", 2).collect()} == {"a": 0, "z": 2, None: 2}


def test_split_is_stable_and_complete(spark):
    df = spark.range(0, 20000)
    train, test = hash_split(df, "id", 17)
    again = hash_split(df.repartition(13), "id", 17)[1]
    assert train.count() + test.count() == 20000
    assert 0.28 < test.count() / 20000 < 0.32
    assert test.exceptAll(again).count() == 0


@pytest.fixture(scope="module")
def encoded(spark, small):
    games = tables.game_log(spark, small)
    teams = tables.teams(spark, small)
    size = teams.count()
    facts = q.indexed_facts(team_games(games), q.team_vocabulary(teams), size)
    rows = q.sequence_games(games, 2, facts)
    return q.encoded(rows, bounds(spark, small), (1995, 2001), 366, size, n=2)[0], size


def test_encoding_width_and_content(encoded):
    rows, size = encoded
    # A slot for values outside each vocabulary is part of its width.
    want = (7 + 1) + 2 * (2 * 367 + 4 * (size + 2)) + 2 * 52
    some = rows.select("features", "stats").head(5)
    assert some and all(r.features.size == want and r.stats.size == 104 for r in some)
    for r in some:
        hot = r.features.toArray()[: want - 104]
        assert hot.sum() == 1 + 2 * 6 and set(hot) == {0.0, 1.0}


def test_every_team_has_a_slot_of_its_own(spark, small):
    facts = team_games(tables.game_log(spark, small), stats=())
    vocabulary = q.team_vocabulary(tables.teams(spark, small))
    got = q.indexed_facts(facts, vocabulary, tables.teams(spark, small).count()).select("team", "team_slot").distinct()
    assert got.count() == got.select("team").distinct().count() == got.select("team_slot").distinct().count()


def test_classifier_learns_a_plain_rule(spark):
    rng = random.Random(1)
    rows = [(float(x), int(x > 0)) for x in (rng.uniform(-1, 1) for _ in range(300))]
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, label int"))
    model = m.fit_winner_classifier(df, penalty=0.0)
    scored = m.lower_win_probability(model, df)
    assert m.accuracy(scored) > 0.95
    assert scored.filter("(p_lower > 0.5) <> (prediction = 1)").count() == 0


def test_score_models_are_seeded_and_leave_gaps_null(spark):
    rng = random.Random(2)
    columns = [c.replace("_index", "") if "coach" in c else c for c in m.FEATURES]
    rows = [
        tuple([2000, i % 100] + [v for _ in "wl" for v in ([rng.choice("xyz")] + [rng.random() for _ in range(12)])] + [60 + i % 30, 50 + i % 20])
        for i in range(200)
    ]
    types = [f"{c} {'string' if 'coach' in c else 'int' if c in ('season', 'day_num') else 'double'}" for c in columns]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(["game_id long", *types, "w_score int", "l_score int"]))
    a, b = (
        m.ScoreModels.fit(d, depth=3, rounds=3).score(df).select("game_id", "w_pred", "l_pred").collect()
        for d in (df, df.repartition(11))
    )
    assert sorted(a) == sorted(b)
    holes = df.withColumn("w_elo", F.lit(None).cast("double"))
    scored = m.ScoreModels.fit(df, depth=3, rounds=3).score(holes)
    assert scored.count() == 200 and scored.filter("w_pred is not null").count() == 0
    assert m.rmse(m.ScoreModels.fit(df, depth=5, rounds=10).score(df), "w_score", "w_pred") < 9


def test_leaderboard_puts_nan_last(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.4), (3, 0.9), (4, None)], "candidate int, score double")
    assert [r.candidate for r in m.leaderboard(df, 2).collect()] == [3, 2]
