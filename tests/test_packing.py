"""Packed counts and rounding: the same values in less space and time."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from courtline.catalog.modelling import bounds, flat_rows, season_range, sequence_rows, sequences
from courtline.catalog.shaping import rounded
from courtline.functions.rounding import half_up_sql
from courtline.operators.games import team_games
from courtline.operators.packing import WORD, Packing
from courtline.plans import models, recurrent
from courtline.plans.sequences import encoded, indexed_facts, ordered_steps, sequence_games, sequence_steps, team_vocabulary
from courtline.session import SETTINGS, settled
from courtline.sources import files, tables


def test_packed_columns_come_back(spark):
    rng = random.Random(3)
    lows = {"a": -7, "b": -(2**31), "c": 0, "d": 5, "e": -3}
    highs = {"a": 90, "b": 2**31 - 1, "c": 2**31 - 1, "d": 5, "e": 2**30}
    rows = [(i, *[rng.choice((None, lows[c], highs[c], rng.randint(lows[c], highs[c]))) for c in lows]) for i in range(400)]
    table = spark.createDataFrame(rows, "id int, a int, b int, c int, d int, e int")
    packing = Packing.fit({c: (lows[c], highs[c]) for c in lows})
    assert all(at + bits <= WORD for _, at, bits, _ in packing.places.values())
    back = packing.pack(table).selectExpr("id", *[f"{packing.value('', c)} as {c}" for c in lows])
    assert back.dtypes == table.dtypes
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows


def test_histories_are_narrow_and_say_the_same(spark, small):
    games, fitted, packing = sequences(spark, small)
    # 26 counts and the opponent's score were 27 fields of a game; now they are a few longs.
    fields = games.schema["recent_1"].dataType.elementType.fieldNames()
    assert set(fields) == {"day_num", "game_id", "opp", *packing.words()} and len(packing.words()) <= 4
    wide = sequence_games(tables.game_log(spark, small), facts=team_games(tables.game_log(spark, small)))
    for limits in (None, bounds(spark, small)):
        packed, plain = sequence_steps(games, limits, packing), sequence_steps(wide, limits)
        assert packed.dtypes == plain.dtypes and plain.count() > 0
        assert packed.exceptAll(plain).count() == plain.exceptAll(packed).count() == 0
    a, b = ordered_steps(games, fitted, packing), ordered_steps(wide, fitted)
    assert a.select("game_id", "steps").exceptAll(b.select("game_id", "steps")).count() == 0


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(5)
    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, 1e300, 2.5e9, 0.0078125, -0.0078125, 1.0000005, 0.1234565, -4e-7, 2.675, 1.005]
    values += [rng.randint(-60, 60) / rng.randint(1, 128) for _ in range(3000)]
    values += [round(rng.uniform(-9, 9), 7) for _ in range(3000)] + [rng.uniform(-3000, 3000) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (3, 4, 6):
        both = table.selectExpr("v", f"{half_up_sql('v', places)} as a", f"round(v, {places}) as b")
        assert both.where("not (a <=> b) or cast(a as string) <> cast(b as string)").collect() == []
    assert "CASE" in rounded(table, ["v"])._jdf.queryExecution().analyzed().toString().upper()


def test_long_projections_can_be_compiled(spark, small):
    limit = "spark.sql.codegen.hugeMethodLimit"
    other = spark.newSession()
    other.conf.unset(limit)
    assert settled(other).conf.get(limit) == SETTINGS[limit]
    other.conf.set(limit, "9000")
    assert settled(other).conf.get(limit) == "9000"


def test_season_write_sorts_nothing(spark, tmp_path):
    rows = spark.range(500).select("id", (F.col("id") % 9 + 1990).cast("int").alias("season"))
    path, setting = str(tmp_path / "seasons"), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    files.write_season_partitions(rows, path, "parquet")
    files.write_season_partitions(rows.where("season = 1995"), path, "parquet")
    assert spark.conf.get(setting) == before
    back = files.read_seasons(spark, path, 1980, 2020).select("id", F.col("season").cast("int").alias("season"))
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0


def test_flat_vectors_are_made_from_what_is_stored(spark, small):
    assert set(sequence_rows(spark, small).columns) == {"game_id", "label", "slots", "steps"}
    games, teams = tables.game_log(spark, small), tables.teams(spark, small)
    size, seasons = teams.count(), season_range(spark, small)
    facts = indexed_facts(team_games(games), team_vocabulary(teams), size)
    want = encoded(sequence_games(games, facts=facts), bounds(spark, small), (seasons[0], seasons[1]), 366, size)[0]
    vectors = lambda rows: {r.game_id: (r.label, r.features) for r in rows.select("game_id", "label", "features").collect()}
    assert vectors(flat_rows(spark, small)) == vectors(want)


def test_trees_are_grown_by_as_many_tasks_as_there_are_cores_for(spark, monkeypatch):
    class Trees:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    monkeypatch.setattr(models, "GBTRegressor", Trees)
    columns = [c for c in models.FEATURES if not c.endswith("coach_index")]
    rows = spark.range(300).select(
        F.col("id").alias("game_id"), *[F.lit(1.0).alias(c) for c in columns], F.lit("a").alias("w_coach"),
        F.lit("b").alias("l_coach"), F.lit(70).alias("w_score"), F.lit(60).alias("l_score"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        fitted = models.ScoreModels.fit(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert fitted.w == fitted.l == 2 * spark.sparkContext.defaultParallelism


def test_steps_are_laid_out_from_a_slice_of_a_batch():
    network = recurrent.Network(2, 3, (4,), ("tanh",))
    steps = pa.array([[float(6 * i + k) for k in range(6)] for i in range(9)], pa.list_(pa.float64())).slice(4, 3)
    assert recurrent._table(steps, network).tolist() == np.arange(24.0, 42.0).reshape(3, 2, 3).tolist()
