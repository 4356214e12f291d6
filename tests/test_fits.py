"""What the fits of the flat classifier and of the recurrent networks read and compute."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from courtline.catalog import modelling
from courtline.plans import recurrent
from courtline.plans import sequences as q
from courtline.schemas import STATS

WIDTH = 4 * len(STATS)


def _slot_rows(spark, odd=False):
    rng = np.random.default_rng(5)
    rows = []
    for key in range(40):
        slots = [int(v) for v in (rng.integers(0, 2), *rng.integers(0, 7, 30))]
        if odd and key < 3:
            slots[4] = (-1, 99, 9)[key]
        steps = [float(v) for v in rng.uniform(0, 1, q.HISTORY * WIDTH)]
        steps[key % 5] = 0.0
        rows.append((key, key % 2, slots, steps))
    return spark.createDataFrame(rows, "game_id long, label int, slots array<int>, steps array<double>")


def test_encoded_slots_are_the_encoders_vectors_without_names(spark):
    rows = _slot_rows(spark, odd=True)
    newest = f"flatten(transform(sequence(4, 0, -1), i -> slice(steps, i * {WIDTH} + 1, {WIDTH})))"
    want, _ = q._one_hot(rows.withColumn("stats", array_to_vector(F.expr(newest))), (0, 1), 366, 8, q.HISTORY)
    got = q.encoded_slots(rows, (0, 1), 366, 8)
    assert not got.schema["features"].metadata and want.schema["features"].metadata
    vectors = {r.game_id: r.features for r in got.collect()}
    assert len(vectors) == 40 and all(vectors[r.game_id] == r.features for r in want.collect())


@pytest.mark.parametrize("column", ["slots", "steps"])
def test_nulls_make_no_vector(spark, column):
    rows = _slot_rows(spark)
    broken = rows.withColumn(column, F.expr(f"transform({column}, (v, i) -> if(i = 3, null, v))"))
    with pytest.raises(Exception, match="slot is null|[Ss]parse vectors require"):
        q.encoded_slots(broken, (0, 1), 366, 8).select(vector_to_array("features")).collect()


def test_counts_named_one_by_one_are_those_of_all_steps(spark):
    bounds = {s: (0, 9 + i) for i, s in enumerate(STATS)}
    game = ", ".join(f"'{p}{s}', cast((id * {3 + i} + k) % 10 as int)" for p in ("", "opp_") for i, s in enumerate(STATS))
    side = f"transform(sequence(1, 5), k -> named_struct('day_num', cast(k as int), {game}))"
    rows = spark.range(6).selectExpr("id as game_id", f"{side} as recent_1", f"if(id = 4, null, {side}) as recent_2")
    want = {r.game_id: r.steps for r in q.ordered_steps(rows, bounds).collect()}
    assert {r.game_id: r.steps for r in q.ordered_steps(rows, bounds, n=5).collect()} == want
    assert want[4] is None and len(want[0]) == 5 * WIDTH


def test_a_network_is_given_rows_side_by_side():
    x = np.arange(24.0).reshape(4, 3, 2)
    laid = recurrent.laid_out(x)
    assert laid.shape == (3, 2, 4) and laid.flags.c_contiguous and laid[1, 0].tolist() == x[:, 1, 0].tolist()
    network = recurrent.Network(3, 2, (4,), ("softmax",)).started(1)
    label = np.array([0.0, 1, 1, 0])
    gradient, loss = network.gradient(x, label)
    one = [network.gradient(x[k : k + 1], label[k : k + 1]) for k in range(4)]
    assert np.allclose(gradient, sum(g for g, _ in one)) and np.isclose(loss, sum(v for _, v in one))


def test_scores_come_with_their_rows(spark):
    network = recurrent.Network(2, 1, (3,), ("tanh",)).started(1)
    steps = [[float(k), 1.0] if k % 3 else None for k in range(700)]
    rows = spark.createDataFrame(list(enumerate(steps)), "key long, steps array<double>").coalesce(1)
    got = {r.key: r.p for r in recurrent.lower_wins(rows, [network, network]).collect()}
    assert all((got[k] is None) == (s is None) for k, s in enumerate(steps))
    assert all(np.allclose(got[k], network.probability(np.array(s).reshape(1, 2, 1))[0]) for k, s in enumerate(steps) if s)


def test_upcoming_rounds_are_scored_by_models_of_all_games(spark, monkeypatch):
    rows = spark.range(100).withColumnRenamed("id", "game_id")
    monkeypatch.setattr(modelling, "written_rows", lambda spark, sf: rows)
    monkeypatch.setattr(modelling, "kept_model", lambda spark, sf, name, build: build())
    monkeypatch.setattr(modelling.m.ScoreModels, "fit", staticmethod(lambda rows: rows.count()))
    assert modelling.round_models(spark, "none") == 100 > modelling.score_models(spark, "none") > 50
