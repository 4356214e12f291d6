"""Ratings kept up to date by a stream equal those of one run, however the games were cut into files."""

import random

import pytest

from courtline.operators import ratings as R
from courtline.storage import new_path
from courtline.streaming import rating_runs as S
from test_ratings import by_game, close, games, random_games
from tests_plan import plan


def arrive(spark, rows, folder, n):
    games(spark, rows).coalesce(1).write.parquet(f"{folder}/{n:03d}")


def run(spark, folder, root):
    # One batch per call, as files come to be there.
    query = S.rate_available(spark, f"{folder}/*", root, f"{root}-checkpoint")
    query.awaitTermination()
    assert query.exception() is None


def whole(spark, rows):
    return by_game(R.rate_games(games(spark, rows)))


@pytest.mark.parametrize("order", ["in order", "late days", "shuffled"])
def test_equals_one_run(spark, order):
    rows = random_games(11, leagues=2, seasons=(2001, 2003), days=6, per_day=5, teams=10)
    # A team of its own in the last season, so that newcomers open late.
    rows.append((90_000, "L0", 2003, 4, 77, 80, 1, 70, "H"))
    rows.sort(key=lambda r: (r[2], r[3]))
    rng = random.Random(order)
    if order == "shuffled":
        rng.shuffle(rows)
    cut = len(rows) // 3
    parts = [rows[:cut], rows[cut : 2 * cut], rows[2 * cut :]]
    if order == "late days":
        parts = [parts[0], parts[2], parts[1]]
    folder, root = new_path(spark, "arriving"), new_path(spark, "rated")
    seen = []
    for n, part in enumerate(parts):
        arrive(spark, part, folder, n)
        run(spark, folder, root)
        seen += part
        close(by_game(S.live_history(spark, root)), whole(spark, seen))


def test_days_in_order_rate_only_themselves(spark):
    root = new_path(spark, "rated")
    S.absorb(spark, root, games(spark, [(1, "a", 2001, 1, 1, 9, 2, 8, "N"), (2, "b", 2001, 1, 1, 9, 2, 8, "N")]), 0)
    S.absorb(spark, root, games(spark, [(3, "a", 2001, 2, 1, 9, 2, 8, "N")]), 1)
    assert [r.game_id for r in spark.read.parquet(f"{root}/history/batch=1").collect()] == [3]


def test_repeated_batches_and_games(spark):
    rows = [(1, "a", 2001, 1, 1, 9, 2, 8, "N"), (2, "a", 2001, 2, 1, 9, 3, 8, "A")]
    root = new_path(spark, "rated")
    S.absorb(spark, root, games(spark, rows), 0)
    S.absorb(spark, root, games(spark, rows + rows + [(3, "a", 2001, 2, 2, 9, 3, 8, "H")]), 1)
    S.absorb(spark, root, games(spark, rows + rows + [(3, "a", 2001, 2, 2, 9, 3, 8, "H")]), 1)
    close(by_game(S.live_history(spark, root)), whole(spark, rows + [(3, "a", 2001, 2, 2, 9, 3, 8, "H")]))
    assert S.live_history(spark, root).count() == 3


def test_a_batch_ended_half_way_is_not_seen(spark, monkeypatch):
    root = new_path(spark, "rated")
    first, second = [(1, "a", 2001, 2, 1, 9, 2, 8, "N")], [(2, "a", 2001, 1, 1, 9, 2, 8, "H")]
    S.absorb(spark, root, games(spark, first), 0)

    def fails(*_):
        raise RuntimeError("ended")

    with monkeypatch.context() as m:
        m.setattr(S, "rate_games", fails)
        with pytest.raises(RuntimeError):
            S.absorb(spark, root, games(spark, second), 1)
    close(by_game(S.live_history(spark, root)), whole(spark, first))
    S.absorb(spark, root, games(spark, second), 1)
    close(by_game(S.live_history(spark, root)), whole(spark, first + second))


def test_rejected_early_and_empty(spark):
    root = new_path(spark, "rated")
    S.absorb(spark, root, games(spark, []), 0)
    assert S.live_history(spark, root).count() == 0
    rows = [
        (1, "a", 2001, 1, 1, 9, 2, 8, "N"), (2, "a", 2001, 1, None, 9, 2, 8, "N"), (None, "a", 2001, 1, 1, 9, 2, 8, "N"),
        (4, "a", 2001, 0, 1, 9, 2, 8, "N"), (5, "a", 2001, 1, 1, 9, 2, 8, None),
    ]
    S.absorb(spark, root, games(spark, rows), 1)
    assert set(by_game(S.live_history(spark, root))) == {1, 5}
    assert spark.read.parquet(f"{root}/rejected/batch=1").count() == 2


def test_games_are_not_sorted_by_pool_to_find_where_it_begins(spark, monkeypatch):
    """The points of a batch are a table that is joined by its size; they were an aggregate of unknown size in every plan."""
    seen = []

    def rate(rerun, opening, rules):
        seen.append(plan(rerun))
        return R.rate_games(rerun, opening, rules)

    monkeypatch.setattr(S, "rate_games", rate)
    rows = random_games(5, leagues=2, seasons=(2001,), days=4, per_day=3, teams=6)
    folder, root = new_path(spark, "arriving"), new_path(spark, "rated")
    arrive(spark, rows, folder, 0)
    run(spark, folder, root)
    assert len(seen) == 1 and "min(" not in seen[0] and "BroadcastHashJoin" in seen[0]
    close(by_game(S.live_history(spark, root)), whole(spark, rows))
