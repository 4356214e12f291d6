"""Rating fold, day steps and snapshots on hand-made games."""

import math
import random

import pytest
from pyspark.sql import functions as F

from courtline.operators import ratings as R

COLUMNS = "game_id long, league string, season int, day_num int, w_id long, w_score int, l_id long, l_score int, w_loc string"


def games(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def expected_update(diff, margin):
    p = 1 / (10 ** (-diff / 400) + 1)
    return p, 22 * (margin + 3) ** 0.8 / (7.5 + 0.006 * diff) * (1 - p)


def random_games(seed, leagues=2, seasons=(2001, 2002, 2003), days=12, per_day=6, teams=9):
    rng = random.Random(seed)
    rows, key = [], 0
    for league in range(leagues):
        for season in seasons:
            for day in range(days):
                for _ in range(rng.randrange(per_day)):
                    w, l = rng.sample(range(teams), 2)
                    a, b = sorted((rng.randrange(50, 100), rng.randrange(50, 100)), reverse=True)
                    rows.append((key, f"L{league}", season, day, w, a, l, b, rng.choice("HAN")))
                    key += 1
    return rows


def by_game(df):
    return {r.game_id: r for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for key, row in a.items():
        for x, y in zip(row, b[key]):
            assert x == y if not isinstance(x, float) else math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def test_five_games_by_hand(spark):
    rows = [
        (1, "a", 2000, 1, 10, 70, 20, 60, "N"),
        (2, "a", 2000, 2, 10, 70, 20, 70, "H"),
        (3, "a", 2000, 2, 30, 80, 20, 60, "A"),
        (4, "a", 2001, 5, 20, 65, 10, 60, "N"),
        (5, "a", 2000, 0, 10, 90, 20, 60, "N"),
    ]
    got = by_game(R.rate_games(games(spark, rows)))
    assert set(got) == {1, 2, 3, 4}
    p1, u1 = expected_update(0.0, 10)
    assert got[1].pred == pytest.approx(p1) and got[1].update == pytest.approx(u1)
    ten, twenty = 1500 + u1, 1500 - u1
    p2, u2 = expected_update(ten + 100 - twenty, 0)
    p3, u3 = expected_update(1500 - (twenty + 100), 20)
    assert (got[2].pred, got[2].update) == (pytest.approx(p2), pytest.approx(u2))
    assert (got[3].pred, got[3].update) == (pytest.approx(p3), pytest.approx(u3))
    # Team 20 lost twice on day 2: both games read the same opening rating, and both losses count.
    assert got[2].l_elo == got[3].l_elo == pytest.approx(twenty)
    carried = lambda r: 0.75 * r + 0.25 * 1505
    assert got[4].w_elo == pytest.approx(carried(twenty - u2 - u3))
    assert got[4].l_elo == pytest.approx(carried(ten + u2))


def test_fold_equals_day_steps(spark):
    rows = random_games(1, seasons=(2001, 2003), days=6)
    late = [(10_000 + i, "late", 2003, d, i % 3, 80, 3 + i % 2, 70, "N") for i, d in enumerate((1, 1, 2, 3))]
    log = games(spark, rows + late)
    folded = by_game(R.rate_games(log))
    close(folded, by_game(R.rate_games(log, by_day=True)))


def test_mixed_pool_sizes(spark):
    log = games(spark, random_games(2, leagues=1, seasons=(2001,), days=5) + [(9_999, "tiny", 2001, 1, 1, 9, 2, 8, "N")])
    close(by_game(R.rate_games(log)), by_game(R.rate_games(log, by_day=True)))


def test_a_day_moves_points_but_makes_none(spark):
    log = games(spark, random_games(3, leagues=1))
    ratings = log.select("league", F.explode(F.array("w_id", "l_id")).alias("team")).distinct()
    ratings = R.open_season(ratings, None)
    day = log.withColumn("margin", F.col("w_score") - F.col("l_score"))
    after = R.apply_updates(ratings, R.rate_day(day, ratings))
    total = lambda df: df.agg(F.sum("rating")).first()[0]
    assert total(after) == pytest.approx(total(ratings))


def test_resume_equals_one_run(spark):
    log = games(spark, random_games(4))
    whole = R.rate_games(log)
    first = R.rate_games(log.filter("season <= 2001"))
    opening = R.season_snapshots(first).filter("season = 2001")
    for by_day in (False, True):
        rest = R.rate_games(log.filter("season > 2001 and season < 2003"), opening, by_day=by_day)
        close(by_game(whole.filter("season = 2002")), by_game(rest))
    ends = {(r.league, r.season, r.team): r.rating for r in R.season_snapshots(whole).collect()}
    resumed = R.season_snapshots(rest, opening)
    for r in resumed.collect():
        assert r.rating == pytest.approx(ends[(r.league, r.season, r.team)])
    assert resumed.filter("season = 2002").count() == sum(1 for k in ends if k[1] == 2002)


def test_snapshot_of_an_idle_team(spark):
    rows = [(1, "a", 2000, 1, 1, 9, 2, 8, "N"), (2, "a", 2001, 1, 3, 9, 4, 8, "N"), (3, "a", 2002, 1, 3, 9, 4, 8, "N")]
    got = {(r.season, r.team): r.rating for r in R.season_snapshots(R.rate_games(games(spark, rows))).collect()}
    _, u = expected_update(0.0, 1)
    carried = lambda r: 0.75 * r + 0.25 * 1505
    assert got[(2000, 1)] == pytest.approx(1500 + u)
    assert got[(2001, 1)] == pytest.approx(carried(1500 + u))
    assert got[(2002, 1)] == pytest.approx(carried(carried(1500 + u)))
    assert got[(2000, 3)] == pytest.approx(1500) and got[(2001, 4)] == pytest.approx(carried(1500) - (got[(2001, 3)] - carried(1500)))


def test_unknown_team_goes_to_the_error_output(spark):
    log = games(spark, [(1, "a", 2000, 1, 1, 9, 2, 8, "N")]).withColumn("margin", F.lit(1))
    ratings = spark.createDataFrame([("a", 1, 1500.0)], "league string, team long, rating double")
    assert R.unrated(R.rate_day(log, ratings)).count() == 1


def by_hand(rows, rules=R.RULES):
    """All pools in plain Python, a day at a time."""
    out, rating, start, current = {}, {}, {}, {}
    days = sorted({(r[2], r[3], r[1]) for r in rows if r[3] >= rules.first_day})
    for season, day, league in days:
        today = [r for r in rows if (r[2], r[3], r[1]) == (season, day, league)]
        first = start.setdefault(league, season)
        pool = rating.setdefault(league, {})
        for _ in range(season - current.get(league, season)):
            for team in pool:
                pool[team] = 0.75 * pool[team] + 0.25 * 1505
        current[league] = season
        for r in today:
            for team in (r[4], r[6]):
                pool.setdefault(team, 1505 + 0.75 ** (season - first) * (1500 - 1505))
        moved = {}
        for key, _, _, _, w, a, l, b, loc in today:
            diff = pool[w] - pool[l] + {"H": 100, "A": -100, "N": 0}[loc]
            out[key] = (pool[w], pool[l], *expected_update(diff, a - b))
            moved[w] = moved.get(w, 0) + out[key][3]
            moved[l] = moved.get(l, 0) - out[key][3]
        for team, points in moved.items():
            pool[team] += points
    return out


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_days_that_run_over_batches(spark, batch):
    """A pool is rated the same however its rows are cut into batches; teams join in later seasons too."""
    rows = random_games(5, leagues=3, days=8, per_day=9, teams=12)
    rows = [r for r in rows if not (r[2] < 2003 and 11 in (r[4], r[6]))]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        got = by_game(R.rate_games(games(spark, rows)))
    finally:
        spark.conf.set(name, before)
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert (r.w_elo, r.l_elo, r.pred, r.update) == pytest.approx(want[key], rel=1e-9)


def test_one_pool_holds_teams_not_games(spark):
    """The fold sees a pool batch by batch: its largest input frame does not grow with the pool."""
    import pandas as pd

    sizes = []

    def frames(count):
        for n in range(count):
            frame = pd.DataFrame({
                "game_id": range(n * 50, n * 50 + 50), "league": "a", "season": 2001, "day_num": n // 3 + 1,
                "w_id": [k % 10 for k in range(50)], "l_id": [(k + 1) % 10 for k in range(50)],
                "margin": 5, "home": 0.0, "rating": float("nan"),
            })
            sizes.append(len(frame))
            yield frame

    stream = R.pool_folder(R.RULES)(frames(200))
    first = next(stream)
    assert len(first) == 50 and sizes == [50]
    assert sum(len(f) for f in stream) == 199 * 50


def test_no_games_give_no_ratings(spark):
    assert R.rate_games(games(spark, [])).count() == 0


def test_resumed_pools_are_folded_once(spark, small):
    """The snapshots read the resumed history from a table; the fold ran again for every use of it."""
    from courtline.catalog import QUERIES

    assert "MapInPandas" not in QUERIES["r7_resumed_snapshots"].plan(spark, small)._jdf.queryExecution().executedPlan().toString()
