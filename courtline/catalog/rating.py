"""Queries: Elo expressions, day step, fold, snapshots and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.catalog.ctes import sql, update_sql
from courtline.catalog.registry import query, rating_history
from courtline.catalog.shaping import rounded
from courtline.functions.elo import home_bonuses, rating_update, win_expectancy
from courtline.operators.ratings import (
    RULES, apply_updates, mean_log_loss, open_season, rate_day, rate_games, season_snapshots, unratable,
)
from courtline.schemas import RATING_HISTORY
from courtline.sources import tables as t
from courtline.storage import new_path, stored
from courtline.streaming.rating_runs import GAMES, live_history, rate_available

_HISTORY_SQL = """select league, game_id, season, day_num, round(pred, 6) as pred, round("update", 3) as "update", w_id,
    round(w_elo, 3) as w_elo, round(w_new_elo, 3) as w_new_elo, l_id, round(l_elo, 3) as l_elo, round(l_new_elo, 3) as l_new_elo"""
_RATINGS = ("update", "w_elo", "w_new_elo", "l_elo", "l_new_elo")


def rounded_history(df):
    return rounded(rounded(df.select(*RATING_HISTORY.fieldNames()), ["pred"]), _RATINGS, 3)


@query("r1_win_expectancy", sql(
    """select c.game_id, round(1.0 / (pow(10.0, -(w.budget - l.budget) / 400.0) + 1.0), 6) as pred from contests c
    join teams w on w.team_id = c.w_id join teams l on l.team_id = c.l_id""", "contests", "teams"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "w_id", "l_id")
    budgets = t.teams(spark, sf).select("team_id", "budget")
    w = budgets.select(F.col("team_id").alias("w_id"), F.col("budget").alias("w_rating"))
    l = budgets.select(F.col("team_id").alias("l_id"), F.col("budget").alias("l_rating"))
    return games.join(w, "w_id").join(l, "l_id").select(
        "game_id", F.round(win_expectancy(F.col("w_rating"), F.col("l_rating")), 6).alias("pred")
    )


@query("r2_rating_update", sql(
    f"select g.game_id, round({update_sql('1500.0', '1500.0')}, 6) as points from contests g", "contests"))
def _(spark, sf):
    w, l = home_bonuses(F.col("w_loc"), RULES)
    points = rating_update(w - l, F.col("w_score") - F.col("l_score"), RULES)
    return t.game_log(spark, sf).select("game_id", F.round(points, 6).alias("points"))


@query("r3_home_bonus", sql(
    """select game_id, case when w_loc = 'H' then 100.0::double else 0.0::double end as w_bonus,
    case when w_loc = 'A' then 100.0::double else 0.0::double end as l_bonus from contests""", "contests"))
def _(spark, sf):
    w, l = home_bonuses(F.col("w_loc"), RULES)
    return t.game_log(spark, sf).select("game_id", w.alias("w_bonus"), l.alias("l_bonus"))


@query("r4_carry_over", sql(
    """select r.league, r.team, round(case when t.budget >= 1000 then 1500 + t.budget / 100 else 1500.0 end * 0.75 + 0.25 * 1505, 6) as rating
    from (select distinct league, team from facts) r left join teams t on t.team_id = r.team""", "facts", "teams"))
def _(spark, sf):
    """Season opening over the roster; teams without a snapshot start at the first rating."""
    roster = t.facts(spark, sf, stats=(), opponent=False).select("league", "team").distinct()
    rated = t.teams(spark, sf).filter("budget >= 1000").select(
        F.col("team_id").alias("team"), (1500 + F.col("budget") / 100).alias("rating")
    )
    previous = roster.join(rated, "team").select("league", "team", "rating")
    return rounded(open_season(roster, previous), ["rating"])


@query("r4_initial_ratings", sql("select distinct league, team, 1500.0::double as rating from facts", "facts"))
def _(spark, sf):
    roster = t.facts(spark, sf, stats=(), opponent=False).select("league", "team").distinct()
    return open_season(roster, None)


def _opening(spark, sf):
    """Every pool opens with the same rating per team, taken from its budget."""
    roster = t.facts(spark, sf, stats=(), opponent=False).select("league", "team").distinct()
    rating = t.teams(spark, sf).select(F.col("team_id").alias("team"), (1500 + F.col("budget") / 100).alias("rating"))
    return roster.join(rating, "team").select("league", "team", "rating")


def _day_step(spark, sf):
    games = t.game_log(spark, sf).withColumn("margin", F.col("w_score") - F.col("l_score"))
    return rate_day(games, _opening(spark, sf))


@query("r5_day_step", sql(f"{_HISTORY_SQL} from day_step", "day_step"))
def _(spark, sf):
    """All games read the same opening ratings."""
    return rounded_history(_day_step(spark, sf))


@query("r5_updated_ratings", sql(
    """select league, team, round(any_value(elo) + sum(delta), 3) as rating from (
        select league, w_id as team, w_elo as elo, "update" as delta from day_step
        union all select league, l_id, l_elo, -"update" from day_step) group by league, team""", "day_step"))
def _(spark, sf):
    return rounded(apply_updates(_opening(spark, sf), _day_step(spark, sf)), ["rating"], 3)


@query("r6_rating_history", sql(f"{_HISTORY_SQL} from ratings", "ratings"))
def _(spark, sf):
    return rounded_history(rating_history(spark, sf))


@query("r6_streamed_history", sql(f"{_HISTORY_SQL} from ratings", "ratings"))
def _(spark, sf):
    """The log in three arrivals, each with days before those of the one before it."""
    folder, root = new_path(spark, "arriving"), new_path(spark, "rated")
    games = t.game_log(spark, sf).select(*GAMES.fieldNames())
    early = F.col("season") < 1997
    for n, part in enumerate((early & (F.col("day_num") % 7 != 3), ~early, early & (F.col("day_num") % 7 == 3))):
        games.where(part).write.parquet(f"{folder}/{n}")
        query = rate_available(spark, f"{folder}/*", root, f"{root}-checkpoint")
        query.awaitTermination()
    return rounded_history(live_history(spark, root))


_DAY = "cast(dayofyear(o.o_orderdate) - 1 as int) as day_num"
_MONTH = "cast((dayofyear(o.o_orderdate) - 1) // 31 + 1 as int) as day_num"


@query("r6_day_steps", sql(f"{_HISTORY_SQL} from ratings", "ratings").replace(_DAY, _MONTH))
def _(spark, sf):
    """The distributed steps, with a month of the log as one day."""
    months = t.game_log(spark, sf).withColumn("day_num", (F.floor(F.col("day_num") / 31) + 1).cast("int"))
    return rounded_history(rate_games(months, by_day=True))


# Some games of the log lose a field, and teams with a negative budget are not on the roster.
_BROKEN_SQL = """select game_id, league, season, day_num, case when game_id % 19 = 0 then null else w_id end as w_id,
    case when game_id % 23 = 0 then null else l_score end as l_score, l_id, w_score from contests"""


@query("r6_errors", sql(
    f"""select game_id, season, w_id, l_id, l_score from ({_BROKEN_SQL})
    where w_id is null or l_score is null or w_id not in (select team_id from teams where budget >= 0)
    or l_id not in (select team_id from teams where budget >= 0)""", "contests", "teams"))
def _(spark, sf):
    """Games a rating run sets aside: a missing field, or a team that is not on the roster."""
    key = F.col("game_id")
    broken = t.game_log(spark, sf).withColumns({
        "w_id": F.when(key % 19 != 0, F.col("w_id")), "l_score": F.when(key % 23 != 0, F.col("l_score")),
    })
    able = t.teams(spark, sf).filter("budget >= 0").select(F.col("team_id").alias("team"))
    sides = F.explode(F.array("w_id", "l_id")).alias("team")
    roster = t.game_log(spark, sf).select("league", sides).distinct().join(able, "team")
    return unratable(broken, roster).select("game_id", "season", "w_id", "l_id", "l_score")


@query("r7_resumed_snapshots", sql(
    "select league, season, team, round(rating, 3) as rating from snapshots where season >= 1996", "snapshots"))
def _(spark, sf):
    """Ratings of the later seasons, resumed from all snapshots of the earlier ones."""
    history = rating_history(spark, sf)
    before = season_snapshots(history.filter("season < 1996"))
    # Stored, as the snapshots read it more than once and a pool is one task's work.
    resumed = stored(rate_games(t.game_log(spark, sf).filter("season >= 1996"), before), "resumed")
    return rounded(season_snapshots(resumed, before), ["rating"], 3)


@query("r7_season_snapshots", sql(
    "select league, season, team, round(rating, 3) as rating from snapshots", "snapshots"))
def _(spark, sf):
    return rounded(season_snapshots(rating_history(spark, sf)), ["rating"], 3)


@query("a5_log_loss", sql(
    "select season, round(avg(-ln(pred)), 6) as log_loss, count(*) as games from ratings group by season", "ratings"))
def _(spark, sf):
    return rounded(mean_log_loss(rating_history(spark, sf)), ["log_loss"])
