"""Queries: reshaping, projections, predicates, sets, windows and aggregates over the game log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtline.catalog.ctes import each, sql
from courtline.catalog.registry import query, rating_history
from courtline.functions.elo import win_expectancy
from courtline.functions.rounding import half_up_sql
from courtline.operators.games import combine, game_ordinal, lower_id_won, pair_order
from courtline.operators.history import latest_games
from courtline.operators.lookups import latest
from courtline.operators.matchups import orientations, pairings, sorted_field
from courtline.operators.rolling import stat_bounds, trailing_stats
from courtline.plans.models import leaderboard, mean_fitness
from courtline.schemas import AVERAGED, STATS, TRAILING
from courtline.sources import tables as t

ROLLING_SQL = ", ".join(["season", "day_num", "team", "outcome", *[f"round({c}, 6) as {c}" for c in TRAILING]])


def rounded(df: DataFrame, columns, places: int = 6) -> DataFrame:
    wanted = set(columns)
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    exact = lambda c: half_up_sql(c, places) if c in doubles else f"round({c}, {places})"
    return df.selectExpr(*[f"{exact(c)} as {c}" if c in wanted else c for c in df.columns])


def rolling(spark: SparkSession, sf: str) -> DataFrame:
    return trailing_stats(t.facts(spark, sf, opponent=False))


def field_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairings(t.seeds(spark, sf))


@query("p1_team_games", sql("select * from facts", "facts"))
def _(spark, sf):
    return t.facts(spark, sf)


@query("p2_select_rename", sql(
    """select season as "Season", day_num as "DayNum", w_id as "WTeamID", w_score as "WScore", l_id as "LTeamID",
    l_score as "LScore", w_loc as "WLoc", num_ot as "NumOT" from contests""", "contests"))
def _(spark, sf):
    return t.game_log(spark, sf).select("season", "day_num", "w_id", "w_score", "l_id", "l_score", "w_loc", "num_ot").withColumnsRenamed(
        {"season": "Season", "day_num": "DayNum", "w_id": "WTeamID", "w_score": "WScore", "l_id": "LTeamID",
         "l_score": "LScore", "w_loc": "WLoc", "num_ot": "NumOT"}
    )


@query("p3_constant_columns", sql(
    """select league, season, 1 as orientation, team_1 as w_id, team_2 as l_id, 'Tourney' as cr_type, 'N' as w_loc, 0 as w_score, 0 as l_score from pairs
    union all select league, season, 2, team_2, team_1, 'Tourney', 'N', 0, 0 from pairs""", "pairs"))
def _(spark, sf):
    return orientations(field_pairs(spark, sf)).select(
        "*", F.lit("Tourney").alias("cr_type"), F.lit("N").alias("w_loc"), F.lit(0).alias("w_score"), F.lit(0).alias("l_score")
    )


@query("p4_null_default", sql(
    """select c.game_id, coalesce(v.cr_type, 'Unknown') as cr_type from contests c
    left join venues v on v.season = c.season and v.day_num = c.day_num and v.w_id = c.w_id and v.l_id = c.l_id""", "contests", "venues"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "season", "day_num", "w_id", "l_id")
    joined = games.join(t.venues(spark, sf), ["season", "day_num", "w_id", "l_id"], "left")
    return joined.select("game_id", F.coalesce("cr_type", F.lit("Unknown")).alias("cr_type"))


@query("p6_type_coercion", sql(
    """select game_id, try_cast(home_pts as int) as home_pts, try_cast(away_pts as int) as away_pts,
    try_cast(home_oreb as int) as home_oreb, try_cast(home_fg as int) as home_fg from cells""", "cells"))
def _(spark, sf):
    wanted = {"home_pts": "int", "away_pts": "int", "home_oreb": "int", "home_fg": "int"}
    return t.box_cells(spark, sf).select("game_id", *[F.col(c).try_cast(k).alias(c) for c, k in wanted.items()])


@query("p7_filters", sql(
    """select game_id, season, day_num, w_id, l_id from contests
    where season = 2000 and day_num between 100 and 200 and w_score > l_score and w_loc <> 'N'""", "contests"))
def _(spark, sf):
    return (
        t.game_log(spark, sf)
        .filter((F.col("season") == 2000) & F.col("day_num").between(100, 200))
        .filter((F.col("w_score") > F.col("l_score")) & (F.col("w_loc") != "N"))
        .select("game_id", "season", "day_num", "w_id", "l_id")
    )


@query("p8_either_side", sql(
    """select s.team_id, count(*) as games from teams s join (
        select w_id as team_id, game_id from contests union select l_id, game_id from contests
    ) c on c.team_id = s.team_id group by s.team_id""", "teams", "contests"))
def _(spark, sf):
    games = t.facts(spark, sf, stats=(), opponent=False).select(F.col("team").alias("team_id"), "game_id")
    return games.groupBy("team_id").agg(F.count("game_id").alias("games")).join(
        t.teams(spark, sf).select("team_id"), "team_id"
    )


@query("p9_pair_order", sql(
    "select game_id, least(w_id, l_id) as team_1, greatest(w_id, l_id) as team_2 from contests", "contests"))
def _(spark, sf):
    lower, higher = pair_order("w_id", "l_id")
    return t.game_log(spark, sf).select("game_id", lower.alias("team_1"), higher.alias("team_2"))


@query("p10_labels", sql(
    """select game_id, case when w_id < l_id then 1 else 0 end as lower_id_won, w_score as w_label, l_score as l_label
    from contests""", "contests"))
def _(spark, sf):
    return t.game_log(spark, sf).select(
        "game_id", lower_id_won().alias("lower_id_won"), F.col("w_score").alias("w_label"), F.col("l_score").alias("l_label")
    )


@query("p11_current_flag", sql(
    """select t.season, t.team, t.coach, 'Y' as current from tenures t
    join (select season, team, max(last_day) as last_day from tenures group by season, team) m
    on m.season = t.season and m.team = t.team and m.last_day = t.last_day""", "tenures"))
def _(spark, sf):
    current = latest(t.tenures(spark, sf), ["season", "team"], "last_day")
    return current.select("season", "team", "coach", F.lit("Y").alias("current"))


@query("u1_union_all", sql(
    "select * from contests union all select * from contests where season = 1998", "contests"))
def _(spark, sf):
    games = t.game_log(spark, sf)
    return combine(games, games.filter("season = 1998"))


@query("u2_concat_by_name", sql("select league, game_id, season, w_id, l_id from contests", "contests"))
def _(spark, sf):
    """Two halves of the log with their columns in different orders."""
    games = t.game_log(spark, sf).select("league", "game_id", "season", "w_id", "l_id")
    return combine(games.filter("season <= 1997"), games.filter("season > 1997").select("l_id", "w_id", "season", "game_id", "league"))


@query("u3_union_distinct", sql(
    "select * from contests union select * from contests where season = 1998", "contests"))
def _(spark, sf):
    games = t.game_log(spark, sf)
    return combine(games, games.filter("season = 1998"), distinct=True)


@query("w1_game_ordinal", sql("select game_id, season, team, day_num, game_rank from ranked", "ranked"))
def _(spark, sf):
    facts = t.facts(spark, sf, stats=(), opponent=False).select("game_id", "season", "team", "day_num")
    return game_ordinal(facts)


@query("w2_trailing_three", sql(f"select {ROLLING_SQL} from rolling", "rolling"))
def _(spark, sf):
    return rounded(rolling(spark, sf), TRAILING)


@query("j5_trailing_range_join", sql(
    """select g.season, g.day_num, g.team, g.outcome, cast(count(h.game_id) as bigint) as pairs, cast(sum(h.score) as bigint) as score
    from (select distinct season, day_num, team, outcome, game_rank from ranked) g left join ranked h
    on h.season = g.season and h.team = g.team and h.game_rank between g.game_rank - 3 and g.game_rank - 1
    group by g.season, g.day_num, g.team, g.outcome""", "ranked"))
def _(spark, sf):
    """Sizes and score totals of the range join's groups, from day totals."""
    totals = t.facts(spark, sf, stats=(), opponent=False).groupBy("season", "team", "day_num", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("points")
    )
    of_team = Window.partitionBy("season", "team")
    before = of_team.orderBy("day_num").rangeBetween(Window.unboundedPreceding, -1)
    frame = of_team.orderBy("game_rank").rangeBetween(-3, -1)
    ranked = totals.withColumn("game_rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
    return ranked.select(
        "season", "day_num", "team", "outcome",
        F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("pairs"), F.sum("points").over(frame).alias("score"),
    )


@query("a1_trailing_averages", sql(
    "select season, day_num, team, outcome, " + each("round(avg_{s}, 6) as avg_{s}", AVERAGED) + " from rolling", "rolling"))
def _(spark, sf):
    columns = [f"avg_{c}" for c in AVERAGED]
    return rounded(rolling(spark, sf).select("season", "day_num", "team", "outcome", *columns), columns)


@query("a2_ratio_of_sums", sql(
    """select season, team, round(sum(fgm) / nullif(sum(fga), 0), 6) as fg, round(sum(fgm3) / nullif(sum(fga3), 0), 6) as fg3,
    round(sum(ftm) / nullif(sum(fta), 0), 6) as ft from facts group by season, team""", "facts"))
def _(spark, sf):
    facts = t.facts(spark, sf, stats=("fgm", "fga", "fgm3", "fga3", "ftm", "fta"), opponent=False)
    ratio = lambda made, tried: F.round(F.try_divide(F.sum(made), F.sum(tried)), 6)
    return facts.groupBy("season", "team").agg(
        ratio("fgm", "fga").alias("fg"), ratio("fgm3", "fga3").alias("fg3"), ratio("ftm", "fta").alias("ft")
    )


@query("a3_last_day", sql("select season, max(day_num) as last_day, count(*) > 0 as has_games from contests group by season", "contests"))
def _(spark, sf):
    return t.game_log(spark, sf).groupBy("season").agg(
        F.max("day_num").alias("last_day"), (F.count(F.lit(1)) > 0).alias("has_games")
    )


@query("a4_last_day_per_team", sql("select season, team, max(day_num) as last_day from rolling group by season, team", "rolling"))
def _(spark, sf):
    facts = t.facts(spark, sf, stats=(), opponent=False)
    return facts.groupBy("season", "team").agg(F.max("day_num").alias("last_day"))


@query("a6_stat_bounds", sql("select * from bounds", "bounds"))
def _(spark, sf):
    return stat_bounds(t.facts(spark, sf, opponent=False))


@query("a8_mean_fitness", """select c_nationkey as generation, round(avg(c_acctbal), 4) as mean_score, count(*) as candidates
    from customer group by c_nationkey""")
def _(spark, sf):
    return mean_fitness(t.candidates(spark, sf)).withColumn("mean_score", F.round("mean_score", 4))


@query("o1_sorted_log", sql("select season, day_num, game_id, w_id, l_id from contests order by season, day_num, game_id", "contests"))
def _(spark, sf):
    return t.game_log(spark, sf).select("season", "day_num", "game_id", "w_id", "l_id").orderBy("season", "day_num", "game_id")


@query("o3_sorted_unique_field", sql("select distinct league, season, team from fields order by league, season, team", "fields"))
def _(spark, sf):
    return sorted_field(t.seeds(spark, sf))


@query("o4_leaderboard", """select c_custkey as candidate, c_nationkey as generation, c_acctbal as score from customer
    order by c_acctbal desc, c_custkey limit 5""")
def _(spark, sf):
    return leaderboard(t.candidates(spark, sf), 5)


@query("o5_preview", sql("select game_id, season, day_num, w_id, l_id from contests order by game_id limit 100", "contests"))
def _(spark, sf):
    return t.game_log(spark, sf).select("game_id", "season", "day_num", "w_id", "l_id").orderBy("game_id").limit(100)


@query("w3_latest_five", sql(
    """select season, team, game_id, day_num, step from (select *, row_number() over
    (partition by season, team order by day_num desc, game_id desc) as step from facts) where step <= 5""", "facts"))
def _(spark, sf):
    facts = t.facts(spark, sf, stats=(), opponent=False).select("season", "team", "game_id", "day_num")
    return latest_games(facts, 5)


@query("w4_latest_row", sql(
    """select distinct league, season, team, day_num, round(elo, 3) as elo from (select *, rank() over
    (partition by league, season, team order by day_num desc) as rk from team_ratings) where rk = 1""", "team_ratings"))
def _(spark, sf):
    history = rating_history(spark, sf)
    sides = history.select("league", "season", "day_num", F.inline(F.array(
        F.struct(F.col("w_id").alias("team"), F.col("w_elo").alias("elo")),
        F.struct(F.col("l_id").alias("team"), F.col("l_elo").alias("elo")),
    )))
    newest = latest(sides, ["league", "season", "team"], "day_num")
    return newest.select("league", "season", "team", "day_num", F.round("elo", 3).alias("elo")).distinct()


@query("f1_log_and_power", sql(
    """select game_id, round(pow(w_score - l_score + 3.0, 0.8), 6) as scaled_margin,
    round(-ln(1.0 / (pow(10.0, -(w_score - l_score) / 400.0) + 1.0)), 6) as loss from contests""", "contests"))
def _(spark, sf):
    margin = F.col("w_score") - F.col("l_score")
    return t.game_log(spark, sf).select(
        "game_id", F.round(F.pow(margin + 3.0, F.lit(0.8)), 6).alias("scaled_margin"),
        F.round(-F.log(win_expectancy(margin.cast("double"), F.lit(0.0))), 6).alias("loss"),
    )


@query("f9_formatted_ids", sql("select concat_ws('_', season, team_1, team_2) as id, league from pairs", "pairs"))
def _(spark, sf):
    return field_pairs(spark, sf).select(F.concat_ws("_", "season", "team_1", "team_2").alias("id"), "league")


@query("f10_rounding", sql(
    """select game_id, round(p, 2) as half_up, round_even(p, 2) as half_even from
    (select game_id, 1.0 / (pow(10.0, -(w_score - l_score) / 400.0) + 1.0) as p from contests)""", "contests"))
def _(spark, sf):
    p = win_expectancy(F.col("w_score").cast("double"), F.col("l_score").cast("double"))
    return t.game_log(spark, sf).select("game_id", F.round(p, 2).alias("half_up"), F.bround(p, 2).alias("half_even"))


@query("f11_null_test", sql(
    """select c.game_id, v.cr_type is null as missing, case when v.cr_type is null then 0 else v.city_id end as city_id
    from contests c left join venues v on v.season = c.season and v.day_num = c.day_num and v.w_id = c.w_id and v.l_id = c.l_id""",
    "contests", "venues"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "season", "day_num", "w_id", "l_id")
    joined = games.join(t.venues(spark, sf), ["season", "day_num", "w_id", "l_id"], "left")
    missing = F.col("cr_type").isNull()
    return joined.select("game_id", missing.alias("missing"), F.when(missing, 0).otherwise(F.col("city_id")).alias("city_id"))
