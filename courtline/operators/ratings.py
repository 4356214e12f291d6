"""Elo ratings over independent pools (leagues).

A day's games all read the ratings at the start of the day; a team playing twice in a day gets the
sum of both updates. Days of one pool depend on each other, so they run in order:

* by default each pool is a stream sorted by Spark and folded a batch at a time: many pools at once, and
  memory for a batch and one rating per team, so a pool's number of games has no bound;
* with ``by_day`` they are stepped through together, each day a distributed join, with every step
  written to the shared folder. That is the way where one pool's games take one task too long; the caller chooses.

Both give the same ratings. Games without both teams or both scores go to :func:`unratable` first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions.elo import EloRules, carry_over, home_bonuses, rating_update, win_expectancy
from courtline.schemas import RATING_HISTORY
from courtline.storage import cut_lineage, new_path

RULES = EloRules()
_INPUT = ("league", "game_id", "season", "day_num", "w_id", "l_id", "margin", "w_loc")


_NEEDED = ("league", "season", "day_num", "w_id", "l_id", "w_score", "l_score")


def unratable(games: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Error output of the rating run: games with a field missing, or with a team that is not on the roster (league, team)."""
    gaps = games.filter(" or ".join(f"{c} is null" for c in _NEEDED))
    if roster is None:
        return gaps
    rest = games.filter(" and ".join(f"{c} is not null" for c in _NEEDED))
    return gaps.unionByName(rest.join(_on_roster(rest, roster).select("league", "game_id"), ["league", "game_id"], "left_anti").select(*games.columns))


def _on_roster(games: DataFrame, roster: DataFrame) -> DataFrame:
    known = roster.select("league", "team").distinct()
    for side in ("w_id", "l_id"):
        games = games.join(known.withColumnRenamed("team", side), ["league", side], "left_semi")
    return games


def _inputs(games: DataFrame, rules: EloRules, roster: DataFrame | None = None) -> DataFrame:
    games = games.filter(" and ".join(f"{c} is not null" for c in _NEEDED))
    if roster is not None:
        games = _on_roster(games, roster)
    return games.filter(F.col("day_num") >= rules.first_day).select(
        *[(F.col("w_score") - F.col("l_score")).alias("margin") if c == "margin" else F.col(c) for c in _INPUT]
    )


def two_sided(history: DataFrame) -> DataFrame:
    """One row per team and rated game: rating at the start of the day, and the points won or lost."""
    sides = F.array(
        F.struct(F.col("w_id").alias("team"), F.col("w_elo").alias("elo"), F.col("update").alias("delta")),
        F.struct(F.col("l_id").alias("team"), F.col("l_elo").alias("elo"), (-F.col("update")).alias("delta")),
    )
    return history.select("league", "season", "day_num", F.inline(sides))


def rate_day(games: DataFrame, ratings: DataFrame, rules: EloRules = RULES) -> DataFrame:
    """Rate games from start-of-day ``ratings`` (league, team, rating).

    Games with a team missing from ``ratings`` come back with null ratings; see :func:`unrated`.
    """
    w = ratings.select("league", F.col("team").alias("w_id"), F.col("rating").alias("w_elo"))
    l = ratings.select("league", F.col("team").alias("l_id"), F.col("rating").alias("l_elo"))
    w_bonus, l_bonus = home_bonuses(F.col("w_loc"), rules)
    diff = (F.col("w_elo") + w_bonus) - (F.col("l_elo") + l_bonus)
    known = F.col("w_elo").isNotNull() & F.col("l_elo").isNotNull()
    return (
        games.join(w, ["league", "w_id"], "left")
        .join(l, ["league", "l_id"], "left")
        .withColumn("diff", diff)
        .withColumn("pred", win_expectancy(F.col("diff"), F.lit(0.0)))
        .withColumn("update", F.when(known, rating_update(F.col("diff"), F.col("margin"), rules)))
        .withColumn("w_new_elo", F.col("w_elo") + F.col("update"))
        .withColumn("l_new_elo", F.col("l_elo") - F.col("update"))
        .select(*RATING_HISTORY.fieldNames())
    )


def unrated(rated: DataFrame) -> DataFrame:
    """Error output: games with a team the roster does not know."""
    return rated.filter("update is null")


def apply_updates(ratings: DataFrame, rated: DataFrame) -> DataFrame:
    """Ratings after the given rated games."""
    moved = two_sided(rated).groupBy("league", "team").agg(F.sum("delta").alias("delta"))
    return ratings.join(moved, ["league", "team"], "left").select(
        "league", "team", (F.col("rating") + F.coalesce("delta", F.lit(0.0))).alias("rating")
    )


def open_season(roster: DataFrame, previous: DataFrame | None, rules: EloRules = RULES, seasons: int = 1) -> DataFrame:
    """Ratings a season opens with, over the roster (league, team)."""
    if previous is None:
        return roster.select("league", "team", F.lit(rules.start).alias("rating"))
    known = roster.join(previous.select("league", "team", "rating"), ["league", "team"], "left")
    held = F.coalesce("rating", F.lit(rules.start))
    return known.select("league", "team", carry_over(held, F.lit(seasons), rules).alias("rating"))


def pool_folder(rules: EloRules):
    """Function that rates pools that arrive in day order, batch by batch, vectorised within a day.

    Rows are sorted by pool, opening ratings before games, games by day; a day may run over several batches. What it
    holds is the batch and one rating per team of the pool, whatever the number of games. It closes over plain numbers
    only, so executors need numpy and pandas but not this package.
    """
    first_rating, bonus, gain = rules.start, rules.home_bonus, rules.gain
    offset, power = rules.margin_offset, rules.margin_power
    even, slope = rules.even_margin, rules.margin_slope
    share, target = rules.carried_share, rules.carry_target
    columns = RATING_HISTORY.fieldNames()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        league = season = day = first_season = None
        places: dict[int, int] = {}
        # Ratings at the start of the day, and what the day has moved so far.
        rating, moved = np.empty(0), np.empty(0)

        def places_of(teams: np.ndarray) -> np.ndarray:
            """Slots of the teams; newcomers open as if they had been idle since the pool's first season."""
            nonlocal rating, moved
            distinct, back = np.unique(teams, return_inverse=True)
            slots = np.array([places.setdefault(t, len(places)) for t in distinct.tolist()], np.int64)
            if len(places) > len(rating):
                # Room is doubled, so that it is not copied for every batch with a newcomer.
                more = max(len(places), 2 * len(rating)) - len(rating)
                rating, moved = np.r_[rating, np.full(more, np.nan)], np.r_[moved, np.zeros(more)]
            fresh = slots[np.isnan(rating[slots])]
            rating[fresh] = target + share ** int(season - first_season) * (first_rating - target)
            return slots[back]

        for rows in batches:
            if not len(rows):
                continue
            own = [rows[c].to_numpy() for c in ("league", "season", "day_num")]
            opens = rows["rating"].notna().to_numpy()
            size = len(rows)
            w_ids, l_ids = rows["w_id"].to_numpy(), rows["l_id"].to_numpy()
            scale = np.power(rows["margin"].to_numpy() + offset, power)
            at_home = bonus * rows["home"].to_numpy()
            w_elo, l_elo, pred, update = (np.empty(size) for _ in range(4))
            change = np.r_[True, opens[1:] != opens[:-1]]
            for values in own:
                change[1:] |= values[1:] != values[:-1]
            edges = [*np.flatnonzero(change), size]
            for a, b in zip(edges, edges[1:]):
                if own[0][a] != league:
                    league, season, day = own[0][a], own[1][a], None
                    first_season, places = season, {}
                    rating, moved = np.empty(0), np.empty(0)
                if opens[a]:
                    slots = places_of(w_ids[a:b])
                    rating[slots] = rows["rating"].to_numpy()[a:b]
                    continue
                if (own[1][a], own[2][a]) != (season, day):
                    rating, moved = rating + moved, np.zeros(len(moved))
                    rating = target + share ** int(own[1][a] - season) * (rating - target)
                    season, day = own[1][a], own[2][a]
                w, l = places_of(w_ids[a:b]), places_of(l_ids[a:b])
                w_elo[a:b], l_elo[a:b] = rating[w], rating[l]
                diff = w_elo[a:b] - l_elo[a:b] + at_home[a:b]
                pred[a:b] = 1.0 / (10.0 ** (-diff / 400.0) + 1.0)
                expected = even + slope * diff
                ratio = np.divide(scale[a:b], expected, out=np.zeros(b - a), where=expected != 0)
                update[a:b] = gain * ratio * (1.0 - pred[a:b])
                np.add.at(moved, w, update[a:b])
                np.subtract.at(moved, l, update[a:b])
            rated = rows.assign(
                pred=pred, update=update, w_elo=w_elo, w_new_elo=w_elo + update, l_elo=l_elo, l_new_elo=l_elo - update
            )
            yield rated.loc[~opens, columns]

    return fold


def _fold(games: DataFrame, opening: DataFrame | None, rules: EloRules) -> DataFrame:
    """Pools as sorted streams: Spark sorts (and spills) a pool's rows, the task holds a batch and the teams."""
    # A small number instead of a text keeps the rows compact in the Python workers.
    home = F.when(F.col("w_loc") == "H", 1.0).when(F.col("w_loc") == "A", -1.0).otherwise(0.0)
    rows = games.withColumn("home", home).drop("w_loc").withColumn("rating", F.lit(None).cast("double"))
    if opening is not None:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        held = opening.where("rating is not null").withColumnsRenamed({"team": "w_id"}).withColumn("l_id", F.col("w_id"))
        blanks = {c: F.lit(-1).cast(kinds[c]) for c in ("game_id", "day_num", "margin")} | {"home": F.lit(0.0)}
        held = held.withColumns(blanks).select(*[F.col(c).cast(kinds[c]) for c in rows.columns])
        rows = rows.unionByName(held)
    order = ["league", F.col("rating").isNull(), "season", "day_num", "game_id"]
    return rows.repartition("league").sortWithinPartitions(*order).mapInPandas(pool_folder(rules), RATING_HISTORY)


def step_through_days(
    games: DataFrame, opening: DataFrame | None, rules: EloRules = RULES, compact_every: int = 16, day_splits: int = 256
) -> DataFrame:
    """Rate pools of any size: one distributed step per day.

    Ratings are a base table plus the updates of the days since; the base is rewritten every
    ``compact_every`` days and at each season change. Days, bases and histories are tables in the
    shared folder, so a lost executor costs one step at most. Only the calendar is brought to the
    driver.
    """
    spark = games.sparkSession
    root = new_path(spark, "rating_days")
    split = F.pmod(F.xxhash64("game_id"), F.lit(day_splits))
    games.repartition("season", "day_num", split).write.partitionBy("season", "day_num").parquet(f"{root}/games")
    log = spark.read.parquet(f"{root}/games")
    calendar = [(r[0], r[1]) for r in log.select("season", "day_num").distinct().orderBy("season", "day_num").collect()]
    if not calendar:
        return spark.createDataFrame([], RATING_HISTORY)
    roster = two_sided(
        log.select("league", "season", "day_num", "w_id", "l_id", *[F.lit(0.0).alias(c) for c in ("w_elo", "l_elo", "update")])
    ).select("league", "team").distinct()

    def write_base(ratings: DataFrame, number: int) -> DataFrame:
        ratings.write.mode("overwrite").parquet(f"{root}/base-{number}")
        return spark.read.parquet(f"{root}/base-{number}")

    def now(base: DataFrame, since: list[str]) -> DataFrame:
        if not since:
            return base
        moved = two_sided(spark.read.schema(RATING_HISTORY).parquet(*since)).select(
            "league", "team", F.col("delta").alias("rating")
        )
        return base.unionByName(moved).groupBy("league", "team").agg(F.sum("rating").alias("rating"))

    held = roster if opening is None else roster.join(opening.select("league", "team", "season", "rating"), ["league", "team"], "left")
    if opening is None:
        base = write_base(open_season(roster, None, rules), 0)
    else:
        # Every pool enters its first season here; later changes are carried over in the loop.
        pool_season = opening.groupBy("league").agg(F.max("season").alias("from_season"))
        elapsed = F.lit(calendar[0][0]) - F.coalesce("from_season", F.lit(calendar[0][0]))
        base = write_base(
            held.join(pool_season, "league", "left").select(
                "league", "team",
                carry_over(F.coalesce("rating", F.lit(rules.start)), elapsed, rules).alias("rating"),
            ),
            0,
        )
    # A pool that starts in a later season opens that season with first ratings, not carried ones.
    first_seasons = log.groupBy("league").agg(F.min("season").alias("pool_start"))
    begins_fresh = first_seasons if opening is None else first_seasons.join(opening.select("league").distinct(), "league", "left_anti")
    begins_fresh = cut_lineage(begins_fresh)

    since: list[str] = []
    season = calendar[0][0]
    number = 0
    for this_season, day in calendar:
        if this_season != season or len(since) >= compact_every:
            ratings = now(base, since)
            if this_season != season:
                carried = carry_over(F.col("rating"), F.lit(this_season - season), rules)
                fresh = F.coalesce(F.col("pool_start") >= this_season, F.lit(False))
                ratings = ratings.join(begins_fresh, "league", "left").select(
                    "league", "team", F.when(fresh, F.col("rating")).otherwise(carried).alias("rating")
                )
            number += 1
            base, since, season = write_base(ratings, number), [], this_season
        today = log.filter((F.col("season") == this_season) & (F.col("day_num") == day))
        path = f"{root}/history/{this_season}-{day}"
        rate_day(today, now(base, since), rules).write.mode("overwrite").parquet(path)
        since.append(path)
    return spark.read.schema(RATING_HISTORY).parquet(f"{root}/history/*")


def latest_opening(snapshots: DataFrame, rules: EloRules = RULES) -> DataFrame:
    """One opening row per team from snapshots of many seasons: its latest one, carried to its pool's latest season."""
    held = snapshots.groupBy("league", "team").agg(F.max_by("rating", "season").alias("rating"), F.max("season").alias("season"))
    pools = held.groupBy("league").agg(F.max("season").alias("pool_season"))
    return held.join(pools, "league").select(
        "league", F.col("pool_season").alias("season"), "team",
        carry_over(F.col("rating"), F.col("pool_season") - F.col("season"), rules).alias("rating"),
    )


def rate_games(
    games: DataFrame, opening: DataFrame | None = None, rules: EloRules = RULES, by_day: bool = False,
    roster: DataFrame | None = None,
) -> DataFrame:
    """Rating history of every pool over all its seasons, without the games of :func:`unratable`.

    ``opening`` (league, season, team, rating) resumes from the snapshots of an earlier run, of any number of seasons.
    """
    wanted = _inputs(games, rules, roster)
    held = None if opening is None else latest_opening(opening, rules)
    return step_through_days(wanted, held, rules) if by_day else _fold(wanted, held, rules)


def season_snapshots(history: DataFrame, opening: DataFrame | None = None, rules: EloRules = RULES) -> DataFrame:
    """Rating of each team at the end of each season of its pool.

    A team's rating after its last day is that day's opening rating plus the day's updates; seasons
    it sat out are carried over in closed form from the last season known. ``opening`` snapshots keep
    their teams on the roster even when they no longer play.
    """
    day_ends = (
        two_sided(history)
        .groupBy("league", "season", "day_num", "team")
        .agg((F.max("elo") + F.sum("delta")).alias("rating"))
    )
    known = day_ends.groupBy("league", "season", "team").agg(F.max_by("rating", "day_num").alias("rating"))
    seasons = history.groupBy("league").agg(F.array_sort(F.collect_set("season")).alias("seasons"))
    if opening is not None:
        known = known.unionByName(opening.select("league", "season", "team", "rating"))
    roster = known.select("league", "team").distinct()
    grid = roster.join(seasons, "league").select(
        "league", "team", F.element_at("seasons", 1).alias("first_season"), F.explode("seasons").alias("season")
    )
    # Outer, so that opening snapshots, older than every season rated here, still feed the window.
    rows = grid.join(known, ["league", "season", "team"], "full")
    so_far = Window.partitionBy("league", "team").orderBy("season").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("rating").isNotNull(), F.col("season")), ignorenulls=True).over(so_far)
    last = F.last("rating", ignorenulls=True).over(so_far)
    # A newcomer starts in the first season its pool was rated, which an opening snapshot may precede.
    pool_start = F.min("season").over(Window.partitionBy("league", "team"))
    if opening is not None:
        starts = known.groupBy("league").agg(F.min("season").alias("pool_start"))
        rows = rows.join(starts, "league")
        pool_start = F.col("pool_start")
    return (
        rows.withColumn("seen", F.coalesce(seen, pool_start))
        .withColumn("held", F.coalesce(last, F.lit(rules.start)))
        .filter("first_season is not null")
        .select(
            "league", "season", "team",
            carry_over(F.col("held"), F.col("season") - F.col("seen"), rules).alias("rating"),
        )
    )


def mean_log_loss(history: DataFrame) -> DataFrame:
    return history.groupBy("season").agg(
        F.avg(-F.log("pred")).alias("log_loss"), F.count(F.lit(1)).alias("games")
    )


def rating_before(history: DataFrame, cutoff_day: int) -> DataFrame:
    """Rating a team took into its latest game before ``cutoff_day``, per pool and season."""
    return (
        two_sided(history)
        .filter(F.col("day_num") < cutoff_day)
        .groupBy("league", "season", "team")
        .agg(F.max_by("elo", "day_num").alias("elo"), F.max("day_num").alias("elo_day"))
    )
