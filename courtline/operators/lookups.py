"""Dimension lookups: plain, by validity interval, and latest row as of a day.

No side is hinted: Spark broadcasts a side only when its measured size allows, and otherwise sort-merges
with adaptive skew handling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_names(games: DataFrame, teams: DataFrame, how: str = "left", w: str = "w_id", l: str = "l_id") -> DataFrame:
    """Attach the names of both sides; renamed before the join so nothing is ambiguous."""
    w_names = teams.select(F.col("team_id").alias(w), F.col("team_name").alias(f"{w.removesuffix('_id')}_name"))
    l_names = teams.select(F.col("team_id").alias(l), F.col("team_name").alias(f"{l.removesuffix('_id')}_name"))
    return games.join(w_names, w, how).join(l_names, l, how)


def coach_on_day(games: DataFrame, tenures: DataFrame, team: str, out: str, how: str = "left") -> DataFrame:
    """Coach whose interval covers the game's day: equal season and team, day within the interval."""
    t = tenures.select(
        F.col("season").alias("t_season"), F.col("team").alias("t_team"), "first_day", "last_day", F.col("coach").alias(out)
    )
    covers = (
        (F.col("season") == F.col("t_season"))
        & (F.col(team) == F.col("t_team"))
        & F.col("day_num").between(F.col("first_day"), F.col("last_day"))
    )
    return games.join(t, covers, how).drop("t_season", "t_team", "first_day", "last_day")


def covering(
    rows: DataFrame, intervals: DataFrame, keys: list[str], day: str, first: str, last: str, how: str = "left"
) -> DataFrame:
    """Rows with every interval of their keys that covers their day, both bounds included; days are whole numbers.

    Days are cut into blocks of 2**level days, about as long as the mean interval. An interval is sent to every block it
    touches, at most three times the number of intervals in all however long some are, and a day to the one block that
    holds it, so one equi-join with a range test finds all: pairs are not shuffled again, and a key with many rows is spread
    by block. Rows without keys or day match nothing (kept by ``left``); nor do intervals without keys or bounds, or with
    ``last`` before ``first``. Equal intervals are returned each. Columns of ``intervals`` besides keys and bounds are added;
    they must not be named as columns of ``rows`` are.
    """
    added = [c for c in intervals.columns if c not in (*keys, first, last)]
    clash = {c.lower() for c in added} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    whole = intervals.select(
        *[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], *[F.col(c) for c in added],
        F.col(first).cast("long").alias("_first"), F.col(last).cast("long").alias("_last"),
    ).filter("_first <= _last")
    # One number: the mean number of days.
    mean = whole.agg(F.avg(F.col("_last").cast("double") - F.col("_first") + 1)).first()[0] or 1.0
    level = max(math.ceil(mean) - 1, 0).bit_length()
    block = lambda day: F.shiftright(day, level)
    spread = whole.withColumn("_level_block", F.explode(F.sequence(block(F.col("_first")), block(F.col("_last")))))
    day_block = F.shiftright(F.col(day).cast("long"), level)
    found = (day_block == F.col("_level_block")) & F.col(day).cast("long").between(F.col("_first"), F.col("_last"))
    for n, k in enumerate(keys):
        found = found & (F.col(k) == F.col(f"_key{n}"))
    return rows.join(spread, found, how).select(*rows.columns, *added)


def latest(df: DataFrame, keys: list[str], order: str, before: Column | int | None = None) -> DataFrame:
    """Rows with the greatest ``order`` per key (ties kept), optionally strictly before a day.

    The rank limit is applied before the shuffle as well, so a hot key ships its newest rows only.
    """
    if before is not None:
        df = df.filter(F.col(order) < before)
    newest = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("place", newest).filter("place = 1").drop("place")


def side_of_day(games: DataFrame, team_days: DataFrame, side: str, how: str = "left") -> DataFrame:
    """Attach a side's columns of the same day; outcome is part of the key, so nothing fans out."""
    keys = ("season", "day_num", "team", "outcome")
    stats = team_days.filter(F.col("outcome") == side.upper()).selectExpr(
        "season", "day_num", f"team as {side}_id", *[f"{c} as {side}_{c}" for c in team_days.columns if c not in keys]
    )
    return games.join(stats, ["season", "day_num", f"{side}_id"], how)


def team_ids(rows: DataFrame, foreign: str, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Translate a foreign id; returns the resolved rows and the quarantined rest.

    Rows without an id go straight to quarantine, so they never pile up on one join partition.
    """
    known = teams.select(F.col("team_id").alias(foreign), "team_id")
    given = rows.filter(F.col(foreign).isNotNull())
    missed = given.join(known.select(foreign), foreign, "left_anti").unionByName(rows.filter(F.col(foreign).isNull()))
    return given.join(known, foreign), missed
