"""Last-N-game history, strictly before a given day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _payload(facts: DataFrame) -> list[str]:
    return [c for c in facts.columns if c not in ("season", "team", "league", "outcome")]


def recent_games(facts: DataFrame, n: int) -> DataFrame:
    """For every (season, team, day played): the ``n`` latest games of strictly earlier days, newest first.

    At most ``n`` games of any one day can matter, so the rest leave before the shuffle by team. Of
    the 2n - 1 games before a day's last kept game at most n - 1 share its day; the n latest earlier
    ones, where they exist, are among them. Both limits are exact.
    """
    newest = Window.partitionBy("season", "team", "day_num").orderBy(F.col("game_id").desc())
    before = Window.partitionBy("season", "team").orderBy("day_num", "game_id").rowsBetween(1 - 2 * n, -1)
    game = F.struct("day_num", "game_id", *[c for c in _payload(facts) if c not in ("day_num", "game_id")])
    kept = facts.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)
    return (
        kept.withColumn("before", F.collect_list(game).over(before))
        .filter("place = 1")
        .select(
            "season", "team", "day_num",
            F.expr(f"slice(reverse(filter(before, g -> g.day_num < day_num)), 1, {n})").alias("recent"),
        )
    )


def games_before(facts: DataFrame, cutoff_day: int, n: int) -> DataFrame:
    """The ``n`` latest games of every (season, team) before one fixed day, newest first."""
    newest = Window.partitionBy("season", "team").orderBy(F.col("day_num").desc(), F.col("game_id").desc())
    game = F.struct("day_num", "game_id", *[c for c in _payload(facts) if c not in ("day_num", "game_id")])
    return (
        facts.filter(F.col("day_num") < cutoff_day)
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= n)
        .groupBy("season", "team")
        .agg(F.sort_array(F.collect_list(game), asc=False).alias("recent"))
    )


def latest_games(facts: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest games of every (season, team), numbered from the newest."""
    newest = Window.partitionBy("season", "team").orderBy(F.col("day_num").desc(), F.col("game_id").desc())
    return facts.withColumn("step", F.row_number().over(newest)).filter(F.col("step") <= n)


def with_both_histories(games: DataFrame, recent: DataFrame, how: str = "inner") -> DataFrame:
    """Attach ``recent_1`` / ``recent_2``: the histories of the lower and the higher id of each game.

    ``recent`` is keyed by day when it comes from :func:`recent_games`, and by season only when it
    comes from :func:`games_before`.
    """
    day = ["day_num"] if "day_num" in recent.columns else []
    out = games
    for number in ("1", "2"):
        side = recent.select(
            "season", *day, F.col("team").alias(f"team_{number}"), F.col("recent").alias(f"recent_{number}")
        )
        out = out.join(side, ["season", *day, f"team_{number}"], how)
    return out


def full_history(games: DataFrame, n: int) -> DataFrame:
    """Games for which both sides have ``n`` earlier games."""
    return games.filter((F.size("recent_1") == n) & (F.size("recent_2") == n))


def steps(games: DataFrame, keys: list[str]) -> DataFrame:
    """One row per game and step: the i-th latest game of one side next to the i-th latest of the other."""
    zipped = F.arrays_zip(F.col("recent_1").alias("a"), F.col("recent_2").alias("b"))
    return games.select(*keys, F.posexplode(zipped).alias("step", "z")).select(
        *keys, (F.col("step") + 1).alias("step"), F.col("z.a").alias("a"), F.col("z.b").alias("b")
    )
