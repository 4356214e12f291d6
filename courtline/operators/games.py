"""Game log to team-game facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.schemas import GAME_KEYS, STATS


def team_games(games: DataFrame, stats: tuple[str, ...] = STATS, opponent: bool = True) -> DataFrame:
    """Two rows per game, one for each side, from a single scan.

    ``stats`` names the counts to carry, so narrow uses read narrow columns.
    """

    def side(own: str, other: str, outcome: str) -> str:
        fields = [f"{own}_id as team", f"{other}_id as opp", f"'{outcome}' as outcome", f"{own}_score as score"]
        fields += [f"{own}_{s} as {s}" for s in stats]
        if opponent:
            fields += [f"{other}_score as opp_score", *[f"{other}_{s} as opp_{s}" for s in stats]]
        return f"struct({', '.join(fields)})"

    return games.selectExpr(*GAME_KEYS, f"inline(array({side('w', 'l', 'W')}, {side('l', 'w', 'L')}))")


def game_ordinal(facts: DataFrame) -> DataFrame:
    """``rank()`` of each game in its team's season; games of one day tie.

    The rank depends on the day only, so it is summed over daily counts (a season has a few hundred
    days) and joined back: a team with a huge share of the rows is never sorted in one task.
    """
    daily = facts.groupBy("season", "team", "day_num").agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy("season", "team").orderBy("day_num").rangeBetween(Window.unboundedPreceding, -1)
    )
    ranks = daily.select(
        "season", "team", "day_num", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1).alias("game_rank")
    )
    return facts.join(ranks, ["season", "team", "day_num"])


def combine(*logs: DataFrame, distinct: bool = False) -> DataFrame:
    """Stack logs by column name; ``distinct`` drops rows that are equal in every column."""
    stacked = reduce(lambda a, b: a.unionByName(b), logs)
    return stacked.distinct() if distinct else stacked


def pair_order(a: str, b: str) -> tuple[Column, Column]:
    """Lower and higher id of a pair."""
    return F.least(a, b), F.greatest(a, b)


def lower_id_won(w: str = "w_id", l: str = "l_id") -> Column:
    return (F.col(w) < F.col(l)).cast("int")
