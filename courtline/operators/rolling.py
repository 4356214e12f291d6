"""Trailing-window team statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.schemas import AVERAGED, RATIOS, STATS, TRAILING


def trailing_stats(facts: DataFrame, games: int = 3) -> DataFrame:
    """Averages over the games ranked 1..``games`` places before the current one, per team and season.

    All games of a day share one rank, so the frame never cuts through a day: totals per day and
    outcome (combined map-side) carry everything the frame needs, and a window partition holds at
    most two rows per calendar day however many games a team played.
    """
    counts = ("score", *STATS)
    totals = facts.groupBy("season", "team", "day_num", "outcome").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum({c}) as {c}") for c in counts]
    )
    ranked = totals.selectExpr(
        "*",
        """coalesce(sum(n) over (partition by season, team order by day_num
            range between unbounded preceding and 1 preceding), 0) + 1 as game_rank""",
    )
    frame = f"(partition by season, team order by game_rank range between {games} preceding and 1 preceding)"
    framed = ranked.selectExpr(
        "season", "day_num", "team", "outcome", *[f"sum({c}) over {frame} as {c}" for c in ("n", *counts)]
    )
    values = {f"avg_{c}": f"try_divide({c}, n)" for c in AVERAGED}
    values |= {out: f"try_divide({made}, {tried})" for out, made, tried in RATIOS}
    return framed.selectExpr("season", "day_num", "team", "outcome", *[f"{values[c]} as {c}" for c in TRAILING])


def stat_bounds(facts: DataFrame) -> DataFrame:
    """Smallest and largest value of each count over all team rows, one row per count."""
    ends = facts.agg(*[F.min(s).alias(f"min_{s}") for s in STATS], *[F.max(s).alias(f"max_{s}") for s in STATS])
    rows = [
        F.struct(F.lit(s).alias("stat"), F.col(f"min_{s}").alias("lo"), F.col(f"max_{s}").alias("hi")) for s in STATS
    ]
    return ends.select(F.inline(F.array(*rows)))
