"""Registered queries: a Spark plan over the tables of a folder, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from courtline.operators.ratings import rate_games
from courtline.operators.rolling import trailing_stats
from courtline.session import settled
from courtline.sources import tables
from courtline.storage import kept_table, small_splits

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}

# Round to predict: features as known before this day, with this day as the day feature.
CUTOFF_DAY = 148
FEATURE_DAY = 136
# Upcoming games of the sequence model are dated to this day.
SEQUENCE_DAY = 134


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(lambda spark, sf_dir: plan(settled(spark), sf_dir), sql)
        return plan

    return register


def rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of the whole log, computed once per application and kept by season."""
    kept = kept_table(
        spark, sf_dir, "ratings", lambda: rate_games(tables.game_log(spark, sf_dir)), partition_by=("season",)
    )
    return kept.withColumn("season", kept["season"].cast("int"))


def trailing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing three-game statistics, kept by season for the plans that join them."""
    # A team seldom plays twice a day, so what a task reads is about what it holds until the shuffle.
    with small_splits(spark):
        kept = kept_table(
            spark, sf_dir, "trailing", lambda: trailing_stats(tables.facts(spark, sf_dir, opponent=False)),
            partition_by=("season",),
        )
    return kept.withColumn("season", kept["season"].cast("int"))
