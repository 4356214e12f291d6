"""Rating history kept up to date while files of games arrive, late days included.

Each micro-batch is an append of its games, of the point of every pool from which it changes ratings (the earliest day
it brings games for), and of the history from that point on, rated anew from the ratings teams had before it. Days that
arrive in order so rate nothing but themselves. Nothing is rewritten: a row of the history counts until a later batch
reaches back to its day or before. All three are folders by batch number, written over when a batch is repeated after a
failure, and a batch counts once its points, written last, are there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from courtline.functions.elo import EloRules
from courtline.operators.ratings import RULES, rate_games, two_sided, unratable
from courtline.schemas import GAME_LOG, RATING_HISTORY
from courtline.storage import stored

GAMES = StructType([GAME_LOG[c] for c in ("game_id", "league", "season", "day_num", "w_id", "w_score", "l_id", "l_score", "w_loc")])
_POINTS = StructType([
    StructField("league", StringType()), StructField("from_season", IntegerType()), StructField("from_day", IntegerType()),
])
_BATCH = StructField("batch", LongType())


def _read(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields, _BATCH])
    try:
        return spark.read.schema(whole).parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], whole)


def _point(season: str, day: str) -> Column:
    return F.struct(F.col(season).alias("season"), F.col(day).alias("day"))


def live_history(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """The history as of the last whole batch (of those below a number, where one is given)."""
    points = _read(spark, root, "points", _POINTS)
    if below is not None:
        points = points.where(F.col("batch") < below)
    # From where the batches after each one have rated a pool anew.
    later = Window.partitionBy("league").orderBy("batch").rowsBetween(1, Window.unboundedFollowing)
    points = points.select("league", "batch", F.min(_point("from_season", "from_day")).over(later).alias("ends"))
    rows = _read(spark, root, "history", RATING_HISTORY).join(points, ["league", "batch"])
    counts = F.col("ends").isNull() | (_point("season", "day_num") < F.col("ends"))
    return rows.where(counts).select(*RATING_HISTORY.fieldNames())


def known_games(spark: SparkSession, root: str, below: int) -> DataFrame:
    """Games of earlier batches; of a game that came twice the first one counts."""
    return _read(spark, root, "games", GAMES).where(F.col("batch") < below).drop("batch")


def _openings(history: DataFrame, rerun: DataFrame, rules: EloRules) -> DataFrame:
    """Ratings (league, season, team, rating) that ``rerun`` resumes from: of each team, after its last day in ``history``.

    Teams that play for the first time opened when their pool did, so that they lean to the target like idle ones.
    """
    day_ends = two_sided(history).groupBy("league", "season", "day_num", "team").agg(
        (F.max("elo") + F.sum("delta")).alias("rating")
    )
    last = day_ends.groupBy("league", "team").agg(
        F.max_by(F.struct("season", "rating"), _point("season", "day_num")).alias("last")
    ).select("league", "last.season", "team", "last.rating")
    starts = history.groupBy("league").agg(F.min("season").alias("season"))
    sides = rerun.select("league", F.explode(F.array("w_id", "l_id")).alias("team")).distinct()
    fresh = sides.join(last, ["league", "team"], "left_anti").join(starts, "league")
    return last.unionByName(fresh.select("league", "season", "team", F.lit(rules.start).alias("rating")))


def absorb(spark: SparkSession, root: str, arrived: DataFrame, batch: int, rules: EloRules = RULES) -> None:
    """One micro-batch. Games known already are dropped, unratable ones go to ``rejected``.

    Days before the first rated one are left out, as in a run over all games.
    """
    root = root.rstrip("/")
    own = GAMES.fieldNames()
    arrived = arrived.select(*own)
    aside = unratable(arrived).unionByName(arrived.where(F.col("game_id").isNull())).dropDuplicates()
    aside.write.mode("overwrite").parquet(f"{root}/rejected/batch={batch}")
    able = arrived.dropna(subset=[c for c in own if c != "w_loc"]).where(F.col("day_num") >= rules.first_day)
    # Rows of one id that differ: the smallest row, so that a repeated batch chooses the same one.
    able = able.groupBy("game_id").agg(F.min(F.struct(*own)).alias("g")).select("g.*")
    fresh = able.join(known_games(spark, root, batch).select("game_id"), "game_id", "left_anti").select(*own)
    fresh.write.mode("overwrite").parquet(f"{root}/games/batch={batch}")
    fresh = spark.read.schema(GAMES).parquet(f"{root}/games/batch={batch}")

    first = F.min(_point("season", "day_num")).alias("first")
    # A table, one row a pool: joined by its measured size, so that games are sorted by pool for the fold only.
    points = stored(fresh.groupBy("league").agg(first).select(
        "league", F.col("first.season").alias("from_season"), F.col("first.day").alias("from_day")
    ), "points")
    after = _point("season", "day_num") >= _point("from_season", "from_day")
    games = known_games(spark, root, batch).unionByName(fresh)
    rerun = games.join(points, "league").where(after).select(*own)
    kept = live_history(spark, root, batch).join(points, "league").where(~after).select(*RATING_HISTORY.fieldNames())
    rated = rate_games(rerun, _openings(kept, rerun, rules), rules)
    rated.write.mode("overwrite").parquet(f"{root}/history/batch={batch}")
    points.write.mode("overwrite").parquet(f"{root}/points/batch={batch}")


def rate_available(
    spark: SparkSession, folder: str, root: str, checkpoint: str, rules: EloRules = RULES, files_per_batch: int | None = None
) -> StreamingQuery:
    """Rate every file of games not seen before, then stop; :func:`live_history` reads what came of it."""
    reader = spark.readStream.schema(GAMES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def step(arrived: DataFrame, batch: int) -> None:
        absorb(arrived.sparkSession, root, arrived.persist(), batch, rules)
        arrived.unpersist()

    return (
        reader.parquet(folder).writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
