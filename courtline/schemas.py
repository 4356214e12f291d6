"""Column names and explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The thirteen box-score counts, in game-log order.
STATS = ("fgm", "fga", "fgm3", "fga3", "ftm", "fta", "oreb", "dreb", "ast", "tov", "stl", "blk", "pf")
# Trailing averages, and trailing ratios as (output, made, attempted).
AVERAGED = ("score", "oreb", "dreb", "ast", "tov", "stl", "blk", "pf")
RATIOS = (("avg_fg", "fgm", "fga"), ("avg_fg3", "fgm3", "fga3"), ("avg_ft", "ftm", "fta"))
TRAILING = (
    "avg_score", "avg_fg", "avg_fg3", "avg_ft", "avg_oreb", "avg_dreb",
    "avg_ast", "avg_tov", "avg_stl", "avg_blk", "avg_pf",
)

GAME_KEYS = ("game_id", "league", "season", "day_num")


def _int_fields(names: tuple[str, ...] | list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names]


GAME_LOG = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("league", T.StringType()),
        *_int_fields(["season", "day_num"]),
        T.StructField("w_id", T.LongType()),
        T.StructField("w_score", T.IntegerType()),
        T.StructField("l_id", T.LongType()),
        T.StructField("l_score", T.IntegerType()),
        T.StructField("w_loc", T.StringType()),
        T.StructField("num_ot", T.IntegerType()),
        *_int_fields([f"w_{s}" for s in STATS]),
        *_int_fields([f"l_{s}" for s in STATS]),
    ]
)

RATING_HISTORY = T.StructType(
    [
        T.StructField("league", T.StringType()),
        T.StructField("game_id", T.LongType()),
        *_int_fields(["season", "day_num"]),
        T.StructField("pred", T.DoubleType()),
        T.StructField("update", T.DoubleType()),
        T.StructField("w_id", T.LongType()),
        T.StructField("w_elo", T.DoubleType()),
        T.StructField("w_new_elo", T.DoubleType()),
        T.StructField("l_id", T.LongType()),
        T.StructField("l_elo", T.DoubleType()),
        T.StructField("l_new_elo", T.DoubleType()),
    ]
)

LEDGER = T.StructType([T.StructField("game_id", T.LongType()), T.StructField("status", T.StringType())])

CANDIDATE = T.StructType(
    [
        T.StructField("candidate", T.LongType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("layers", T.ArrayType(T.IntegerType())),
        T.StructField("solver", T.StringType()),
    ]
)

INDIVIDUAL = T.StructType(
    [
        T.StructField("candidate", T.LongType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("parents", T.ArrayType(T.LongType())),
        T.StructField("layers", T.ArrayType(T.IntegerType())),
        T.StructField("activations", T.ArrayType(T.StringType())),
        T.StructField("optimizer", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

SUBMISSION = T.StructType([T.StructField("id", T.StringType()), T.StructField("pred", T.DoubleType())])
SUBMISSION_FULL = T.StructType(
    [
        T.StructField("info", T.StringType()),
        T.StructField("prediction1", T.DoubleType()),
        T.StructField("prediction2", T.DoubleType()),
    ]
)
