"""Score regressions, the flat sequence classifier, and what models are measured by (Spark ML)."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.operators.indexing import frequency_index, hash_split, with_index
from courtline.plans.features import SIDE

# The 28 features: season, day, then coach index, trailing statistics and rating of each side.
FEATURES = ["season", "day_num"] + [
    f"{side}_{'coach_index' if c == 'coach' else c}" for side in ("w", "l") for c in SIDE
]


@dataclass(frozen=True)
class CoachCodes:
    """Coach vocabularies fitted once on the training rows and used unchanged for scoring."""

    w: DataFrame
    l: DataFrame
    w_size: int
    l_size: int

    @staticmethod
    def fit(rows: DataFrame) -> CoachCodes:
        w, l = frequency_index(rows, "w_coach"), frequency_index(rows, "l_coach")
        return CoachCodes(w, l, w.count(), l.count())

    def apply(self, rows: DataFrame) -> DataFrame:
        out = with_index(rows, self.w, "w_coach", "w_coach", "w_coach_index", self.w_size)
        return with_index(out, self.l, "l_coach", "l_coach", "l_coach_index", self.l_size)


def assemble(rows: DataFrame, handle_invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid=handle_invalid).transform(rows)


@dataclass(frozen=True)
class ScoreModels:
    """A boosted-tree regression each for the winner's and the loser's score."""

    codes: CoachCodes
    w: Model
    l: Model

    @staticmethod
    def fit(rows: DataFrame, step: float = 0.1, depth: int = 10, rounds: int = 50, seed: int = 7) -> ScoreModels:
        """Train on ``rows``, placed by ``game_id`` so the trees' row sampling repeats from run to run.

        Every task of every level of a tree sends the statistics of all nodes of that level, so there are no more tasks
        than two a core.
        """
        codes = CoachCodes.fit(rows)
        session = rows.sparkSession
        parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
        ready = (
            assemble(codes.apply(rows)).select("game_id", "features", "w_score", "l_score")
            .repartition(parts, "game_id").sortWithinPartitions("game_id").persist()
        )
        try:
            trees = [
                GBTRegressor(
                    labelCol=label, featuresCol="features", stepSize=step, maxDepth=depth, maxIter=rounds,
                    lossType="squared", seed=seed, checkpointInterval=10,
                )
                for label in ("w_score", "l_score")
            ]
            fit = inheritable_thread_target(rows.sparkSession)(lambda t: t.fit(ready))
            with ThreadPool(len(trees)) as pool:
                models = pool.map(fit, trees)
        finally:
            ready.unpersist()
        return ScoreModels(codes, *models)

    def score(self, rows: DataFrame) -> DataFrame:
        """Both scores on one frame, no join; rows with a missing feature or coach get null scores."""
        vectors = assemble(self.codes.apply(rows), handle_invalid="keep")
        both = self.w.transform(vectors).withColumnRenamed("prediction", "w_pred")
        both = self.l.transform(both).withColumnRenamed("prediction", "l_pred")
        gaps = F.exists(vector_to_array("features"), F.isnan) | F.col("w_coach").isNull() | F.col("l_coach").isNull()
        return both.withColumns({c: F.when(~gaps, F.col(c)) for c in ("w_pred", "l_pred")}).drop("features")


def merge_scores(w_scores: DataFrame, l_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of two separately scored frames, side by side."""
    return w_scores.join(l_scores, keys)


def rmse(predictions: DataFrame, label: str, prediction: str) -> float:
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName="rmse").evaluate(predictions)


def accuracy(predictions: DataFrame, label: str = "label") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(predictions)


def fit_winner_classifier(rows: DataFrame, iterations: int = 50, penalty: float = 0.01) -> Model:
    """Probability that the lower id wins, from sequence features."""
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations, regParam=penalty).fit(rows)


def lower_win_probability(model: Model, rows: DataFrame) -> DataFrame:
    """``p_lower``: probability of class 1, the lower id winning."""
    return model.transform(rows).withColumn("p_lower", vector_to_array("probability")[1]).drop("rawPrediction")


def leaderboard(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` candidates, highest score first; scores that are no number come last."""
    usable = F.when(~F.isnan("score"), F.col("score"))
    return candidates.orderBy(usable.desc_nulls_last(), "candidate").limit(k)


def mean_fitness(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("generation").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("candidates"))


def training_split(rows: DataFrame, key: str, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    return hash_split(rows, key, seed, held_out=30)
