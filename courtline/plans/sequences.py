"""Last-N-game sequence features of every game."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from courtline.operators.games import lower_id_won, pair_order, team_games
from courtline.operators.history import games_before, recent_games, steps, with_both_histories
from courtline.operators.indexing import dense_index, scaled_sql, with_index
from courtline.operators.packing import Packing
from courtline.schemas import STATS

HISTORY = 5

Bounds = dict[str, tuple[float, float]]


def sequence_games(games: DataFrame, n: int = HISTORY, facts: DataFrame | None = None) -> DataFrame:
    """Games whose two sides both have ``n`` earlier games, with both histories; lower id first."""
    lower, higher = pair_order("w_id", "l_id")
    base = games.select(
        "game_id", "season", "day_num", lower.alias("team_1"), higher.alias("team_2"), lower_id_won().alias("label")
    )
    recent = recent_games(team_games(games) if facts is None else facts, n).filter(F.size("recent") == n)
    return with_both_histories(base, recent)


def sequence_pairs(pairs: DataFrame, facts: DataFrame, cutoff_day: int, n: int = HISTORY) -> DataFrame:
    """Upcoming pairs with their histories before ``cutoff_day``; a side short of ``n`` games leaves null."""
    recent = games_before(facts, cutoff_day, n).filter(F.size("recent") == n)
    return with_both_histories(pairs, recent, how="left")



def stat_packing(bounds: Bounds) -> Packing:
    """Both sides' counts in a few longs; ``bounds`` are those of the whole log, either side of it."""
    return Packing.fit({f"{prefix}{s}": bounds[s] for prefix in ("", "opp_") for s in STATS})


def packed_facts(facts: DataFrame, packing: Packing) -> DataFrame:
    """What histories carry of a game: its day and the opponent, and all counts in ``packing``'s words.

    A game is in the history of up to ``n`` later games of each side, so its width is paid many times over.
    """
    return packing.pack(facts).select("game_id", "season", "team", "day_num", "opp", *packing.words())


def _count(packing: Packing | None, game: str, column: str) -> str:
    return packing.value(f"{game}.", column) if packing else f"{game}.{column}"


def sequence_steps(sequences: DataFrame, bounds: Bounds | None, packing: Packing | None = None) -> DataFrame:
    """Long form: per game and step, ids and counts of both teams and of their opponents.

    Counts are scaled to ``bounds``, or left as they are without bounds. Histories of :func:`packed_facts` need their
    ``packing``.
    """

    def count(path: str, s: str) -> str:
        return scaled_sql(path, *bounds[s]) if bounds else path

    keys = ["game_id", "season", "label", "team_1", "team_2"]
    blocks = (("t1", "a", ""), ("o1", "a", "opp_"), ("t2", "b", ""), ("o2", "b", "opp_"))
    columns = [f"{count(_count(packing, game, prefix + s), s)} as {name}_{s}" for name, game, prefix in blocks for s in STATS]
    return steps(sequences, keys).selectExpr(
        *keys, "step", "a.day_num as day_1", "a.opp as opp_1", "b.day_num as day_2", "b.opp as opp_2", *columns
    )


def _step_counts(bounds: Bounds, packing: Packing | None) -> str:
    """An array a step of the scaled counts of both teams and their opponents, the newest game first."""
    return f"zip_with(recent_1, recent_2, (a, b) -> array({', '.join(_game_counts('a', 'b', bounds, packing))}))"


def _game_counts(a: str, b: str, bounds: Bounds, packing: Packing | None) -> list[str]:
    return [scaled_sql(_count(packing, game, prefix + s), *bounds[s]) for game in (a, b) for prefix in ("", "opp_") for s in STATS]


def stat_vector(sequences: DataFrame, bounds: Bounds) -> DataFrame:
    """Scaled counts of all steps as one dense vector per game, step by step, block by block."""
    return sequences.withColumn("stats", array_to_vector(F.expr(f"flatten({_step_counts(bounds, None)})")))


def ordered_steps(sequences: DataFrame, bounds: Bounds, packing: Packing | None = None, n: int | None = None) -> DataFrame:
    """``steps``: the scaled counts of both teams and their opponents, step by step, the oldest game first.

    Where all histories are null or of ``n`` games, the counts are named one by one: Spark compiles those, and walks through
    the expressions of a lambda function anew for every step.
    """
    if n is None:
        return sequences.withColumn("steps", F.expr(f"flatten(reverse({_step_counts(bounds, packing)}))"))
    counts = [c for i in range(n - 1, -1, -1) for c in _game_counts(f"get(recent_1, {i})", f"get(recent_2, {i})", bounds, packing)]
    return sequences.withColumn(
        "steps", F.expr(f"case when recent_1 is not null and recent_2 is not null then array({', '.join(counts)}) end")
    )


def team_vocabulary(teams: DataFrame) -> DataFrame:
    return dense_index(teams.select("team_id").distinct(), [F.col("team_id")])


def indexed_facts(facts: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """Facts with ``team_slot`` / ``opp_slot``: the vocabulary index, and ``size`` for unknown teams.

    One-hot vectors are sparse, so a vocabulary of any size costs a game no more.
    """
    out = with_index(facts, vocabulary, "team_id", "team", "team_slot", size)
    return with_index(out, vocabulary, "team_id", "opp", "opp_slot", size)


def with_slots(sequences: DataFrame, first_season: int, n: int = HISTORY) -> DataFrame:
    """``slots``: the season's place, then step by step both days and the four team slots, the newest game first."""
    slots = [F.col("season") - first_season]
    for i in range(n):
        for game in ("recent_1", "recent_2"):
            slots += [F.get(F.col(game), F.lit(i))[field] for field in ("day_num", "team_slot", "opp_slot")]
    return sequences.withColumn("slots", F.array(*[c.cast("int") for c in slots]))


def _one_hot(rows: DataFrame, seasons: tuple[int, int], days: int, teams: int, n: int) -> tuple[DataFrame, PipelineModel]:
    """``features`` of rows with ``slots`` and ``stats``."""
    sizes = {"season_slot": seasons[1] - seasons[0] + 1}
    for i in range(n):
        for side in ("1", "2"):
            sizes |= {f"s{i}_day_{side}": days, f"s{i}_team_{side}": teams + 1, f"s{i}_opp_{side}": teams + 1}
    names = list(sizes)
    wide = rows.withColumns({c: F.get("slots", F.lit(k)) for k, c in enumerate(names)})
    fixed = rows.sparkSession.createDataFrame([tuple(sizes[c] - 1 for c in names)], names)
    encoder = OneHotEncoder(inputCols=names, outputCols=[f"{c}_hot" for c in names], dropLast=False, handleInvalid="keep")
    assembler = VectorAssembler(inputCols=[*encoder.getOutputCols(), "stats"], outputCol="features")
    model = PipelineModel([encoder.fit(fixed), assembler])
    return model.transform(wide).drop(*names, *encoder.getOutputCols()), model


def encoded(
    sequences: DataFrame, bounds: Bounds, seasons: tuple[int, int], days: int, teams: int, n: int = HISTORY
) -> tuple[DataFrame, PipelineModel]:
    """Sparse features: the season, then per step both days and the four team slots one-hot, then all counts.

    Vocabulary sizes are fixed beforehand, so training and scoring always agree on the width.
    ``sequences`` must come from :func:`indexed_facts`.
    """
    out, model = _one_hot(with_slots(stat_vector(sequences, bounds), seasons[0], n), seasons, days, teams, n)
    return out.drop("slots"), model


def encoded_slots(rows: DataFrame, seasons: tuple[int, int], days: int, teams: int, n: int = HISTORY) -> DataFrame:
    """The same features of rows with ``slots`` and ``steps``, whose counts only turn round to the newest game first.

    Spark's encoder names every slot of every step in the column's metadata, which all tasks of a fit are sent: here the
    vectors are put together from their places and values, without names. A slot out of range has the place after the
    last, as there, and nulls are an error, as there.
    """
    sizes = [seasons[1] - seasons[0] + 1, *[days, teams + 1, teams + 1] * (2 * n)]
    width, places, first = 4 * len(STATS), [], 0
    for k, size in enumerate(sizes):
        slot = f"get(slots, {k})"
        known = f"if({slot} >= 0 and {slot} < {size}, {slot}, {size})"
        places.append(f"{first} + if({slot} is null, raise_error('slot is null'), {known})")
        first += size + 1
    # Counts that are nothing are left out of the vector; one that is null has a value and no place, which no vector may.
    counts = [f"get(steps, {i * width + k})" for i in range(n - 1, -1, -1) for k in range(width)]
    places += [f"if({c} <> 0, {first + k}, -1)" for k, c in enumerate(counts)]
    values = ["1D"] * len(sizes) + counts
    vector = f"""named_struct('type', 0Y, 'size', {first + len(counts)}, 'indices', array_remove(array({', '.join(places)}), -1),
        'values', array_remove(array({', '.join(values)}), 0D))"""
    return as_vectors(rows.withColumn("features", F.expr(vector)), "features")


def as_vectors(rows: DataFrame, column: str) -> DataFrame:
    """A column of what a vector is stored as (type, size, indices, values) as vectors; there is no cast for that."""
    session = rows.sparkSession
    fields = [StructField(f.name, VectorUDT()) if f.name == column else f for f in rows.schema]
    schema = session._jsparkSession.parseDataType(StructType(fields).json())
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), schema, False), session)
