"""Queries: file sources and sinks, each written and read back over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.catalog.ctes import sql
from courtline.catalog.joining import predictions
from courtline.catalog.modelling import _SCALED, bounds, sequences
from courtline.catalog.rating import _HISTORY_SQL, rounded_history
from courtline.catalog.registry import CUTOFF_DAY, query, rating_history
from courtline.catalog.shaping import ROLLING_SQL, field_pairs, rolling, rounded
from courtline.functions.elo import win_expectancy
from courtline.operators.matchups import submission, submission_full
from courtline.operators.ratings import rating_before
from courtline.plans.sequences import sequence_steps
from courtline.schemas import CANDIDATE, GAME_LOG, STATS, SUBMISSION, SUBMISSION_FULL, TRAILING
from courtline.sources import files
from courtline.sources import tables as t
from courtline.storage import new_path, small_splits


@query("s1_csv_scan", sql("select * from contests", "contests"))
def _(spark, sf):
    path = new_path(spark, "log_csv")
    files.write_csv(t.game_log(spark, sf), path)
    return files.read_csv(spark, path, GAME_LOG)


@query("s1_csv_inferred", sql("select * from contests", "contests"))
def _(spark, sf):
    """The log written as CSV and read back without a schema; whole numbers come as the widest type."""
    path = new_path(spark, "log_csv")
    files.write_csv(t.game_log(spark, sf), path)
    typed = files.read_csv_inferred(spark, path)[0]
    return typed.select(*[F.col(f.name).cast(f.dataType) for f in GAME_LOG.fields])


_SNIFFED = ("region", "nation", "supplier", "customer", "part", "orders")


@query("s1_inferred_types", " union all ".join(
    f"""select '{name}' as table_name, column_name, case when column_type in ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'HUGEINT') then 'bigint'
        when column_type in ('DOUBLE', 'FLOAT') or starts_with(column_type, 'DECIMAL') then 'double'
        when column_type = 'DATE' then 'date' when starts_with(column_type, 'TIMESTAMP') then 'timestamp'
        when column_type = 'BOOLEAN' then 'boolean' else 'string' end as kind
    from (describe select * from {name})""" for name in _SNIFFED))
def _(spark, sf):
    """Types found in the texts of whole tables are those the tables have."""
    found = []
    for name in _SNIFFED:
        path = new_path(spark, name)
        files.write_csv(t.table(spark, sf, name), path)
        kinds = files.inferred_types(spark.read.option("header", True).csv(path))
        found += [(name, c, k) for c, k in kinds.items()]
    return spark.createDataFrame(found, "table_name string, column_name string, kind string")


@query("s2_orc_scan", sql(f"select {ROLLING_SQL} from rolling", "rolling"))
def _(spark, sf):
    path = new_path(spark, "stats_orc")
    # As in trailing_table: what a task totals is about what it reads.
    with small_splits(spark):
        files.write_orc(rolling(spark, sf), path)
    return rounded(files.read_orc(spark, path), TRAILING)


@query("s3_orc_overwrite", sql("select * from contests", "contests"))
def _(spark, sf):
    path = new_path(spark, "log_orc")
    for _ in range(2):
        files.write_orc(t.game_log(spark, sf), path)
    return files.read_orc(spark, path)


@query("s4_season_overwrite", sql(f"{_HISTORY_SQL} from ratings", "ratings"))
def _(spark, sf):
    """All seasons, then the later ones again: the same rows remain."""
    path = new_path(spark, "ratings_orc")
    history = rating_history(spark, sf)
    files.write_season_partitions(history, path)
    files.write_season_partitions(history.filter("season >= 1999"), path)
    return rounded_history(files.read_orc(spark, path))


@query("s5_single_csv", sql(
    """select season, round(avg(w_pred), 6) as w_pred, round(avg(l_pred), 6) as l_pred, count(*) as games
    from predictions group by season""", "predictions"))
def _(spark, sf):
    path = new_path(spark, "report_csv")
    report = predictions(spark, sf).groupBy("season").agg(
        F.round(F.avg("w_pred"), 6).alias("w_pred"), F.round(F.avg("l_pred"), 6).alias("l_pred"), F.count(F.lit(1)).alias("games")
    )
    files.write_csv(report, path, single_file=True)
    return files.read_csv(spark, path, report.schema)


_STEPS_SQL = f"""select s.game_id, s.season, s.label, s.team_1, s.team_2, s.step, s.day_1, s.opp_1, s.day_2, s.opp_2, {_SCALED} from sequence s,
    (select """ + ", ".join(f"min({s}) as lo_{s}, max({s}) as hi_{s}" for s in STATS) + " from facts) b"
_STEP_STATS = [f"{b}_{s}" for b in ("t1", "o1", "t2", "o2") for s in STATS]


def _stored_steps(spark, sf):
    path = new_path(spark, "steps")
    games, fitted, packing = sequences(spark, sf)
    # Spread by season while histories are packed; the long form is made where it is written.
    steps = sequence_steps(files.by_season(games), fitted, packing)
    files.write_season_partitions(steps, path, "parquet", spread=False)
    return path


@query("s6_season_features", sql(_STEPS_SQL, "sequence", "facts"))
def _(spark, sf):
    return rounded(spark.read.parquet(_stored_steps(spark, sf)), _STEP_STATS)


@query("s7_season_range", sql(f"{_STEPS_SQL} where s.season between 1990 and 1997", "sequence", "facts"))
def _(spark, sf):
    """The range starts before the first stored season."""
    return rounded(files.read_seasons(spark, _stored_steps(spark, sf), 1990, 1997), _STEP_STATS)


def scored_pairs(spark, sf):
    """Pairings with the expectancy of the lower id, from ratings before the cutoff; null without a rating."""
    ratings = rating_before(rating_history(spark, sf), CUTOFF_DAY)
    names = t.teams(spark, sf).select("team_id", "team_name")
    out = field_pairs(spark, sf)
    for n in ("1", "2"):
        elo = ratings.select("league", "season", F.col("team").alias(f"team_{n}"), F.col("elo").alias(f"elo_{n}"))
        out = out.join(elo, ["league", "season", f"team_{n}"], "left").join(names.toDF(f"team_{n}", f"name_{n}"), f"team_{n}")
    return out.withColumn("p_lower", win_expectancy(F.col("elo_1"), F.col("elo_2")))


_SCORED = """(select p.*, n1.team_name as name_1, n2.team_name as name_2,
    1.0 / (pow(10.0, -(a.elo - b.elo) / 400.0) + 1.0) as p_lower from pairs p
    left join elo_before a on a.league = p.league and a.season = p.season and a.team = p.team_1
    left join elo_before b on b.league = p.league and b.season = p.season and b.team = p.team_2
    join teams n1 on n1.team_id = p.team_1 join teams n2 on n2.team_id = p.team_2)"""


@query("s8_submission", sql(
    f"select concat_ws('_', season, team_1, team_2) as id, round_even(p_lower, 2) as pred from {_SCORED}",
    "pairs", "elo_before", "teams", cutoff=CUTOFF_DAY))
def _(spark, sf):
    path = new_path(spark, "submission")
    files.write_csv(submission(scored_pairs(spark, sf)), path)
    return files.read_csv(spark, path, SUBMISSION)


@query("s8_submission_full", sql(
    f"""select concat_ws('_', season, name_1, name_2) as info, round_even(p_lower, 2) as prediction1,
    round_even(1 - p_lower, 2) as prediction2 from {_SCORED}""", "pairs", "elo_before", "teams", cutoff=CUTOFF_DAY))
def _(spark, sf):
    path = new_path(spark, "submission_full")
    files.write_csv(submission_full(scored_pairs(spark, sf)), path)
    return files.read_csv(spark, path, SUBMISSION_FULL)


@query("s10_candidates_json", """select c_custkey as candidate, c_nationkey as generation, c_acctbal as score,
    cast(c_custkey % 4 + 1 as int) as hidden_layers, case when c_custkey % 2 = 0 then 'l-bfgs' else 'gd' end as solver from customer""")
def _(spark, sf):
    path = new_path(spark, "candidates")
    layers = F.sequence(F.lit(1), (F.col("candidate") % 4 + 1).cast("int"))
    population = t.candidates(spark, sf).select(
        "candidate", "generation", "score", layers.alias("layers"),
        F.when(F.col("candidate") % 2 == 0, "l-bfgs").otherwise("gd").alias("solver"),
    )
    files.write_json(population, path)
    back = files.read_json(spark, path, CANDIDATE)
    return back.select("candidate", "generation", "score", F.size("layers").alias("hidden_layers"), "solver")
