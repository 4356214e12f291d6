"""Views of the given star schema as the tables of this domain (game log, rosters, tenures, ...)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtline.operators.games import team_games
from courtline.operators.ingest import CELL_CLASSES
from courtline.operators.matchups import seeded_field
from courtline.schemas import GAME_LOG
from courtline.storage import kept_folder, kept_table, small_splits, write_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _side_stats(line: str, side: str) -> list:
    """The thirteen counts of one side, derived from its order line."""
    part, supp, number = F.col(f"{line}.l_partkey"), F.col(f"{line}.l_suppkey"), F.col(f"{line}.l_linenumber")
    quantity = F.col(f"{line}.l_quantity").cast("int")
    values = {
        "fgm": number, "fga": quantity, "fgm3": number % 4, "fga3": quantity % 17,
        "ftm": part % 10, "fta": part % 10 + supp % 5,
        "oreb": part % 11, "dreb": part % 23, "ast": part % 19, "tov": part % 17,
        "stl": part % 9, "blk": part % 7, "pf": part % 21,
    }
    return [v.cast("int").alias(f"{side}_{k}") for k, v in values.items()]


# What orders the lines of an order, from the dearest on.
_LINE = ("neg_price", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")


def _lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        "l_orderkey", "l_suppkey", (-F.col("l_extendedprice")).alias("neg_price"),
        "l_linenumber", "l_partkey", "l_quantity", "l_returnflag",
    )


def _games(placed: DataFrame, line: Column, orders: DataFrame) -> DataFrame:
    """Game rows of the lines in the first two places of their order."""
    sides = (
        placed.filter("place <= 2")
        .groupBy("l_orderkey")
        .agg(
            F.max(F.when(F.col("place") == 1, line)).alias("w"),
            F.max(F.when(F.col("place") == 2, line)).alias("x"),
        )
        .filter("x is not null")
    )
    date = F.col("o_orderdate")
    return sides.join(
        orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("l_orderkey").alias("game_id"),
        F.col("o_orderpriority").alias("league"),
        F.year(date).alias("season"),
        (F.dayofyear(date) - 1).alias("day_num"),
        F.col("w.l_suppkey").alias("w_id"),
        F.floor(-F.col("w.neg_price") / 1000).cast("int").alias("w_score"),
        F.col("x.l_suppkey").alias("l_id"),
        F.floor(-F.col("x.neg_price") / 1000).cast("int").alias("l_score"),
        F.when(F.col("w.l_returnflag") == "R", "H")
        .when(F.col("w.l_returnflag") == "A", "A")
        .otherwise("N")
        .alias("w_loc"),
        (F.col("l_orderkey") % 3).cast("int").alias("num_ot"),
        *_side_stats("w", "w"),
        *_side_stats("x", "l"),
    )


def build_game_log(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One game per order: its dearest line won, the dearest line of another supplier lost.

    A supplier's best line is found with a combining aggregate and only two lines per order and map
    task pass the group limit, so an order of any size never meets in one task.
    """
    best = _lines(lineitem).groupBy("l_orderkey", "l_suppkey").agg(F.min(F.struct(*_LINE)).alias("line"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("line"))
    return _games(best.select("l_orderkey", "line").withColumn("place", place), F.col("line"), orders)


def two_dearest(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The two dearest lines of every order as a game, whether or not they are of two suppliers.

    Two lines per order and map task pass the group limit and are shuffled, once.
    """
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    return _games(_lines(lineitem).withColumn("place", place), F.struct(*_LINE), orders)


def write_game_log(lineitem: DataFrame, orders: DataFrame, path: str) -> str:
    """The rows of :func:`build_game_log` by season, in a folder under ``path``.

    The two dearest lines of most orders are their game. Only where both are of one supplier the order's lines are
    looked through again; how many such orders there are is known by then, so Spark can choose the join by their size.
    """
    spark = lineitem.sparkSession
    alike = F.col("w_id").eqNullSafe(F.col("l_id"))
    split = two_dearest(lineitem, orders).withColumn("kind", F.when(alike, "alike").otherwise("games"))
    with small_splits(spark):
        write_partitions(split, path, ("kind", "season"))
    try:
        left = spark.read.schema("game_id bigint").parquet(f"{path}/kind=alike").select(F.col("game_id").alias("l_orderkey"))
    except AnalysisException:
        return f"{path}/kind=games"
    rest = build_game_log(lineitem.join(left, "l_orderkey", "left_semi"), orders)
    write_partitions(rest, f"{path}/kind=games", ("season",), mode="append")
    return f"{path}/kind=games"


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The game log, written once per application, split by season so season filters prune files."""
    kept = kept_folder(
        spark, sf_dir, "game_log",
        lambda path: write_game_log(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), path),
    )
    return kept.select(*GAME_LOG.fieldNames())


def facts(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return team_games(game_log(spark, sf_dir), **kwargs)


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("team_name"), F.col("s_acctbal").alias("budget")
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds table (league, season, bracket, team, wins, seed): every team of the log by its wins, kept."""
    return kept_table(spark, sf_dir, "seeds", lambda: seeded_field(facts(spark, sf_dir, stats=(), opponent=False)))


def tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coach validity intervals for every (season, team) in the log; low budgets leave the late one open."""
    season_teams = facts(spark, sf_dir, stats=(), opponent=False).select("season", "team").distinct()
    key = F.col("team")
    turn = 100 + key % 200
    first = F.struct(
        F.lit(0).alias("first_day"), turn.cast("int").alias("last_day"),
        F.concat(F.lit("Coach#"), (key % 40).cast("string")).alias("coach"),
    )
    second = F.struct(
        (turn + 1).cast("int").alias("first_day"), F.lit(365).alias("last_day"),
        F.concat(F.lit("Coach#"), (key % 40 + 40).cast("string")).alias("coach"),
    )
    return (
        season_teams.join(teams(spark, sf_dir), F.col("team") == F.col("team_id"))
        .select("season", "team", F.when(F.col("budget") < 1000, F.array(first)).otherwise(F.array(first, second)).alias("t"))
        .select("season", "team", F.inline("t"))
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue rows exist for games played on one side's ground."""
    return (
        game_log(spark, sf_dir)
        .filter("w_loc <> 'N'")
        .groupBy("season", "day_num", "w_id", "l_id")
        .agg(
            F.min(F.when(F.col("game_id") % 2 == 0, "Regular").otherwise("Secondary")).alias("cr_type"),
            F.min((F.col("game_id") % 200).cast("int")).alias("city_id"),
        )
    )


def game_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest ledger: closed orders were downloaded, pending ones were skipped, open ones are new."""
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderstatus <> 'O'")
        .select(
            F.col("o_orderkey").alias("game_id"),
            F.when(F.col("o_orderstatus") == "F", "Downloaded").otherwise("DashesSkipped").alias("status"),
        )
    )


def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose id carries a label have been handled."""
    return (
        table(spark, sf_dir, "pages").select("page_id")
        .join(table(spark, sf_dir, "labels"), F.col("page_id") == F.col("doc_id"))
        .groupBy("page_id")
        .agg(F.max("quality").alias("quality"))
        .select("page_id", F.when(F.col("quality") == 1, "Downloaded").otherwise("NoAwayTeam").alias("status"))
    )


def box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The game log as scraped text, seen from the home and the away side."""
    games = game_log(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), "o_orderdate")
    w_home = F.col("w_loc") == "H"

    def pick(column: str, home: bool):
        w, l = F.col(f"w_{column}"), F.col(f"l_{column}")
        return F.when(w_home, w if home else l).otherwise(l if home else w)

    def cells(side: str):
        home = side == "home"

        def dashed(a: str, b: str):
            return F.concat_ws("-", pick(a, home).cast("string"), pick(b, home).cast("string"))

        plain = ("oreb", "dreb", "ast", "stl", "blk", "tov", "pf")
        return [
            dashed("fgm", "fga").alias(f"{side}_fg"),
            dashed("fgm3", "fga3").alias(f"{side}_fg3"),
            dashed("ftm", "fta").alias(f"{side}_ft"),
            *[pick(c, home).cast("string").alias(f"{side}_{c}") for c in plain],
            pick("score", home).cast("string").alias(f"{side}_score"),
            F.when(F.col("game_id") % 11 == 0, "--").otherwise(pick("score", home).cast("string")).alias(f"{side}_pts"),
        ]

    def href(side: str, missing: int):
        path = F.concat(F.lit("/team/_/id/"), pick("id", side == "home").cast("string"), F.lit("/x"))
        return F.when(F.col("game_id") % missing != 0, path).alias(f"{side}_href")

    title = F.concat(
        F.lit("Supplier "), F.col("w_id").cast("string"), F.lit(" vs. "), F.col("l_id").cast("string"),
        F.lit(" - Box Score - "), F.date_format("o_orderdate", "MMMM d, yyyy"),
    )
    status = F.when(F.col("game_id") % 7 == 0, "Final/OT").when(F.col("game_id") % 7 == 1, "Final/2OT").otherwise("Final")
    return games.join(dates, "game_id").select(
        "game_id", title.alias("title"), status.alias("status_text"),
        href("away", 13), href("home", 17), *cells("home"), *cells("away"),
    ).withColumns({
        # Broken pages: a score or count that is missing or no number, a game not played, a title without a date, a link without an id.
        "home_score": F.when(F.col("game_id") % 29 != 0, F.col("home_score")),
        "away_score": F.when(F.col("game_id") % 31 == 0, "n/a").otherwise(F.col("away_score")),
        "status_text": F.when(F.col("game_id") % 37 == 0, "Postponed").otherwise(F.col("status_text")),
        "title": F.when(F.col("game_id") % 41 == 0, "Supplier - Box Score - soon").otherwise(F.col("title")),
        "away_href": F.when((F.col("game_id") % 43 == 0) & F.col("away_href").isNotNull(), "/team/_/id/none/x").otherwise(F.col("away_href")),
        "home_fg": F.when(F.col("game_id") % 47 == 0, "7").otherwise(F.col("home_fg")),
    })


def box_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scraped cells as stored box-score pages (game_id, html): nested cells, either quote, comments, open tags."""
    cells = box_cells(spark, sf_dir)

    def block(side: str):
        link = F.coalesce(F.concat(F.lit('<a href="'), F.col(f"{side}_href"), F.lit("\" class='team-name x'><b>te</b>am</a>")), F.lit("unlinked"))
        score = F.coalesce(F.concat(F.lit('<div class="score"><!-- <b>0</b> --><b> '), F.col(f"{side}_score"), F.lit("</b>\n</div>")), F.lit(""))
        return F.concat(F.lit(f'<section><div class="team {side}">'), link, score, F.lit("</div></section>"))

    def totals(side: str):
        one = [F.concat(F.lit(f"<td class={label}><span title='a > b'>"), F.regexp_replace(f"{side}_{c}", "-", "<i>&#45;</i>"), F.lit("</span>")) for c, label in CELL_CLASSES.items()]
        return F.concat(
            F.lit('<div class="sub-module"><table><tr><td class="fg">0-0</td></tr>\n<tr class="highlight">'), *one, F.lit("</tr></table></div>")
        )

    return cells.select(
        "game_id",
        F.concat(
            F.lit("<html><head><title>"), F.col("title"), F.lit('</title></head><body><span class="game-time status-detail">'),
            F.col("status_text"), F.lit("</span>"), block("away"), block("home"), totals("away"), totals("home"), F.lit("</body></html>"),
        ).alias("html"),
    )


def name_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two catalogues to match over the whole table: every part name, against names of even length as they are and
    names of odd length with the type of their part."""
    part = table(spark, sf_dir, "part")
    left = part.select(F.col("p_name").alias("name")).distinct()
    odd = F.length("p_name") % 2 == 1
    typed = F.when(odd, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name"))
    return left, part.select(typed.alias("candidate")).distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("candidate"), F.col("c_nationkey").alias("generation"), F.col("c_acctbal").alias("score")
    )
