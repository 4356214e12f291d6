"""Incremental ingest of stored pages and scraped box scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from courtline.functions.text import day_number, made_and_attempted, overtimes, path_segment, title_date
from courtline.operators.commits import Store
from courtline.operators.pages import first, first_of, inside, select, text_of, with_elements, with_picked, words_of
from courtline.schemas import GAME_LOG, LEDGER, STATS
from courtline.storage import cut_lineage

# Classes of a stored box-score page. Each side has a block with its link and score, and a section with its
# totals row; the away side comes first.
GAME_STATUS = ("game-time", "status-detail")
SIDE_BLOCK, SIDE_LINK, SIDE_SCORE, SECTION, TOTALS_ROW = "team", "team-name", "score", "sub-module", "highlight"
# Cell class of each column.
CELL_CLASSES = {
    "fg": "fg", "fg3": "3pt", "ft": "ft", "oreb": "oreb", "dreb": "dreb", "ast": "ast", "stl": "stl", "blk": "blk",
    "tov": "to", "pf": "pf", "pts": "pts",
}

# Statuses of a page.
DOWNLOADED = "Downloaded"
NO_AWAY_TEAM, NO_HOME_TEAM, DASHES_SKIPPED = "NoAwayTeam", "NoHomeTeam", "DashesSkipped"
# Statuses of pages that cannot become a game.
MISSING_CELLS, NOT_FINAL, BAD_TITLE, UNKNOWN_TEAM = "MissingCells", "NotFinal", "BadTitle", "UnknownTeam"
_PAIRED = ("fg", "fg3", "ft")


def links(pages: DataFrame, marker: str) -> DataFrame:
    """Distinct (text, href) of the anchors whose href contains ``marker``, over whole pages."""
    anchors = F.filter(select(tag="a"), lambda e: F.contains(e["attributes"]["href"], F.lit(marker)))
    found = with_elements(pages.select("html"), wanted=(("a", ()),)).select(F.explode(anchors).alias("a"), "page")
    return found.select(text_of(F.col("a")).alias("text"), F.col("a.attributes")["href"].alias("href")).distinct()


def labelled_text(pages: DataFrame, label: str = "ad") -> DataFrame:
    """Title, heading and the text of the element with the given class; null where a page has none."""
    wanted = (("title", ()), ("h1", ()), ("div", (label,)))
    return with_elements(pages.select("page_id", "html"), wanted=wanted).select(
        "page_id", text_of(first(select(tag="title"))).alias("title"), text_of(first(select(tag="h1"))).alias("heading"),
        text_of(first(select(tag="div", classes=(label,)))).alias("cell"),
    )


def box_score_cells(pages: DataFrame) -> DataFrame:
    """Scraped cells of stored box-score pages (game_id, html), over the whole text of each page.

    Cells are looked for inside their side's block and totals row, so those of one side never match the other's.
    """
    columns = [
        "title", "status_text", "away_href", "home_href", "away_score", "home_score",
        *[f"{side}_{column}" for side in ("home", "away") for column in CELL_CLASSES],
    ]
    return with_picked(pages.select("game_id", "html"), _box_score, columns)


def _box_score(page: dict) -> dict:
    """The cells of a page that was read."""
    elements = page["elements"]
    out = {
        "title": words_of(page, first_of(elements, "title")),
        "status_text": words_of(page, first_of(elements, "span", GAME_STATUS)),
    }
    for at, side in enumerate(("away", "home")):
        block = inside(page, first_of(elements, "div", (SIDE_BLOCK, side)))
        link = first_of(block, "a", (SIDE_LINK,))
        out[f"{side}_href"] = dict(link["attributes"]).get("href") if link is not None else None
        out[f"{side}_score"] = words_of(page, first_of(block, "div", (SIDE_SCORE,)))
        totals = inside(page, first_of(inside(page, first_of(elements, None, (SECTION,), at)), "tr", (TOTALS_ROW,)))
        cells: dict[str, dict] = {}
        for e in totals:
            if e["tag"] == "td":
                for label in e["classes"]:
                    cells.setdefault(label, e)
        for column, label in CELL_CLASSES.items():
            out[f"{side}_{column}"] = words_of(page, cells.get(label))
    return out


def _team(side: str) -> Column:
    return path_segment(f"{side}_href", 2).try_cast("bigint")


def _numbers(side: str) -> list[Column]:
    """All numbers a side must have, null where its text is none."""
    paired = [n for c in _PAIRED for n in made_and_attempted(f"{side}_{c}")]
    return paired + [F.col(f"{side}_{c}").try_cast("int") for c in (*CELL_CLASSES, "score") if c not in _PAIRED]


def page_status(cells: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """One status per scraped game; the first reason that applies wins.

    ``teams`` (foreign_id, team_id) says which ids are known and adds their translation as ``home_team`` and
    ``away_team``; without it any number will do.
    """
    known = []
    for side in ("home", "away"):
        if teams is None:
            known.append(_team(side))
            continue
        ids = teams.select(F.col("foreign_id").alias(f"{side}_foreign"), F.col("team_id").alias(f"{side}_team"))
        # Rows without an id get one of their own that no team has, so they do not meet on one partition.
        key = F.coalesce(_team(side), -1 - F.pmod(F.xxhash64("game_id"), F.lit(1 << 40)))
        cells = cells.withColumn(f"{side}_foreign", key).join(ids, f"{side}_foreign", "left").drop(f"{side}_foreign")
        known.append(F.col(f"{side}_team"))

    def lacks(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(v.isNull(), True) for v in values], F.lit(False))

    status = (
        F.when(F.col("away_href").isNull(), NO_AWAY_TEAM)
        .when(F.col("home_href").isNull(), NO_HOME_TEAM)
        .when((F.col("home_pts") == "--") | (F.col("away_pts") == "--"), DASHES_SKIPPED)
        .when(lacks(_numbers("home") + _numbers("away")), MISSING_CELLS)
        .when(overtimes("status_text").isNull(), NOT_FINAL)
        .when(title_date("title").isNull(), BAD_TITLE)
        .when(lacks(known), UNKNOWN_TEAM)
        .otherwise(DOWNLOADED)
    )
    return cells.withColumn("status", status)


def rejected(cells: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Quarantine: the scraped rows that make no game, with the reason."""
    return page_status(cells, teams).filter(F.col("status") != DOWNLOADED)


def orient(cells: DataFrame) -> DataFrame:
    """Home/away cells as winner/loser cells; a tie counts as an away win, so the location is H or A.

    Without two scores there is neither winner nor loser, and everything of both is null.
    """
    home_won = F.col("home_score").try_cast("int") > F.col("away_score").try_cast("int")
    names = [c.removeprefix("home_") for c in cells.columns if c.startswith("home_")]
    rest = [c for c in cells.columns if not c.startswith(("home_", "away_"))]

    def sides(winner: bool) -> list[Column]:
        return [
            F.when(home_won == F.lit(winner), F.col(f"home_{c}")).when(home_won != F.lit(winner), F.col(f"away_{c}")).alias(
                f"{'w' if winner else 'l'}_{c}"
            )
            for c in names
        ]

    return cells.select(*rest, F.when(home_won, "H").when(~home_won, "A").alias("w_loc"), *sides(True), *sides(False))


def typed_games(oriented: DataFrame, season: int | None = None, start: str | None = None) -> DataFrame:
    """Typed game rows from oriented cells: ids, scores, day, overtimes and both sides' counts.

    ``season`` and its first day ``start`` (an ISO date) are those of the batch; without them the calendar year of
    the game is its season.
    """
    date = title_date("title")
    first = F.make_date(F.year(date), F.lit(1), F.lit(1)) if start is None else F.lit(start).cast("date")
    translated = "w_team" in oriented.columns

    def side(s: str) -> list[Column]:
        fgm, fga = made_and_attempted(f"{s}_fg")
        fgm3, fga3 = made_and_attempted(f"{s}_fg3")
        ftm, fta = made_and_attempted(f"{s}_ft")
        parsed = {"fgm": fgm, "fga": fga, "fgm3": fgm3, "fga3": fga3, "ftm": ftm, "fta": fta}
        return [(parsed[c] if c in parsed else F.col(f"{s}_{c}").try_cast("int")).alias(f"{s}_{c}") for c in STATS]

    return oriented.select(
        "game_id",
        (F.year(date) if season is None else F.lit(season)).alias("season"),
        day_number(date, first).alias("day_num"),
        (F.col("w_team") if translated else _team("w")).alias("w_id"),
        F.col("w_pts").try_cast("int").alias("w_score"),
        (F.col("l_team") if translated else _team("l")).alias("l_id"),
        F.col("l_pts").try_cast("int").alias("l_score"),
        "w_loc",
        overtimes("status_text").alias("num_ot"),
        *side("w"),
        *side("l"),
    )


def pending(cells: DataFrame, ledger: DataFrame, key: str = "game_id", retry: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key the ledger does not hold; statuses in ``retry`` do not count as done."""
    done = ledger.filter(~F.col("status").isin(*retry)) if retry else ledger
    return cells.join(done.select(key), key, "left_anti")


def process(
    cells: DataFrame, season: int | None = None, start: str | None = None, teams: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(typed games of the complete rows, status per key); with ``teams`` their ids are translated."""
    checked = page_status(cells, teams)
    good = typed_games(orient(checked.filter(F.col("status") == DOWNLOADED).drop("status")), season, start)
    return good, checked.select("game_id", "status")


def _one_per_game(rows: DataFrame) -> DataFrame:
    """The least row of each game, so that copies and reruns agree."""
    rest = F.struct(*[c for c in rows.columns if c != "game_id"])
    return rows.groupBy("game_id").agg(F.min(rest).alias("row")).select("game_id", "row.*")


def run_ingest(
    spark: SparkSession, cells: DataFrame, results_path: str, ledger_path: str, retry: tuple[str, ...] = (),
    season: int | None = None, start: str | None = None, teams: DataFrame | None = None,
) -> None:
    """Append the new games, then their statuses; a game scraped twice counts once.

    A crash between the two appends repeats the batch; :func:`read_results` and :func:`read_ledger`
    drop the copies.
    """
    ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    batch = cut_lineage(_one_per_game(pending(cells, ledger, retry=retry)))
    games, statuses = process(batch, season, start, teams)
    games.write.mode("append").parquet(results_path)
    statuses.write.mode("append").parquet(ledger_path)


def game_store(spark: SparkSession, path: str) -> Store:
    """Results and ledger as tables that change together."""
    results = StructType([f for f in GAME_LOG.fields if f.name != "league"])
    return Store(spark, path, "game_id", {"results": results, "ledger": LEDGER})


def ingest_into(
    store: Store, cells: DataFrame, retry: tuple[str, ...] = (), season: int | None = None, start: str | None = None,
    teams: DataFrame | None = None, before_log: Callable[[], None] = lambda: None,
) -> int:
    """Rate the pages the ledger does not hold, or holds with a status in ``retry``, and commit games and statuses at once.

    Returns the version of the store; without new pages it stays. A game scraped twice counts once.
    """
    batch = cut_lineage(_one_per_game(pending(cells, store.read("ledger"), retry=retry)))
    if batch.isEmpty():
        return store.version()
    games, statuses = process(batch, season, start, teams)
    return store.commit({"results": games, "ledger": statuses}, before_log)


def read_results(spark: SparkSession, results_path: str) -> DataFrame:
    """One row per game."""
    return _one_per_game(spark.read.parquet(results_path))


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """One status per game: once downloaded it stays so, whatever was retried before."""
    done = F.max(F.when(F.col("status") == DOWNLOADED, DOWNLOADED))
    rows = spark.read.schema(LEDGER).parquet(ledger_path)
    return rows.groupBy("game_id").agg(F.coalesce(done, F.max("status")).alias("status"))
