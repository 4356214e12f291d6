"""Ledger, retries, re-runs and the streaming form of the ingest."""



from pyspark.sql import functions as F

from courtline.functions import text
from courtline.operators import ingest
from courtline.schemas import LEDGER
from courtline.storage import new_path
from courtline.streaming.box_scores import accepted_games, ingest_available
from tests_plan import stored_cells


def test_second_run_adds_nothing(spark, small):
    results, ledger = new_path(spark, "results"), new_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(ledger)
    cells = stored_cells(spark, small)
    ingest.run_ingest(spark, cells, results, ledger)
    first = (ingest.read_results(spark, results).count(), ingest.read_ledger(spark, ledger).count())
    ingest.run_ingest(spark, cells, results, ledger)
    assert (ingest.read_results(spark, results).count(), ingest.read_ledger(spark, ledger).count()) == first
    assert first[1] == cells.count()
    assert spark.read.parquet(ledger).count() == first[1]


def test_crash_between_the_appends_is_harmless(spark, small):
    results, ledger = new_path(spark, "results"), new_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(ledger)
    cells = stored_cells(spark, small)
    ingest.process(cells)[0].write.mode("append").parquet(results)
    expected = spark.read.parquet(results).count()
    ingest.run_ingest(spark, cells, results, ledger)
    assert spark.read.parquet(results).count() == 2 * expected
    assert ingest.read_results(spark, results).count() == expected


def test_retryable_statuses(spark, small):
    cells = stored_cells(spark, small)
    ledger = ingest.page_status(cells).select("game_id", "status")
    assert ingest.pending(cells, ledger).count() == 0
    again = ingest.pending(cells, ledger, retry=("DashesSkipped",))
    assert again.count() == ledger.filter("status = 'DashesSkipped'").count() > 0


def test_a_tie_is_an_away_win(spark):
    row = spark.createDataFrame([("7", "7", "h", "a")], "home_score string, away_score string, home_x string, away_x string")
    got = ingest.orient(row).first()
    assert (got.w_loc, got.w_x, got.l_x) == ("A", "a", "h")


def test_broken_cells_make_no_game(spark, small):
    cells = stored_cells(spark, small)
    games, statuses = ingest.process(cells)
    assert games.filter("w_id is null or l_id is null or w_id = l_id or w_score is null or l_score is null").count() == 0
    seen = {r.status for r in statuses.select("status").distinct().collect()}
    assert {"MissingCells", "NotFinal", "BadTitle", "UnknownTeam", "Downloaded"} <= seen
    assert ingest.rejected(cells).count() + games.count() == cells.count() == statuses.count()
    row = spark.createDataFrame([(None, "7", "h", "a"), ("--", "7", "h", "a")], "home_score string, away_score string, home_x string, away_x string")
    assert {(r.w_loc, r.w_x, r.l_x) for r in ingest.orient(row).collect()} == {(None, None, None)}


def test_a_retried_game_has_one_status(spark):
    ledger = new_path(spark, "ledger")
    spark.createDataFrame([(1, "DashesSkipped"), (1, "Downloaded"), (2, "NotFinal")], LEDGER).write.parquet(ledger)
    assert {tuple(r) for r in ingest.read_ledger(spark, ledger).collect()} == {(1, "Downloaded"), (2, "NotFinal")}


def test_stream_reads_each_file_once(spark, small):
    cells = stored_cells(spark, small)
    folder, out, state = (new_path(spark, n) for n in ("incoming", "accepted", "state"))
    ledger = spark.createDataFrame([], LEDGER)
    cells.filter("game_id % 2 = 0").coalesce(1).write.parquet(folder)
    run = lambda: ingest_available(spark, folder, cells.schema, ledger, out, state).awaitTermination()
    run()
    once = spark.read.parquet(out).count()
    run()
    assert spark.read.parquet(out).count() == once
    cells.filter("game_id % 2 = 1").coalesce(1).write.mode("append").parquet(folder)
    run()
    want = ingest.process(cells)[0]
    assert spark.read.parquet(out).count() == cells.count()
    assert accepted_games(spark, out).exceptAll(want).count() == 0 == want.exceptAll(accepted_games(spark, out)).count()


def test_links_and_cells(spark):
    html = '<title>T</title><a class="x" href="/a?gameId=7">one</a><a href="/b">two</a><a class="x" href="/a?gameId=7">one</a>'
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string")
    assert [tuple(r) for r in ingest.links(pages, "gameId=").collect()] == [("one", "/a?gameId=7")]
    got = {r.page_id: r for r in ingest.labelled_text(pages).collect()}
    assert got[1].title == "T" and got[1].cell is None and got[2].title is None


def test_cells_are_cut_without_arrays(spark):
    """Numbers and link parts are those of a split at every dash and slash, but no array is made for each of them."""
    said = ["27-55", "7", "", "-", "3-", "-4", "1-2-3", " 1 - 2 ", "a-b", "--", None, "/team/_/id/12/x", "12/x", "x", "/", "//", "a/b/", "\u00e9-5/\u00e9"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    made, attempted = text.made_and_attempted("s")
    parts = [text.path_segment("s", n).alias(f"p{n}") for n in (1, 2, 3)]
    found = rows.select("i", made.alias("made"), attempted.alias("attempted"), *parts)
    dashes, slashes = F.split("s", "-"), F.split("s", "/")
    wanted = rows.select(
        "i", F.get(dashes, F.lit(0)).try_cast("int"), F.get(dashes, F.lit(1)).try_cast("int"),
        *[F.try_element_at(slashes, F.lit(-n)) for n in (1, 2, 3)],
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert "split(" not in found._jdf.queryExecution().analyzed().toString()
