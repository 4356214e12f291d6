"""Queries: page parsing, scraped box scores, text and date functions, incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.catalog.ctes import sql
from courtline.catalog.registry import query
from courtline.functions import text
from courtline.operators import ingest
from courtline.sources import tables as t
from courtline.storage import new_path

# Fixed value: hrefs with this marker are kept.
MARKER = "/t"
# The given pages have no nested anchors, titles or headings, and few kinds of character references.
_ANCHOR = '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def _decoded_sql(value: str) -> str:
    """White space as one space and character references decoded, as far as the given pages have them."""
    for reference, character in (("copy", "\u00a9"), ("middot", "\u00b7"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        value = f"regexp_replace({value}, '&{reference};?', '{character}', 'g')"
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"


_LINKS_SQL = f"""select distinct {_decoded_sql('text')} as text, {_decoded_sql('href')} as href from (
    select unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) as text, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) as href
    from pages)"""


def _first_sql(pattern: str) -> str:
    return _decoded_sql(f"regexp_extract_all(html, '{pattern}', 1)[1]")


@query("f2_made_attempted", sql(
    """select game_id, try_cast(string_split(home_fg, '-')[1] as int) as made, try_cast(string_split(home_fg, '-')[2] as int) as attempted
    from cells""", "cells"))
def _(spark, sf):
    made, attempted = text.made_and_attempted("home_fg")
    return t.box_cells(spark, sf).select("game_id", made.alias("made"), attempted.alias("attempted"))


@query("f3_url_parts", """select page_id, string_split(url, '/')[-2] as segment, string_split(url, '=')[2] as query_value from pages""")
def _(spark, sf):
    return t.table(spark, sf, "pages").select(
        "page_id", text.path_segment("url", 2).alias("segment"), text.query_value("url").alias("query_value")
    )


@query("f4_contains_and_regex", """select page_id, contains(url, 'example.org') as on_org, contains(url, '.') as literal_dot,
    regexp_matches(url, '/(en|es)/[0-9]+') as numbered, contains(html, '<h1>') as has_heading from pages""")
def _(spark, sf):
    return t.table(spark, sf, "pages").select(
        "page_id", F.contains("url", F.lit("example.org")).alias("on_org"), F.contains("url", F.lit(".")).alias("literal_dot"),
        F.col("url").rlike("/(en|es)/[0-9]+").alias("numbered"), F.contains("html", F.lit("<h1>")).alias("has_heading"),
    )


@query("f5_longest_token", """select p_partkey, name, list_filter(string_split(name, ' '), lambda t: length(t) =
    list_max(list_transform(string_split(name, ' '), lambda u: length(u))))[1] as token
    from (select p_partkey, p_name || ' ' || p_type as name from part)""")
def _(spark, sf):
    parts = t.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return parts.withColumn("token", text.longest_token("name"))


@query("f6_overtimes", sql(
    "select game_id, case status_text when 'Final' then 0 when 'Final/OT' then 1 when 'Final/2OT' then 2 end as num_ot from cells", "cells"))
def _(spark, sf):
    return t.box_cells(spark, sf).select("game_id", text.overtimes("status_text").alias("num_ot"))


@query("f7_title_day", sql(
    """select game_id, d as game_date, cast(date_diff('day', date '1994-11-04', d) as int) as day_num from (
    select game_id, cast(try_strptime(string_split(title, ' - ')[3], '%B %-d, %Y') as date) as d from cells)""", "cells"))
def _(spark, sf):
    date = text.title_date("title")
    start = F.lit("1994-11-04").cast("date")
    return t.box_cells(spark, sf).select("game_id", date.alias("game_date"), text.day_number(date, start).alias("day_num"))


@query("f8_day_arithmetic", """select o_orderkey, cast(date_diff('day', date '1994-11-05', cast(o_orderdate as date)) as int) as day_num,
    cast(date '1994-11-05' + cast(o_orderkey % 400 as int) as date) as day_date from orders""")
def _(spark, sf):
    start = F.lit("1994-11-05").cast("date")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", text.day_number(F.col("o_orderdate").cast("date"), start).alias("day_num"),
        text.day_date((F.col("o_orderkey") % 400).cast("int"), start).alias("day_date"),
    )


@query("h1_links", f"select * from ({_LINKS_SQL}) where contains(href, '{MARKER}')")
def _(spark, sf):
    return ingest.links(t.table(spark, sf, "pages"), MARKER)


@query("h1_links_all", _LINKS_SQL)
def _(spark, sf):
    return ingest.links(t.table(spark, sf, "pages"), "")


@query("h2_labelled_text", f"""select page_id, {_first_sql('<title>([^<]*)</title>')} as title, {_first_sql('<h1>([^<]*)</h1>')} as heading,
    {_first_sql('<div class="ad">([^<]*)</div>')} as cell from pages""")
def _(spark, sf):
    return ingest.labelled_text(t.table(spark, sf, "pages"))


@query("h2_box_score_cells", sql("select * from cells", "cells"))
def _(spark, sf):
    """Cells parsed back out of whole stored pages."""
    return ingest.box_score_cells(t.box_pages(spark, sf))


@query("h3_oriented_cells", sql(
    """select game_id, case when home_won then 'H' when not home_won then 'A' end as w_loc, w_href, l_href, w_score, l_score, w_pts, l_pts, w_fg, l_fg
    from oriented""", "oriented"))
def _(spark, sf):
    return ingest.orient(t.box_cells(spark, sf)).select(
        "game_id", "w_loc", "w_href", "l_href", "w_score", "l_score", "w_pts", "l_pts", "w_fg", "l_fg"
    )


@query("h4_status", sql("select game_id, status from checked", "checked"))
def _(spark, sf):
    return ingest.page_status(t.box_cells(spark, sf)).select("game_id", "status")


@query("h4_quarantine", sql("select game_id, status, title, status_text, home_score, away_score from checked where status <> 'Downloaded'", "checked"))
def _(spark, sf):
    return ingest.rejected(t.box_cells(spark, sf)).select("game_id", "status", "title", "status_text", "home_score", "away_score")


# Ids of teams with a negative budget are unknown; the others are stored as their number in the roster plus a million.
@query("h5_translated_games", sql("""select * replace (w_id + 1000000 as w_id, l_id + 1000000 as l_id, cast(1994 as int) as season,
    cast(day_num + date_diff('day', date '1994-11-04', make_date(season, 1, 1)) as int) as day_num) from typed
    where w_id in (select team_id from teams where budget >= 0) and l_id in (select team_id from teams where budget >= 0)""", "typed", "teams"))
def _(spark, sf):
    """Games with their ids translated, of a season that is given with its first day."""
    known = t.teams(spark, sf).filter("budget >= 0").select(F.col("team_id").alias("foreign_id"), (F.col("team_id") + 1_000_000).alias("team_id"))
    return ingest.process(t.box_cells(spark, sf), 1994, "1994-11-04", known)[0]


@query("h5_typed_games", sql("select * from typed", "typed"))
def _(spark, sf):
    return ingest.process(t.box_cells(spark, sf))[0]


def _ingested(spark, sf):
    """One ingest on top of a ledger with earlier runs in it; results and statuses are committed together."""
    store = ingest.game_store(spark, new_path(spark, "games"))
    store.commit({"ledger": t.game_ledger(spark, sf)})
    ingest.ingest_into(store, t.box_cells(spark, sf))
    return store


@query("s9_ingest_results", sql("select * from typed where game_id not in (select game_id from ledger)", "typed", "ledger"))
def _(spark, sf):
    return _ingested(spark, sf).read("results")


@query("s9_ingest_ledger", sql(
    """select game_id, status from ledger union
    select game_id, status from checked where game_id not in (select game_id from ledger)""", "ledger", "checked"))
def _(spark, sf):
    return _ingested(spark, sf).read("ledger")
