"""Queries: lookups, interval and as-of joins, histories, matchups and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.catalog.ctes import sql
from courtline.catalog.registry import CUTOFF_DAY, FEATURE_DAY, query, rating_history, trailing_table
from courtline.catalog.shaping import ROLLING_SQL, field_pairs, rounded
from courtline.functions.text import path_segment
from courtline.operators.asof import asof_join
from courtline.operators.games import team_games
from courtline.operators.history import recent_games, steps, with_both_histories
from courtline.operators.ingest import pending
from courtline.operators.lookups import both_names, coach_on_day, covering, latest, side_of_day, team_ids
from courtline.operators.matching import match_names, review_candidates
from courtline.operators.matchups import orientations
from courtline.operators.ratings import rating_before, two_sided
from courtline.plans.features import latest_trailing, past_features, side_columns, upcoming_field_features
from courtline.plans.models import merge_scores
from courtline.plans.sequences import HISTORY, sequence_games
from courtline.schemas import TRAILING
from courtline.sources import tables as t

NUMERIC = [f"{s}_{c}" for s in ("w", "l") for c in TRAILING]
ELO = ["w_elo", "l_elo"]
_TRAILING_SQL = ", ".join(f"round({s}.{c}, 6) as {s}_{c}" for s in ("w", "l") for c in TRAILING)


@query("j1_both_names", sql(
    """select c.game_id, w.team_name as w_name, l.team_name as l_name from contests c
    left join teams w on w.team_id = c.w_id left join teams l on l.team_id = c.l_id""", "contests", "teams"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "w_id", "l_id")
    return both_names(games, t.teams(spark, sf)).select("game_id", "w_name", "l_name")


@query("j2_inner_lookup", sql(
    """select p.league, p.season, p.orientation, p.w_id, w.team_name as w_name, p.l_id, l.team_name as l_name from (
        select league, season, 1 as orientation, team_1 as w_id, team_2 as l_id from pairs
        union all select league, season, 2, team_2, team_1 from pairs) p
    join teams w on w.team_id = p.w_id join teams l on l.team_id = p.l_id""", "pairs", "teams"))
def _(spark, sf):
    named = both_names(orientations(field_pairs(spark, sf)), t.teams(spark, sf), how="inner")
    return named.select("league", "season", "orientation", "w_id", "w_name", "l_id", "l_name")


@query("j3_four_key_lookup", sql(
    """select c.game_id, v.cr_type, v.city_id from contests c left join venues v
    on v.season = c.season and v.day_num = c.day_num and v.w_id = c.w_id and v.l_id = c.l_id""", "contests", "venues"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "season", "day_num", "w_id", "l_id")
    return games.join(t.venues(spark, sf), ["season", "day_num", "w_id", "l_id"], "left").select("game_id", "cr_type", "city_id")


@query("j4_open_lines", """
    with lines as (select l.l_suppkey as supplier, l.l_quantity as quantity, date_diff('day', date '1970-01-01', o.o_orderdate::date) as first_day,
        date_diff('day', date '1970-01-01', l.l_shipdate::date) as last_day from lineitem l join orders o on o.o_orderkey = l.l_orderkey),
    days as (select distinct supplier, last_day as day from lines)
    select d.supplier, d.day, count(n.quantity) as n_open, sum(n.quantity) as quantity from days d left join lines n
    on n.supplier = d.supplier and d.day between n.first_day and n.last_day group by d.supplier, d.day""")
def _(spark, sf):
    """Lines that are ordered and not yet gone on each day a supplier ships: thousands of long intervals a key."""
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate").join(orders, "l_orderkey").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"),
        number("o_orderdate").alias("first_day"), number("l_shipdate").alias("last_day"),
    )
    days = lines.select("supplier", F.col("last_day").alias("day")).distinct()
    held = covering(days, lines, ["supplier"], "day", "first_day", "last_day")
    return held.groupBy("supplier", "day").agg(F.count("quantity").alias("n_open"), F.sum("quantity").alias("quantity"))


@query("j3_rating_lookup", sql(
    """select c.game_id, round(r.w_elo, 3) as w_elo, round(r.l_elo, 3) as l_elo from contests c
    left join ratings r on r.league = c.league and r.game_id = c.game_id""", "contests", "ratings"))
def _(spark, sf):
    ratings = rating_history(spark, sf).select("league", "game_id", "w_elo", "l_elo")
    joined = t.game_log(spark, sf).select("league", "game_id").join(ratings, ["league", "game_id"], "left")
    return rounded(joined.drop("league"), ELO, 3)


@query("j4_interval_join", sql(
    """select c.game_id, w.coach as w_coach, l.coach as l_coach from contests c
    left join tenures w on w.season = c.season and w.team = c.w_id and c.day_num between w.first_day and w.last_day
    left join tenures l on l.season = c.season and l.team = c.l_id and c.day_num between l.first_day and l.last_day""",
    "contests", "tenures"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "season", "day_num", "w_id", "l_id")
    tenures = t.tenures(spark, sf)
    out = coach_on_day(coach_on_day(games, tenures, "w_id", "w_coach"), tenures, "l_id", "l_coach")
    return out.select("game_id", "w_coach", "l_coach")


@query("j6_trailing_both_sides", sql(
    f"""select c.game_id, {_TRAILING_SQL} from contests c
    left join rolling w on w.season = c.season and w.day_num = c.day_num and w.team = c.w_id and w.outcome = 'W'
    left join rolling l on l.season = c.season and l.day_num = c.day_num and l.team = c.l_id and l.outcome = 'L'""",
    "contests", "rolling"))
def _(spark, sf):
    games = t.game_log(spark, sf).select("game_id", "season", "day_num", "w_id", "l_id")
    stats = trailing_table(spark, sf)
    out = side_of_day(side_of_day(games, stats, "w"), stats, "l")
    return rounded(out.select("game_id", *NUMERIC), NUMERIC)


@query("j7_latest_coach", sql(
    """select t.season, t.team, t.coach from tenures t
    join (select season, team, max(last_day) as d from tenures group by season, team) m
    on m.season = t.season and m.team = t.team and m.d = t.last_day""", "tenures"))
def _(spark, sf):
    return latest(t.tenures(spark, sf), ["season", "team"], "last_day").select("season", "team", "coach")


@query("j7_latest_rating", sql(
    "select league, season, team, elo_day, round(elo, 3) as elo from elo_before", "elo_before", cutoff=CUTOFF_DAY))
def _(spark, sf):
    return rounded(rating_before(rating_history(spark, sf), CUTOFF_DAY), ["elo"], 3)


@query("j7_latest_trailing", sql(
    f"""select {ROLLING_SQL} from (select *, rank() over (partition by season, team order by day_num desc) as rk
    from rolling where day_num < {CUTOFF_DAY}) where rk = 1""", "rolling"))
def _(spark, sf):
    return rounded(latest(trailing_table(spark, sf), ["season", "team"], "day_num", before=CUTOFF_DAY), TRAILING)


_ASOF_SQL = {
    "elo": """asof left join (select league, season, team, day_num, max(elo) as elo from team_ratings group by all) e
        on e.league = f.league and e.season = f.season and e.team = f.team and f.day_num > e.day_num""",
    "trailing": """asof left join (select * from rolling where outcome = 'W' or (season, team, day_num) not in
            (select season, team, day_num from rolling where outcome = 'W')) s
        on s.season = f.season and s.team = f.team and f.day_num > s.day_num""",
    "coach": "asof left join tenures t on t.season = f.season and t.team = f.team and f.day_num > t.first_day",
}


@query("j7_asof_rating", sql(
    f"""select f.game_id, f.league, f.season, f.day_num, f.team, e.day_num as elo_day, round(e.elo, 3) as elo
    from facts f {_ASOF_SQL['elo']}""", "facts", "team_ratings"))
def _(spark, sf):
    """Both sides of every game with the rating they took into their latest game of an earlier day."""
    sides = t.facts(spark, sf, stats=(), opponent=False).select("game_id", "league", "season", "day_num", "team")
    known = two_sided(rating_history(spark, sf)).withColumn("elo_day", F.col("day_num"))
    found = asof_join(sides, known, ["league", "season", "team"], "day_num", "elo_day", {"elo_day": "elo_day", "elo": "elo"}, width=64)
    return rounded(found, ["elo"], 3)


@query("j8_asof_features", sql(
    f"""select f.game_id, f.season, f.day_num, f.team, t.coach, round(e.elo, 3) as elo,
        {', '.join(f'round(s.{c}, 6) as {c}' for c in TRAILING)}
    from facts f {_ASOF_SQL['elo']} {_ASOF_SQL['trailing']} {_ASOF_SQL['coach']}""", "facts", "team_ratings", "rolling", "tenures"))
def _(spark, sf):
    """Both sides of every game with rating, statistics and coach as known before its own day."""
    sides = t.facts(spark, sf, stats=(), opponent=False).select("game_id", "league", "season", "day_num", "team")
    out = asof_join(sides, two_sided(rating_history(spark, sf)), ["league", "season", "team"], "day_num", "day_num", {"elo": "elo"}, width=64)
    team = ["season", "team"]
    out = asof_join(out, trailing_table(spark, sf), team, "day_num", "day_num", {c: c for c in TRAILING}, width=64)
    out = asof_join(out, t.tenures(spark, sf), team, "day_num", "first_day", {"coach": "coach"})
    return rounded(rounded(out.select("game_id", "season", "day_num", "team", "coach", "elo", *TRAILING), TRAILING), ["elo"], 3)


UPCOMING_ROW_SQL = f"""select p.league, p.season, {FEATURE_DAY} as day_num, p.orientation, p.w_id, wn.team_name as w_name, p.l_id,
        ln.team_name as l_name, 'N' as w_loc, 0 as w_score, 0 as l_score, wc.coach as w_coach, lc.coach as l_coach,
        round(we.elo, 3) as w_elo, round(le.elo, 3) as l_elo, {_TRAILING_SQL}
    from (select league, season, 1 as orientation, team_1 as w_id, team_2 as l_id from pairs
        union all select league, season, 2, team_2, team_1 from pairs) p
    join teams wn on wn.team_id = p.w_id join teams ln on ln.team_id = p.l_id
    left join current_coach wc on wc.season = p.season and wc.team = p.w_id
    left join current_coach lc on lc.season = p.season and lc.team = p.l_id
    left join elo_before we on we.league = p.league and we.season = p.season and we.team = p.w_id
    left join elo_before le on le.league = p.league and le.season = p.season and le.team = p.l_id
    left join current_stats w on w.season = p.season and w.team = p.w_id
    left join current_stats l on l.season = p.season and l.team = p.l_id"""
_UPCOMING_SQL = sql(
    UPCOMING_ROW_SQL, "pairs", "teams", "current_coach", "elo_before", "current_stats", cutoff=CUTOFF_DAY
)


def upcoming(spark, sf):
    return upcoming_field_features(
        t.seeds(spark, sf), t.teams(spark, sf), t.tenures(spark, sf), trailing_table(spark, sf), rating_history(spark, sf),
        CUTOFF_DAY, FEATURE_DAY,
    )


@query("j8_upcoming_features", _UPCOMING_SQL)
def _(spark, sf):
    return rounded(rounded(upcoming(spark, sf), NUMERIC), ELO, 3)


def complete_rows(spark, sf):
    return past_features(t.game_log(spark, sf), t.tenures(spark, sf), trailing_table(spark, sf), rating_history(spark, sf))


FEATURE_ROW_SQL = f"""select c.game_id, c.season, c.day_num, c.w_id, c.l_id, c.w_score, c.l_score, wc.coach as w_coach,
        lc.coach as l_coach, round(r.w_elo, 3) as w_elo, round(r.l_elo, 3) as l_elo, {_TRAILING_SQL}
    from contests c left join ratings r on r.league = c.league and r.game_id = c.game_id
    left join tenures wc on wc.season = c.season and wc.team = c.w_id and c.day_num between wc.first_day and wc.last_day
    left join tenures lc on lc.season = c.season and lc.team = c.l_id and c.day_num between lc.first_day and lc.last_day
    left join rolling w on w.season = c.season and w.day_num = c.day_num and w.team = c.w_id and w.outcome = 'W'
    left join rolling l on l.season = c.season and l.day_num = c.day_num and l.team = c.l_id and l.outcome = 'L'"""
_COMPLETE = " and ".join(f"{c} is not null" for c in [*side_columns("w"), *side_columns("l")])


@query("p5_complete_feature_rows", sql(
    f"select * from ({FEATURE_ROW_SQL}) where {_COMPLETE}", "contests", "ratings", "tenures", "rolling"))
def _(spark, sf):
    return rounded(rounded(complete_rows(spark, sf), NUMERIC), ELO, 3)


def predictions(spark, sf):
    """Stand-in scores: the true ones shifted by a function of the key."""
    key = F.col("game_id")
    return t.game_log(spark, sf).select(
        "game_id", "season", "w_id", "l_id", "w_score", "l_score",
        (F.col("w_score") + key % 5 - 2).cast("double").alias("w_pred"),
        (F.col("l_score") + key % 3 - 1).cast("double").alias("l_pred"),
    )


@query("j9_merge_scores", sql("select game_id, w_id, l_id, w_pred, l_pred from predictions", "predictions"))
def _(spark, sf):
    scored = predictions(spark, sf)
    keys = ["game_id", "w_id", "l_id"]
    return merge_scores(scored.select(*keys, "w_pred"), scored.select(*keys, "l_pred"), keys)


@query("j10_field_pairs", sql("select * from pairs", "pairs"))
def _(spark, sf):
    return field_pairs(spark, sf)


@query("j11_history", sql("select * from history", "history"))
def _(spark, sf):
    facts = t.facts(spark, sf, stats=(), opponent=False).select("game_id", "season", "team", "day_num")
    recent = recent_games(facts, HISTORY)
    return facts.join(recent, ["season", "team", "day_num"]).select(
        "game_id", "season", "team", F.posexplode("recent").alias("step", "h")
    ).select(
        "game_id", "season", "team", (F.col("step") + 1).alias("step"),
        F.col("h.game_id").alias("hist_game"), F.col("h.day_num").alias("hist_day"),
    )


@query("j12_positional_zip", sql(
    "select game_id, team_1, team_2, step, day_1, opp_1, day_2, opp_2 from sequence", "sequence"))
def _(spark, sf):
    games = t.game_log(spark, sf)
    pairs = sequence_games(games, HISTORY, team_games(games, stats=()))
    return steps(pairs, ["game_id", "team_1", "team_2"]).select(
        "game_id", "team_1", "team_2", "step", F.col("a.day_num").alias("day_1"), F.col("a.opp").alias("opp_1"),
        F.col("b.day_num").alias("day_2"), F.col("b.opp").alias("opp_2"),
    )


@query("o2_both_sides_full", sql("select distinct game_id, team_1, team_2, label from sequence", "sequence"))
def _(spark, sf):
    games = t.game_log(spark, sf)
    return sequence_games(games, HISTORY, team_games(games, stats=())).select("game_id", "team_1", "team_2", "label")


@query("j13_pending_pages", sql(
    "select page_id, url from pages where page_id not in (select page_id from page_ledger)", "page_ledger"))
def _(spark, sf):
    pages = t.table(spark, sf, "pages").select("page_id", "url")
    return pending(pages, t.page_ledger(spark, sf), key="page_id")


def _foreign_ids(spark, sf):
    sides = F.array(*[
        F.struct(F.lit(s).alias("side"), path_segment(f"{s}_href", 2).try_cast("bigint").alias("foreign_id"))
        for s in ("home", "away")
    ])
    rows = t.box_cells(spark, sf).select("game_id", "home_href", "away_href").select("game_id", F.inline(sides))
    return team_ids(rows, "foreign_id", t.teams(spark, sf))


_FOREIGN_SQL = """select f.game_id, f.side, f.foreign_id{extra} from (
    select game_id, 'home' as side, try_cast(string_split(home_href, '/')[-2] as bigint) as foreign_id from cells
    union all select game_id, 'away', try_cast(string_split(away_href, '/')[-2] as bigint) from cells) f
    left join teams t on t.team_id = f.foreign_id where t.team_id is {test}"""


@query("j14_foreign_ids", sql(_FOREIGN_SQL.format(extra=", t.team_id", test="not null"), "cells", "teams"))
def _(spark, sf):
    return _foreign_ids(spark, sf)[0]


@query("j14_foreign_id_misses", sql(_FOREIGN_SQL.format(extra="", test="null"), "cells", "teams"))
def _(spark, sf):
    return _foreign_ids(spark, sf)[1]


_MATCHED = """select l.name, coalesce(m.stage, 0) as stage, m.key, coalesce(m.matches, 0) as matches,
    case when m.matches = 1 then m.candidate end as "match", coalesce(m.matches, 0) > 1 as ambiguous from name_left l left join (
        select name, max(stage) as stage, max(key) as key, count(*) as matches, min(candidate) as candidate
        from match_pairs group by name) m on m.name = l.name"""


@query("j15_name_match", sql(_MATCHED, "name_left", "match_pairs"))
def _(spark, sf):
    return match_names(*t.name_lists(spark, sf))


@query("j15_parts_matched", sql(
    f"select p.p_partkey, p.p_name, m.stage, m.matches from part p join ({_MATCHED}) m on m.name = p.p_name", "name_left", "match_pairs"))
def _(spark, sf):
    """Every part row with the outcome of its name's match."""
    parts = t.table(spark, sf, "part").select("p_partkey", "p_name")
    found = match_names(*t.name_lists(spark, sf)).select(F.col("name").alias("p_name"), "stage", "matches")
    return parts.join(found, "p_name").select("p_partkey", "p_name", "stage", "matches")


@query("j15_review_candidates", sql(
    """select distinct key, candidate from match_pairs where name in (
        select name from match_pairs group by name having count(*) > 1)""", "match_pairs"))
def _(spark, sf):
    names, candidates = t.name_lists(spark, sf)
    return review_candidates(match_names(names, candidates), candidates)
