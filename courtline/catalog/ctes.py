"""Shared SQL building blocks of the comparison queries, in plain ANSI style.

They state the intended results independently of the Spark plans: self-joins where the plans use
windows, a recursive query where the plans fold, row numbers where the plans aggregate.
"""

from __future__ import annotations

from courtline.schemas import AVERAGED, RATIOS, STATS


def each(template: str, names=STATS, sep: str = ", ") -> str:
    return sep.join(template.format(s=s) for s in names)


def _line_stats(a: str, side: str) -> str:
    exprs = {
        "fgm": f"{a}.l_linenumber", "fga": f"cast({a}.l_quantity as int)", "fgm3": f"{a}.l_linenumber % 4",
        "fga3": f"cast({a}.l_quantity as int) % 17", "ftm": f"{a}.l_partkey % 10",
        "fta": f"{a}.l_partkey % 10 + {a}.l_suppkey % 5", "oreb": f"{a}.l_partkey % 11", "dreb": f"{a}.l_partkey % 23",
        "ast": f"{a}.l_partkey % 19", "tov": f"{a}.l_partkey % 17", "stl": f"{a}.l_partkey % 9",
        "blk": f"{a}.l_partkey % 7", "pf": f"{a}.l_partkey % 21",
    }
    return ", ".join(f"cast({e} as int) as {side}_{n}" for n, e in exprs.items())


def _facts_side(own: str, other: str, outcome: str) -> str:
    return (
        f"select game_id, league, season, day_num, {own}_id as team, {other}_id as opp, '{outcome}' as outcome, "
        f"{own}_score as score, {each(own + '_{s} as {s}')}, {other}_score as opp_score, {each(other + '_{s} as opp_{s}')} "
        "from contests"
    )


def _cell(side: str) -> str:
    own, other = ("w", "l") if side == "home" else ("l", "w")

    def pick(c: str) -> str:
        return f"case when w_loc = 'H' then {own}_{c} else {other}_{c} end"

    def dashed(a: str, b: str) -> str:
        return f"concat({pick(a)}, '-', {pick(b)})"

    plain = ", ".join(f"cast({pick(c)} as varchar) as {side}_{c}" for c in ("oreb", "dreb", "ast", "stl", "blk", "tov", "pf"))
    return (
        f"{dashed('fgm', 'fga')} as {side}_fg, {dashed('fgm3', 'fga3')} as {side}_fg3, {dashed('ftm', 'fta')} as {side}_ft, "
        f"{plain}, cast({pick('score')} as varchar) as {side}_score, "
        f"case when game_id % 11 = 0 then '--' else cast({pick('score')} as varchar) end as {side}_pts"
    )


def _href(side: str, missing: int) -> str:
    own, other = ("w", "l") if side == "home" else ("l", "w")
    return (
        f"case when game_id % {missing} <> 0 then concat('/team/_/id/', case when w_loc = 'H' then {own}_id else {other}_id end, '/x') "
        f"end as {side}_href"
    )


def _rolling_aggs(precision: int | None = None) -> str:
    avgs = [f"avg(h.{c}) as avg_{c}" for c in AVERAGED]
    ratios = [f"sum(h.{m}) / nullif(sum(h.{t}), 0) as {o}" for o, m, t in RATIOS]
    return ", ".join(avgs + ratios)


_UPDATE = (
    "22.0 * pow(g.w_score - g.l_score + 3.0, 0.8) / (7.5 + 0.006 * {diff}) * (1.0 - 1.0 / (pow(10.0, -({diff}) / 400.0) + 1.0))"
)
_DIFF = (
    "(({w} + case when g.w_loc = 'H' then 100.0 else 0.0 end) - ({l} + case when g.w_loc = 'A' then 100.0 else 0.0 end))"
)


def diff_sql(w: str, l: str) -> str:
    return _DIFF.format(w=w, l=l)


def update_sql(w: str, l: str) -> str:
    return _UPDATE.format(diff=diff_sql(w, l))


def pred_sql(w: str, l: str) -> str:
    return f"1.0 / (pow(10.0, -({diff_sql(w, l)}) / 400.0) + 1.0)"


def _history(day_join: str, n: int) -> str:
    return f"row_number() over (partition by {day_join} order by h.day_num desc, h.game_id desc)"


# name -> (names it needs, query)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
        select *, row_number() over (partition by l_orderkey
            order by l_extendedprice desc, l_linenumber, l_suppkey, l_partkey, l_quantity, l_returnflag) as rn
        from lineitem"""),
    "winners": (("lines",), "select * from lines where rn = 1"),
    "losers": (("lines", "winners"), """
        select * from (
            select l.*, row_number() over (partition by l.l_orderkey order by l.rn) as place
            from lines l join winners w on w.l_orderkey = l.l_orderkey where l.l_suppkey <> w.l_suppkey
        ) where place = 1"""),
    "contests": (("winners", "losers"), f"""
        select w.l_orderkey as game_id, o.o_orderpriority as league, cast(year(o.o_orderdate) as int) as season,
            cast(dayofyear(o.o_orderdate) - 1 as int) as day_num,
            w.l_suppkey as w_id, cast(floor(w.l_extendedprice / 1000) as int) as w_score,
            x.l_suppkey as l_id, cast(floor(x.l_extendedprice / 1000) as int) as l_score,
            case w.l_returnflag when 'R' then 'H' when 'A' then 'A' else 'N' end as w_loc,
            cast(w.l_orderkey % 3 as int) as num_ot, {_line_stats('w', 'w')}, {_line_stats('x', 'l')}
        from winners w join losers x on w.l_orderkey = x.l_orderkey join orders o on o.o_orderkey = w.l_orderkey"""),
    "facts": (("contests",), _facts_side("w", "l", "W") + " union all " + _facts_side("l", "w", "L")),
    "ranked": (("facts",), "select *, rank() over (partition by season, team order by day_num) as game_rank from facts"),
    "rolling": (("ranked",), f"""
        select g.season, g.day_num, g.team, g.outcome, {_rolling_aggs()}
        from ranked g left join ranked h
            on h.season = g.season and h.team = g.team and h.game_rank < g.game_rank and h.game_rank >= g.game_rank - 3
        group by g.season, g.day_num, g.team, g.outcome"""),
    "teams": ((), "select s_suppkey as team_id, s_name as team_name, s_acctbal as budget from supplier"),
    "tenures": (("facts", "teams"), """
        select season, team, 0 as first_day, cast(100 + team % 200 as int) as last_day, concat('Coach#', team % 40) as coach
        from (select distinct season, team from facts)
        union all
        select season, team, cast(101 + team % 200 as int), 365, concat('Coach#', team % 40 + 40)
        from (select distinct season, team from facts) f join teams t on t.team_id = f.team where t.budget >= 1000"""),
    "venues": (("contests",), """
        select season, day_num, w_id, l_id,
            min(case when game_id % 2 = 0 then 'Regular' else 'Secondary' end) as cr_type,
            min(cast(game_id % 200 as int)) as city_id
        from contests where w_loc <> 'N' group by season, day_num, w_id, l_id"""),
    "ledger": ((), """
        select o_orderkey as game_id, case when o_orderstatus = 'F' then 'Downloaded' else 'DashesSkipped' end as status
        from orders where o_orderstatus <> 'O'"""),
    "page_ledger": ((), """
        select page_id, case when max(quality) = 1 then 'Downloaded' else 'NoAwayTeam' end as status
        from pages join labels on page_id = doc_id group by page_id"""),
    "cells": (("contests",), f"""
        select * replace (case when game_id % 29 <> 0 then home_score end as home_score,
            case when game_id % 31 = 0 then 'n/a' else away_score end as away_score,
            case when game_id % 37 = 0 then 'Postponed' else status_text end as status_text,
            case when game_id % 41 = 0 then 'Supplier - Box Score - soon' else title end as title,
            case when game_id % 43 = 0 and away_href is not null then '/team/_/id/none/x' else away_href end as away_href,
            case when game_id % 47 = 0 then '7' else home_fg end as home_fg) from (
        select game_id, concat('Supplier ', w_id, ' vs. ', l_id, ' - Box Score - ', strftime(o_orderdate, '%B %-d, %Y')) as title,
            case game_id % 7 when 0 then 'Final/OT' when 1 then 'Final/2OT' else 'Final' end as status_text,
            {_href('away', 13)}, {_href('home', 17)}, {_cell('home')}, {_cell('away')}
        from contests join orders on o_orderkey = game_id)"""),
    "checked": (("cells",), """
        select *, case when away_href is null then 'NoAwayTeam' when home_href is null then 'NoHomeTeam'
            when home_pts = '--' or away_pts = '--' then 'DashesSkipped'
            when """ + " or ".join(
        f"try_cast({c} as int) is null" for side in ("home", "away") for c in (
            *[f"{side}_{n}" for n in ("oreb", "dreb", "ast", "stl", "blk", "tov", "pf", "score", "pts")],
            *[f"string_split({side}_{n}, '-')[{k}]" for n in ("fg", "fg3", "ft") for k in (1, 2)],
        )
    ) + """ then 'MissingCells'
            when status_text not in ('Final', 'Final/OT', 'Final/2OT') then 'NotFinal'
            when try_strptime(string_split(title, ' - ')[3], '%B %-d, %Y') is null then 'BadTitle'
            when try_cast(string_split(away_href, '/')[-2] as bigint) is null
                or try_cast(string_split(home_href, '/')[-2] as bigint) is null then 'UnknownTeam'
            else 'Downloaded' end as status
        from cells"""),
    "oriented": (("checked",), """
        select game_id, title, status_text, status, try_cast(home_score as int) > try_cast(away_score as int) as home_won,
            """ + ", ".join(
        f"case when try_cast(home_score as int) > try_cast(away_score as int) then {a}_{c} "
        f"when try_cast(home_score as int) <= try_cast(away_score as int) then {b}_{c} end as {s}_{c}"
        for s, a, b in (("w", "home", "away"), ("l", "away", "home"))
        for c in ("href", "fg", "fg3", "ft", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf", "score", "pts")
    ) + " from checked"),
    "typed": (("oriented",), """
        select game_id, cast(year(d) as int) as season, cast(date_diff('day', make_date(year(d), 1, 1), d) as int) as day_num,
            try_cast(string_split(w_href, '/')[-2] as bigint) as w_id, try_cast(w_pts as int) as w_score,
            try_cast(string_split(l_href, '/')[-2] as bigint) as l_id, try_cast(l_pts as int) as l_score,
            case when home_won then 'H' else 'A' end as w_loc,
            case status_text when 'Final' then 0 when 'Final/OT' then 1 else 2 end as num_ot,
            """ + ", ".join(
        f"try_cast(string_split({s}_{c}, '-')[1] as int) as {s}_{m}, try_cast(string_split({s}_{c}, '-')[2] as int) as {s}_{a}"
        for s in ("w", "l") for c, m, a in (("fg", "fgm", "fga"), ("fg3", "fgm3", "fga3"), ("ft", "ftm", "fta"))
    ) + ", " + ", ".join(
        f"try_cast({s}_{c} as int) as {s}_{c}" for s in ("w", "l") for c in ("oreb", "dreb", "ast", "tov", "stl", "blk", "pf")
    ) + """
        from (select *, cast(try_strptime(string_split(title, ' - ')[3], '%B %-d, %Y') as date) as d from oriented where status = 'Downloaded')"""),
    "name_left": ((), "select distinct p_name as name from part"),
    "name_right": ((), """
        select p_name as candidate from part where length(p_name) % 2 = 0
        union select p_name || ' ' || p_type from part where length(p_name) % 2 = 1"""),
    "tokens": (("name_left",), """
        select name, list_filter(string_split(name, ' '), lambda t: length(t) = list_max(list_transform(string_split(name, ' '), lambda u: length(u))))[1] as token
        from name_left"""),
    "match_pairs": (("name_left", "name_right", "tokens"), """
        select name, stage, case when stage = 3 then token else name end as key, candidate from (
            select *, min(stage) over (partition by name) as best from (
                select l.name, l.token, case when r.candidate = l.name then 1 when contains(r.candidate, l.name) then 2 else 3 end as stage, r.candidate
                from tokens l join name_right r on contains(r.candidate, l.token) or contains(r.candidate, l.name))
        ) where stage = best"""),
    "game_days": (("contests",), """
        select season, day_num, dense_rank() over (order by season, day_num) as d
        from (select distinct season, day_num from contests where day_num >= 1)"""),
    "rated_games": (("contests", "game_days"), """
        select c.*, g.d from contests c join game_days g on g.season = c.season and g.day_num = c.day_num"""),
    "season_turns": (("game_days",), """
        select a.d, b.season - a.season as turns from game_days a join game_days b on b.d = a.d + 1"""),
    "state": (("rated_games", "season_turns"), f"""
        select cast(1 as bigint) as d, league, team, cast(1500.0 as double) as rating
        from (select league, w_id as team from rated_games union select league, l_id from rated_games)
        union all
        select s.d + 1, s.league, s.team,
            1505.0 + pow(0.75, t.turns) * (s.rating + coalesce(u.delta, 0.0) - 1505.0)
        from state s join season_turns t on t.d = s.d
        left join (
            select d, league, team, sum(delta) as delta from (
                select g.d, g.league, unnest([g.w_id, g.l_id]) as team, unnest([v, -v]) as delta from (
                    select g.d, g.league, g.w_id, g.l_id, {update_sql('w.rating', 'l.rating')} as v
                    from rated_games g join state w on w.d = g.d and w.league = g.league and w.team = g.w_id
                    join state l on l.d = g.d and l.league = g.league and l.team = g.l_id) g)
            group by d, league, team) u on u.d = s.d and u.league = s.league and u.team = s.team"""),
    "ratings": (("state",), f"""
        select g.league, g.game_id, g.season, g.day_num, {pred_sql('w.rating', 'l.rating')} as pred,
            {update_sql('w.rating', 'l.rating')} as "update", g.w_id, w.rating as w_elo,
            w.rating + {update_sql('w.rating', 'l.rating')} as w_new_elo, g.l_id, l.rating as l_elo,
            l.rating - {update_sql('w.rating', 'l.rating')} as l_new_elo
        from rated_games g join state w on w.d = g.d and w.league = g.league and w.team = g.w_id
        join state l on l.d = g.d and l.league = g.league and l.team = g.l_id"""),
    "team_ratings": (("ratings",), """
        select league, season, day_num, w_id as team, w_elo as elo, "update" as delta from ratings
        union all select league, season, day_num, l_id, l_elo, -"update" from ratings"""),
    "snapshots": (("state", "team_ratings"), """
        select s.league, g.season, s.team, s.rating + coalesce(u.delta, 0.0) as rating
        from (select season, max(d) as d, max(day_num) as day_num from game_days group by season) g
        join state s on s.d = g.d
        left join (select league, season, day_num, team, sum(delta) as delta from team_ratings group by all) u
            on u.league = s.league and u.season = g.season and u.day_num = g.day_num and u.team = s.team"""),
    "elo_before": (("team_ratings",), """
        select league, season, team, max(elo) as elo, max(day_num) as elo_day from (
            select *, rank() over (partition by league, season, team order by day_num desc) as rk
            from team_ratings where day_num < {cutoff}) where rk = 1 group by league, season, team"""),
    "current_coach": (("tenures",), """
        select season, team, arg_max(coach, last_day) as coach from tenures where first_day < {cutoff} group by season, team"""),
    "current_stats": (("rolling",), """
        select * from (select *, row_number() over (partition by season, team order by day_num desc, outcome) as rn
            from rolling where day_num < {cutoff}) where rn = 1"""),
    "played": (("facts",), "select season, team, count(*) as n from facts where day_num < {cutoff} group by season, team"),
    "day_step": (("contests", "teams"), f"""
        select g.league, g.game_id, g.season, g.day_num, {pred_sql('w.rating', 'l.rating')} as pred,
            {update_sql('w.rating', 'l.rating')} as "update", g.w_id, w.rating as w_elo,
            w.rating + {update_sql('w.rating', 'l.rating')} as w_new_elo, g.l_id, l.rating as l_elo,
            l.rating - {update_sql('w.rating', 'l.rating')} as l_new_elo
        from contests g join (select team_id, 1500 + budget / 100 as rating from teams) w on w.team_id = g.w_id
        join (select team_id, 1500 + budget / 100 as rating from teams) l on l.team_id = g.l_id"""),
    "fields": (("facts",), """
        select league, season, cast((place - 1) // 64 as int) as bracket, team, wins, cast((place - 1) % 64 // 4 + 1 as int) as seed
        from (
            select *, row_number() over (partition by league, season order by wins desc, team) as place
            from (select league, season, team, count(*) filter (outcome = 'W') as wins from facts group by league, season, team))"""),
    "pairs": (("fields",), """
        select a.league, a.season, a.bracket, a.team as team_1, a.seed as seed_1, b.team as team_2, b.seed as seed_2
        from fields a join fields b on a.league = b.league and a.season = b.season and a.bracket = b.bracket and a.team < b.team"""),
    "bounds": (("facts",), " union all ".join(
        f"select '{s}' as stat, min({s}) as lo, max({s}) as hi from facts" for s in STATS)),
    "history": (("facts",), """
        select game_id, season, team, step, hist_game, hist_day from (
            select g.game_id, g.season, g.team, h.game_id as hist_game, h.day_num as hist_day,
                row_number() over (partition by g.game_id, g.team order by h.day_num desc, h.game_id desc) as step
            from facts g join facts h on h.season = g.season and h.team = g.team and h.day_num < g.day_num)
        where step <= 5"""),
    "sequence": (("contests", "facts", "history"), f"""
        select c.game_id, c.season, least(c.w_id, c.l_id) as team_1, greatest(c.w_id, c.l_id) as team_2,
            case when c.w_id < c.l_id then 1 else 0 end as label, a.step, fa.day_num as day_1, fa.opp as opp_1,
            fb.day_num as day_2, fb.opp as opp_2,
            {each('fa.{s} as t1_{s}')}, {each('fa.opp_{s} as o1_{s}')}, {each('fb.{s} as t2_{s}')}, {each('fb.opp_{s} as o2_{s}')}
        from contests c
        join history a on a.game_id = c.game_id and a.team = least(c.w_id, c.l_id)
        join history b on b.game_id = c.game_id and b.team = greatest(c.w_id, c.l_id) and b.step = a.step
        join facts fa on fa.game_id = a.hist_game and fa.team = a.team
        join facts fb on fb.game_id = b.hist_game and fb.team = b.team
        where (select count(*) from history h where h.game_id = c.game_id) = 10"""),
    "predictions": (("contests",), """
        select game_id, season, w_id, l_id, w_score, l_score, cast(w_score + game_id % 5 - 2 as double) as w_pred,
            cast(l_score + game_id % 3 - 1 as double) as l_pred from contests"""),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def sql(body: str, *names: str, cutoff: int | None = None) -> str:
    """``body`` preceded by the blocks it needs."""
    blocks = []
    for name in _ordered(names):
        text = CTES[name][1]
        if name in ("elo_before", "current_stats", "current_coach", "played"):
            text = text.format(cutoff=cutoff)
        header = "state(d, league, team, rating)" if name == "state" else name
        blocks.append(f"{header} as ({text})")
    return f"with recursive {', '.join(blocks)} {body}" if blocks else body
