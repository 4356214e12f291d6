"""Text and date expressions for scraped cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def made_and_attempted(cell: Column | str) -> tuple[Column, Column]:
    """``27-55`` to 27 and 55; anything that is no number becomes null.

    Cut at the dashes byte by byte: a split by a pattern makes an array of the parts for either number.
    """
    said = _col(cell)
    dash = F.instr(said, "-")
    rest = F.when(dash > 0, F.substring_index(F.substr(said, dash + 1), "-", 1))
    return F.substring_index(said, "-", 1).try_cast("int"), rest.try_cast("int")


def path_segment(url: Column | str, from_end: int) -> Column:
    """The slash-separated part at this place from the end, the last being 1; null where there are fewer."""
    whole = _col(url)
    part = F.substring_index(F.substring_index(whole, "/", -from_end), "/", 1)
    return part if from_end == 1 else F.when(F.substring_index(whole, "/", 1 - from_end) != whole, part)


def query_value(url: Column | str) -> Column:
    """Text after the first equals sign, up to the next one."""
    return F.get(F.split(_col(url), "="), F.lit(1))


def longest_token(text: Column | str) -> Column:
    """Longest space-separated token, the first one on ties."""
    ranked = F.transform(
        F.split(_col(text), " "),
        lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("first"), t.alias("token")),
    )
    return F.array_max(ranked)["token"]


def overtimes(status: Column | str) -> Column:
    """``Final`` 0, ``Final/OT`` 1, ``Final/2OT`` 2; null for a game that is not final."""
    said = _col(status)
    count = F.regexp_extract(said, r"^Final/(\d*)OT$", 1)
    return F.when(said == "Final", 0).when(said == "Final/OT", 1).otherwise(count.try_cast("int"))


def title_date(title: Column | str) -> Column:
    """Date in the third `` - ``-separated part of a page title, such as ``March 5, 1998``; null where it is none."""
    return F.try_to_date(F.get(F.split(_col(title), " - "), F.lit(2)), "MMMM d, yyyy")


def day_number(date: Column | str, start: Column | str) -> Column:
    """Days from the season's start date."""
    return F.datediff(_col(date), _col(start))


def day_date(day: Column | str, start: Column | str) -> Column:
    return F.date_add(_col(start), _col(day))
