"""Elo column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EloRules:
    # Gain, home bonus, first rating, season carry-over share and the rating it leans to.
    gain: float = 22.0
    home_bonus: float = 100.0
    start: float = 1500.0
    carried_share: float = 0.75
    carry_target: float = 1505.0
    # Margin offset and exponent; expected margin at equal ratings and per rating point.
    margin_offset: float = 3.0
    margin_power: float = 0.8
    even_margin: float = 7.5
    margin_slope: float = 0.006
    # Days before this one are not rated.
    first_day: int = 1


def win_expectancy(own: Column, other: Column) -> Column:
    return 1.0 / (F.pow(F.lit(10.0), (other - own) / 400.0) + 1.0)


def home_bonuses(w_loc: Column, rules: EloRules) -> tuple[Column, Column]:
    """Points added for the game to the winner and to the loser: only the side at home gets them."""
    bonus = F.lit(rules.home_bonus)
    return F.when(w_loc == "H", bonus).otherwise(0.0), F.when(w_loc == "A", bonus).otherwise(0.0)


def rating_update(diff: Column, margin: Column, rules: EloRules) -> Column:
    """Points moved from loser to winner; ``diff`` is winner minus loser after the home bonus.

    Where the expected margin is exactly zero the ratio has no value and no points move.
    """
    expected = rules.even_margin + rules.margin_slope * diff
    scale = F.try_divide(F.pow(margin + rules.margin_offset, F.lit(rules.margin_power)), expected)
    loss_share = 1.0 - win_expectancy(diff, F.lit(0.0))
    return F.coalesce(rules.gain * scale * loss_share, F.lit(0.0))


def carry_over(rating: Column, seasons: Column, rules: EloRules) -> Column:
    """Rating after ``seasons`` season changes.

    One change is ``share * rating + (1 - share) * target``, whose fixed point is ``target``.
    """
    share = F.pow(F.lit(rules.carried_share), seasons)
    return F.lit(rules.carry_target) + share * (rating - rules.carry_target)
