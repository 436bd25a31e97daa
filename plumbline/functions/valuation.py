"""Value, risk and trade expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import sigmoid

#: Minimum score and grade.
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


def bust_hurdle(cap: Column, dead: Column) -> Column:
    """What a contract must return: 60 % of cap, its dead money, or half a million, whichever is most; null dead money is left out."""
    return F.greatest(cap * 0.6, dead, F.lit(0.5))


def targets(cap: Column, dead: Column, performance: Column) -> dict[str, Column]:
    """The fact table's derived targets, from one hurdle and one performance column."""
    hurdle = bust_hurdle(cap, dead)
    ratio = F.least(F.try_divide(performance, hurdle), F.lit(10.0))
    return {"edce_risk": F.greatest(hurdle - performance, F.lit(0.0)), "true_bust_variance": hurdle - performance, "efficiency_ratio": ratio, "is_bust_binary": F.when(ratio < 0.70, 1).otherwise(0)}


def age_risk_exposure(age: Column, threshold: Column, exposure: Column, k: float = 0.5) -> Column:
    return sigmoid(age - threshold, k) * exposure


def overpayment(cap: Column, value: Column, dollars_per_value: Column) -> Column:
    return cap - value * dollars_per_value


def fantasy_points(**stats: Column) -> Column:
    """Weighted sum of season stats; missing stats count as 0."""
    #: Points per unit.
    weights = {"passing_yards": 0.04, "passing_tds": 4.0, "interceptions": -2.0, "rushing_yards": 0.1, "rushing_tds": 6.0, "receptions": 1.0, "receiving_yards": 0.1, "receiving_tds": 6.0, "sacks": 2.0, "tackles": 1.0}
    total = F.lit(0.0)
    for name, c in stats.items():
        total = total + F.coalesce(c, F.lit(0.0)) * weights[name]
    return total


def cut_split(cap_now: Column, guaranteed_now: Column, guaranteed_later: Column) -> dict[str, Column]:
    """Dead cap and savings of a release before and after June 1."""
    pre = guaranteed_now + guaranteed_later
    return {"dead_pre": pre, "savings_pre": cap_now - pre, "dead_post": guaranteed_now, "savings_post": cap_now - guaranteed_now, "dead_next_year": guaranteed_later}


def grade(score: Column) -> Column:
    clamped = F.least(F.greatest(score, F.lit(40.0)), F.lit(99.0))
    ladder = F.when(F.lit(False), F.lit(""))
    for least, letter in GRADES:
        ladder = ladder.when(clamped >= least, F.lit(letter))
    return ladder.otherwise(F.lit("F"))


def strategy(win_rate: Column, risk: Column, space: Column) -> Column:
    """Label by the first rule that holds."""
    return F.when((win_rate >= 0.6) & (risk < 0.3), "contend").when((win_rate >= 0.6), "retool").when((space > 0) & (risk < 0.5), "build").when(risk >= 0.5, "sell").otherwise("hold")
