"""Forecast hashes, outcome scores and status ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
#: Days of lead and the weight from there on.
TIMELINESS = [(365, 2.0), (90, 1.5), (30, 1.25), (7, 1.1)]


def forecast_hash(ts: Column, url: Column, author: Column, text: Column) -> Column:
    """sha256 of the payload in its canonical order; the time in microseconds, UTC."""
    return F.sha2(F.concat_ws("|", F.date_format(ts, ISO_MICROS), url, author, text), 256)


def chain_hash(own: Column, previous: Column) -> Column:
    return F.sha2(F.concat(own, previous), 256)


def full_days(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000)


def timeliness(predicted: Column, outcome: Column) -> Column:
    """More for an earlier forecast; 1 when the outcome came first."""
    days = full_days(predicted, outcome)
    ladder = F.when(outcome <= predicted, F.lit(1.0))
    for least, weight in TIMELINESS:
        ladder = ladder.when(days >= least, F.lit(weight))
    return ladder.otherwise(F.lit(1.0))


def weighted(binary: Column, brier: Column, weight: Column) -> Column:
    """(1 - brier) * weight, else the binary result times weight, else null."""
    return F.coalesce((1 - brier) * weight, binary.cast("double") * weight)


#: Posts a month and the polling tier from there on.
CADENCE = [(15, "daily"), (7, "twice_weekly"), (3, "weekly"), (1, "biweekly")]


def cadence(per_month: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(""))
    for least, tier in CADENCE:
        ladder = ladder.when(per_month >= least, F.lit(tier))
    return ladder.otherwise(F.lit("monthly"))
