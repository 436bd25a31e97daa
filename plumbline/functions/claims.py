"""Claim parsers: regular expressions as columns, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import extract

#: Ordinal words of draft positions.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}


def _int(c: Column) -> Column:
    return c.cast("int")


def pick_number(claim: Column) -> Column:
    """`pick 7`, `drafted #7`, `No. 7 pick`, `#7 overall`, `7th overall`, `seventh overall`; a bare `#7` or `No. 7` is a jersey, not a pick."""
    low = F.lower(claim)
    word = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])[extract(low, r"\b(" + "|".join(ORDINALS) + r")\s+(?:overall|pick)")]
    return F.coalesce(*[_int(extract(low, p)) for p in (r"(?:\bpick\s*#?|drafted\s*#)\s*(\d{1,3})\b", r"(?:#|\bno\.?)\s*(\d{1,3})(?:st|nd|rd|th)?\s+(?:overall|pick)\b", r"\b(\d{1,3})(?:st|nd|rd|th)\s+(?:overall|pick)\b", r"\b(\d{1,3})\s+overall\b")], word)


def top_n(claim: Column) -> Column:
    """`top-10 pick`; a `top-10 offense` is no draft position."""
    return _int(extract(F.lower(claim), r"\btop[\s-](\d{1,3})\s*(?:overall\s+)?pick"))


def draft_round(claim: Column) -> Column:
    low = F.lower(claim)
    word = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])[extract(low, r"\b(" + "|".join(ORDINALS) + r")[\s-]round")]
    return F.coalesce(_int(extract(low, r"\bround\s*(\d{1,2})\b")), _int(extract(low, r"\b(\d)(?:st|nd|rd|th)[\s-]round")), word)


def season(claim: Column) -> Column:
    return _int(extract(claim, r"\b(20\d{2})\b"))


def game_kind(claim: Column) -> Column:
    low = F.lower(claim)
    return F.when(low.rlike(r"super bowl"), "super_bowl").when(low.rlike(r"\bmiss\b.*playoffs"), "miss_playoffs").when(low.rlike(r"\bmake\b.*playoffs"), "make_playoffs").when(low.rlike(r"\b(beat|beats|defeat|defeats)\b"), "head_to_head")


def first_alias(text: Column, alias_code: dict[str, str]) -> Column:
    """Code of the first alias in dictionary order that the text contains."""
    each = F.array(*[F.struct(F.lit(a.lower()).alias("a"), F.lit(c).alias("c")) for a, c in alias_code.items()])
    return F.get(F.filter(each, lambda x: F.contains(F.lower(text), x.a)), F.lit(0))["c"]


#: How a claim states a threshold, in order of precedence: words before the number, words after it, comparison.
#: Claims with "no more than" are read as they are meant, before "more than"; a bare number counts as "at least".
THRESHOLD_PHRASES = (
    (("no more than",), (), "<="),
    (("at least", "minimum"), (), ">="),
    (("over", "more than", "greater than"), (), ">"),
    ((), (r"\+", "or more"), ">="),
    (("fewer than", "under"), (), "<"),
    (("at most",), (), "<="),
    (("exactly",), (), "=="),
    ((), (), ">="),
)
_NUMBER = r"(\d[\d,]*)"
THRESHOLDS = [((rf"(?:{'|'.join(before)})\s+" if before else "") + _NUMBER + (rf"\s*(?:{'|'.join(after)})" if after else ""), op) for before, after, op in THRESHOLD_PHRASES]


def threshold(claim: Column) -> Column:
    """struct(op, value) of the first threshold pattern that matches, else null."""
    low = F.lower(claim)
    found = [F.when(low.rlike(p), F.struct(F.lit(op).alias("op"), F.regexp_replace(F.regexp_extract(low, p, 1), ",", "").cast("double").alias("value"))) for p, op in THRESHOLDS]
    return F.coalesce(*found)


def compare(actual: Column, op: Column, value: Column) -> Column:
    return F.when(op == ">=", actual >= value).when(op == ">", actual > value).when(op == "==", actual == value).when(op == "<=", actual <= value).when(op == "<", actual < value)


def capitalised_name(claim: Column) -> Column:
    return extract(claim, r"^([A-Z][\w'.-]+(?:\s+[A-Z][\w'.-]+)+)")


#: Destinations of free-agency claims follow these words.
def destination(claim: Column) -> Column:
    return extract(claim, r"(?i)(?:sign with|signs with|traded to|join|joins)\s+(?:the\s+)?([A-Za-z0-9]+)")


#: Resolver outcomes and ledger statuses; a partial hit counts as correct.
OUTCOME = {"correct": "CORRECT", "partial": "CORRECT", "incorrect": "INCORRECT", "unresolvable": "VOID"}


def status(outcome: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in OUTCOME.items() for x in kv])[outcome]


#: Keyword overrides come before the category.
ROUTES = [(r"super bowl|playoff", "playoff"), (r"\bmvp\b|rookie of the year|award", "award"), (r"\bwins?\b.*\bgames?\b|\bwin total", "wins"), (r"sign|trade", "transaction")]


def route(claim: Column, category: Column) -> Column:
    low = F.lower(claim)
    ladder = F.when(F.lit(False), F.lit(""))
    for pattern, name in ROUTES:
        ladder = ladder.when(low.rlike(pattern), F.lit(name))
    known = F.create_map(*[F.lit(x) for x in ("player_performance", "stat", "game_outcome", "wins", "draft_pick", "draft")])[category]
    return F.coalesce(ladder, known, F.when(low.rlike(r"\d"), "stat"), F.lit("unroutable"))
