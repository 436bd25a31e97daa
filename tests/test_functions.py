"""Exact expectations of the scalar functions and operators."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import chunks, claims, numbers, scoring, sqlguard, strings, valuation
from plumbline.functions.similarity import similarity
from plumbline.operators import ledger, quality, telemetry
from plumbline.operators.featurestore import lag_features, matrix
from plumbline.sources import files, html, sinks


def one(spark, column, *values, schema):
    return [r[0] for r in spark.createDataFrame([tuple([v]) if not isinstance(v, tuple) else v for v in values], schema).select(column).collect()]


def test_timeliness(spark):
    base = dt.datetime(2024, 1, 1)
    days = [0, -3, 6, 7, 30, 90, 365]
    got = one(spark, scoring.timeliness(F.col("a"), F.col("b")), *[(base, base + dt.timedelta(days=d)) for d in days], schema="a timestamp, b timestamp")
    assert got == [1.0, 1.0, 1.0, 1.1, 1.25, 1.5, 2.0]


def test_brier_and_weighted(spark):
    got = one(spark, numbers.brier(F.col("p"), F.col("o")), (1.0, True), (0.0, False), (1.0, False), (0.5, True), schema="p double, o boolean")
    assert got == [0, 0, 1, 0.25]
    got = one(spark, scoring.weighted(F.col("b"), F.col("s"), F.col("w")), (True, None, 1.5), (False, None, 1.0), (None, 0.0, 1.25), (None, 1.0, 1.0), (None, None, 1.0), schema="b boolean, s double, w double")
    assert got == [1.5, 0.0, 1.25, 0.0, None]


def test_undouble(spark):
    assert one(spark, strings.undouble(F.col("x")), "Kyler MurrayKyler Murray", "Dak Prescott", "A", "", schema="x string") == ["Kyler Murray", "Dak Prescott", "A", ""]


def test_money(spark):
    assert one(spark, numbers.money_millions(F.col("x")), "$1,234,567", "2.5M", "1B", "500K", "n/a", None, schema="x string") == [1.234567, 2.5, 1000.0, 0.5, 0.0, 0.0]
    assert one(spark, numbers.money_plain(F.col("x")), "$1,234", "(1,234)", "-", "", schema="x string") == [1234.0, -1234.0, 0.0, 0.0]


def test_cadence(spark):
    assert one(spark, scoring.cadence(F.col("x")), 15.0, 7.0, 3.0, 1.0, 0.0, schema="x double") == ["daily", "twice_weekly", "weekly", "biweekly", "monthly"]


def test_mentions(spark):
    assert one(spark, strings.mentions(F.col("x"), {"dark red": "DR", "red": "R"}), "Red, dark red and RED", "bored", schema="x string") == [["R", "DR"], []]


def test_similarity_is_asymmetric_and_exact():
    assert similarity("abcd", "bcde") == 0.75
    assert similarity(None, "a") is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?", max_size=400), st.integers(5, 60))
def test_chunks_lose_nothing(text, most):
    parts = chunks.chunks(text, most)
    assert all(0 < len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_html_tables():
    page = "<table><tr><th>Player</th><th>Value</th><th>value</th></tr><tr><td>A</td><td>$1</td><td>$2</td></tr><tr><td>x</td></tr></table><!--<table><tr><th>a</th><th>b</th></tr></table>-->"
    assert html.parse_tables(page) == [(["player", "value", "value_1"], [["A", "$1", "$2"]])]
    assert len(html.parse_tables(page, commented=True)) == 2
    assert html.parse_tables(None) == []


def test_yaml_rows():
    assert files.yaml_rows("- a: 1 # x\n  b: 'two'\n# none\n- a: 3\n") == [{"a": "1", "b": "two"}, {"a": "3"}]


def test_limited():
    assert sqlguard.limited("SELECT 1;") == "SELECT 1 LIMIT 20"
    assert sqlguard.limited("select count(*) from t") == "select count(*) from t"
    assert sqlguard.limited("SELECT 1 limit 3") == "SELECT 1 limit 3"


def test_chain(spark):
    rows = spark.createDataFrame([("l", i, f"h{i}") for i in range(5)], "led string, n int, h string")
    chained = ledger.append_chain(rows, "led", ["n"], "h")
    assert ledger.verify_chain(chained, "led", ["n"], "h").count() == 0
    head = ledger.append_chain(rows.where("n < 3"), "led", ["n"], "h")
    seed = head.where("n = 2").select("led", "chain_hash")
    resumed = ledger.append_chain(rows.where("n >= 3"), "led", ["n"], "h", seed)
    assert sorted(head.union(resumed).collect()) == sorted(chained.collect())
    broken = chained.withColumn("chain_hash", F.when(F.col("n") == 2, "x").otherwise(F.col("chain_hash")))
    assert ledger.first_break(broken, "led", ["n"], "h").collect()[0]["position"] == 3


def test_greedy_duplicates(spark):
    rows = spark.createDataFrame([("g", 1, "the quick brown fox"), ("g", 2, "the quick brown foxes"), ("g", 3, "something else"), ("g", 4, "the quick brown fox"), ("h", 5, "the quick brown fox"), ("h", 6, None)], "g string, i long, t string")
    assert sorted(tuple(r)[:2] for r in ledger.void_near_duplicates(rows, ["g"], ["i"], "i", "t").collect()) == [(2, 1), (4, 1)]


def test_contract(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    with pytest.raises(quality.ContractViolation, match="b"):
        quality.enforce(df, ["a", "b"])
    assert quality.enforce(df, ["a"]) is df


def test_scd2_and_upsert(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, made string")
    source = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, made string")
    assert sorted(tuple(r) for r in sinks.merge_upsert(target, source, ["k"], ["made"]).collect()) == [(1, "a", "old"), (2, None, "old"), (3, "c", "new")]


def test_features_never_look_ahead(spark):
    facts = spark.createDataFrame([("p", 2020, 1.0), ("p", 2022, 3.0)], "e string, y int, v double")
    values = lag_features(facts, "e", "y", ["v"], [1, 2])
    assert [(r["feature_name"], r["prediction_year"], r["feature_value"]) for r in values.collect()] == [("v_lag_2", 2022, 1.0)]
    spine = spark.createDataFrame([("p", 2022), ("q", 2022)], "entity string, prediction_year int")
    at = lambda day: {r["entity"]: r["v_lag_2"] for r in matrix(spine, values, ["v_lag_2"], F.lit(day).cast("date")).collect()}
    assert at("2021-02-14") == {"p": None, "q": None} and at("2021-02-15") == {"p": 1.0, "q": None} and at("2022-02-15") == {"p": None, "q": None}


def test_valuation(spark):
    x = valuation.targets(F.col("c"), F.col("d"), F.col("p"))
    assert one(spark, x["efficiency_ratio"], (1.0, None, 100.0), (10.0, 8.0, 4.0), schema="c double, d double, p double") == [10.0, 0.5]


def test_healing():
    left = [ValueError("x")]
    assert telemetry.healed(lambda: left.pop() if False else (left and (_ for _ in ()).throw(left.pop())) or 1, lambda e: True)[1] == [{"attempt": 1, "error": "ValueError"}]
    with pytest.raises(ValueError):
        telemetry.healed(lambda: (_ for _ in ()).throw(ValueError()), lambda e: False)


def test_fixed_timezone_hash(spark):
    got = one(spark, scoring.forecast_hash(F.col("t"), F.lit("u"), F.lit("a"), F.lit("x")), dt.datetime(2024, 1, 1, 0, 0, 0, 5), schema="t timestamp_ntz")
    import hashlib

    assert got == [hashlib.sha256(b"2024-01-01T00:00:00.000005Z|u|a|x").hexdigest()]


def test_thresholds_of_claims(spark):
    said = {
        "Smith gets at least 1,200 yards": (">=", 1200.0), "a minimum 40 sacks": (">=", 40.0), "over 12 wins": (">", 12.0), "greater than 9 games": (">", 9.0), "more than 1,000": (">", 1000.0),
        "40+ touchdowns": (">=", 40.0), "10 or more picks": (">=", 10.0), "fewer than 3": ("<", 3.0), "stays under 90": ("<", 90.0), "at most 8": ("<=", 8.0), "no more than 8": ("<=", 8.0), "exactly 17": ("==", 17.0),
        "throws 45 touchdowns": (">=", 45.0), "Smith, the best, has 30": (">=", 30.0), "no number": None,
    }
    got = one(spark, claims.threshold(F.col("c")), *said, schema="c string")
    assert [tuple(x) if x else None for x in got] == list(said.values())


def test_draft_phrases(spark):
    said = {"drafted 39th overall": 39, "drafted #7": 7, "No. 12 pick": 12, "No. 12 in the huddle": None, "wears No. 7": None, "No 5 overall": 5, "the #1 overall pick": 1, "a top-10 offense and No. 3 defense": None, "#3 overall": 3, "the 4 overall choice": 4, "first overall": 1, "pick #9": 9, "goes at pick 20": 20, "wears #12 in 2024": None, "a top-10 pick": None}
    assert one(spark, claims.pick_number(F.col("c")), *said, schema="c string") == list(said.values())
    assert one(spark, claims.top_n(F.col("c")), "a top-10 pick", "top 5 pick", "a top-10 offense", "the top 3", schema="c string") == [10, 5, None, None]
    assert one(spark, claims.draft_round(F.col("c")), "round 12", "a second-round talent", "nothing", schema="c string") == [12, 2, None]
