"""Texts on which the engines' regular expressions differ, against the reference SQL."""

import random

import duckdb

from plumbline.plans import registry


def test_prediction_filter(spark, tmp_path):
    texts = ["the rétion", "the étion", "ré the btion tion", "éthe tion", "theé tion", "the\ntion", "the\rtion", "the tion", "the\u0085 tion", "tion the", "the tion", "other the xtion", "other\nthe x-tion", "THE TION", "will\x0bwin", "will win"]
    texts += ["WILL \f\r\n win", "bold  taKe", "mocK draft", "predıct", "PREDİCT", "over under", "over/under", "overunder", "the_tion", "the 9tion", "", None, "the " * 20_000]
    rng = random.Random(4)
    texts += ["".join(rng.choice(["the", "tion", "é", " ", "\n", "\r", "_", "-", "x", "will", "win", "\t", " "]) for _ in range(rng.randint(2, 12))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["v"] for r in registry.queries()["str_title_prediction_filter"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(registry.oracles()["str_title_prediction_filter"]).fetchall())
    assert len(got) == len(texts) and [(texts[k], v) for k, v in want.items() if got[k] != v] == []
    assert {True, False, None} == set(want.values())
