"""Every registered query against its reference SQL on the smallest data."""

import datetime
import decimal

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Orders, joins and similarities that SQL does not express, and samples.
ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracles()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b)) or (a != a and b != b)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    run = duck.execute(registry.oracles()[name])
    have = [d[0] for d in run.description]
    assert sorted(have) == columns
    want = sorted((tuple(norm(r[have.index(c)]) for c in columns) for r in run.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_without_llm():
    """The engine does not import the optional operators."""
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "plumbline"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "plumbline.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
