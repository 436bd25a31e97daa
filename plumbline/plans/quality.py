"""Data-quality and telemetry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import quality as Q
from plumbline.operators import telemetry as T
from plumbline.session import scratch

from .base import Tables, both, query

CHECK = "'{0}' AS check_name, CASE WHEN {1} THEN 'pass' ELSE 'fail' END AS status, ({2})::VARCHAR AS detail"


def row(name: str, ok: str, detail: str, source: str) -> str:
    return "SELECT " + CHECK.format(name, ok, detail) + f" FROM {source}"


@query(" UNION ALL ".join(row(f"not_null:{c}", "n = 0", "n", f"(SELECT COUNT(*) FILTER (WHERE {e} IS NULL) AS n FROM events)") for c, e in (("event_id", "event_id"), ("kind", "NULLIF(event_type, 'error')"), ("value", "value"))))
def dq_not_null_contract(t: Tables) -> DataFrame:
    return Q.not_null(t.events.withColumn("kind", F.nullif("event_type", F.lit("error"))), ["event_id", "kind", "value"])


@query(" UNION ALL ".join([
    row("row_count", "n >= 1000", "n", "(SELECT COUNT(*) AS n FROM orders)"),
    row("unique:o_orderkey", "n = 0", "n", "(SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1))"),
    row("coverage:year", "m = ''", "m", "(SELECT COALESCE(string_agg(y::VARCHAR, ',' ORDER BY y), '') AS m FROM (SELECT unnest([1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002]) AS y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders))"),
    row("range:o_totalprice", "n = 0", "n", "(SELECT COUNT(*) FILTER (WHERE NOT o_totalprice BETWEEN 0 AND 400000) AS n FROM orders)"),
    row("domain:o_orderstatus", "n = 0", "n", "(SELECT COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS n FROM orders)"),
]))
def dq_suite(t: Tables) -> DataFrame:
    o = t.orders.withColumn("year", F.year("o_orderdate"))
    return Q.suite(Q.passes(o, Q.at_least(1000), Q.covers("year", range(1995, 2003)), Q.range_of("o_totalprice", 0, 400000), Q.domain_of("o_orderstatus", ["F", "O"])), Q.unique(o, ["o_orderkey"]))


@query(row("null_rate:kind", "r <= 0.05", "r", "(SELECT ROUND(AVG(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END), 4) AS r FROM events)") + " UNION ALL " + row("row_count", "n >= 100", "n", "(SELECT COUNT(*) AS n FROM events)"))
def dq_bq_checks(t: Tables) -> DataFrame:
    e = t.events.withColumn("kind", F.nullif("event_type", F.lit("error")))
    return Q.passes(e, Q.null_share("kind", 0.05), Q.at_least(100))


@query("SELECT * FROM (VALUES ('column:c_custkey', 'pass', 'bigint'), ('column:c_acctbal', 'fail', 'double'), ('column:c_phone', 'fail', 'missing')) v(check_name, status, detail)")
def dq_schema_validator(t: Tables) -> DataFrame:
    return Q.has_columns(t.customer, c_custkey="bigint", c_acctbal="decimal(10,2)", c_phone="string")


@query("SELECT n AS nation, ROUND(stated, 2) AS stated, ROUND(COALESCE(found, 0), 2) AS found, abs(stated - COALESCE(found, 0)) <= 0.05 * abs(stated) AS ok FROM (SELECT c_nationkey AS n, SUM(c_acctbal) AS stated FROM customer GROUP BY 1) LEFT JOIN (SELECT c_nationkey AS m, SUM(c_acctbal) AS found FROM customer WHERE c_custkey % 20 <> 0 GROUP BY 1) ON n = m")
def dq_reconcile(t: Tables) -> DataFrame:
    c = t.customer.withColumnRenamed("c_nationkey", "nation")
    return Q.reconcile(c.groupBy("nation").agg(F.sum("c_acctbal").alias("total")), c.where("c_custkey % 20 <> 0"), ["nation"], "total", "c_acctbal", 0.05)


both("dq_yoy", "SELECT year, ROUND((total / prev - 1) * 100, 4) AS pct FROM (SELECT year, total, LAG(total) OVER (ORDER BY year) AS prev FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, SUM(o_totalprice) AS total FROM {orders} GROUP BY CAST(year(o_orderdate) AS INT)) AS a) AS b WHERE (total / prev - 1) * 100 > 100 OR (total / prev - 1) * 100 < -20")
both("dq_cap_tolerance", "SELECT year, abs(total / mean - 1) <= 0.15 AS ok FROM (SELECT year, total, AVG(total) OVER () AS mean FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, SUM(o_totalprice) AS total FROM {orders} GROUP BY CAST(year(o_orderdate) AS INT)) AS a) AS b")
both("dq_freshness", "SELECT MAX(CAST(year(o_orderdate) AS INT)) AS newest, MAX(year(o_orderdate)) >= 2001 AS fresh FROM {orders}")


@query("SELECT gate, passed FROM (SELECT 'unique' AS gate, (SELECT COUNT(*) = COUNT(DISTINCT event_id) FROM events) AS passed UNION ALL SELECT 'range', (SELECT COUNT(*) FILTER (WHERE value < 0) = 0 FROM events) UNION ALL SELECT 'nulls', (SELECT COUNT(*) FILTER (WHERE props IS NULL) = 0 FROM events))")
def dq_gates(t: Tables) -> DataFrame:
    checks = Q.suite(Q.unique(t.events, ["event_id"]), Q.in_range(t.events, "value", 0, float("inf")), Q.not_null(t.events, ["props"]))
    gate = F.when(F.startswith("check_name", F.lit("unique")), "unique").when(F.startswith("check_name", F.lit("range")), "range").otherwise("nulls")
    return checks.select(gate.alias("gate"), (F.col("status") == "pass").alias("passed"))


both("dq_dbt_tests", "SELECT n_nationkey FROM {nation} WHERE n_name IS NULL UNION ALL SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (0, 1, 2, 3)")
both("dq_audit_files", "SELECT year, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS nulls, ROUND(MAX(o_totalprice), 2) AS top FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, o_totalprice FROM {orders}) AS x GROUP BY year")
both("dq_rankings_file", "SELECT COUNT(*) AS n, COUNT(*) >= 1500 AS enough, ROUND(AVG(CASE WHEN c_acctbal IS NULL THEN 1.0E0 ELSE 0.0E0 END), 4) AS null_rate, COUNT(*) FILTER (WHERE c_acctbal < 0) AS negatives FROM {customer}")


@query("SELECT 'copy' AS stage, 'ok' AS status, COUNT(*) AS rows_in, COUNT(*) AS rows_out FROM nation UNION ALL SELECT 'filter', 'failed', COUNT(*), 0 FROM nation")
def tel_runs(t: Tables) -> DataFrame:
    run = T.Run()
    for name, change in (("copy", lambda df: df), ("filter", lambda df: df.where("n_nationkey < 0"))):
        run.stage(name, lambda name=name, change=change: T.written(t.nation, change, f"{scratch(t.spark)}/{name}"))
    return run.frame(t.spark).select("stage", "status", "rows_in", "rows_out")


@query("SELECT attempt, 'AnalysisException' AS error, n FROM (VALUES (1), (2)) v(attempt), (SELECT COUNT(*) AS n FROM orders)")
def tel_healing(t: Tables) -> DataFrame:
    """A read that finds its table at the third place, with the two failures before it and the rows it gave."""
    places = iter([f"{t.sf_dir}/orders.missing", f"{t.sf_dir}/orders.moved", f"{t.sf_dir}/orders.parquet"])
    orders, failures = T.healed(lambda: t.spark.read.parquet(next(places)), lambda e: type(e).__name__ == "AnalysisException")
    return t.spark.createDataFrame(failures, "attempt int, error string").crossJoin(orders.agg(F.count("*").alias("n")))  # one row


@query("""SELECT year, '{"eventTime":"' || strftime(last, '%Y-%m-%dT%H:%M:%SZ') || '","eventType":"' || CASE WHEN open = 0 THEN 'COMPLETE' ELSE 'RUNNING' END || '","inputs":[{"name":"orders","namespace":"plumbline"}],"job":{"name":"gold","namespace":"plumbline"},"outputs":[{"name":"fact","namespace":"plumbline"}],"run":{"runId":"gold-' || year || '"}}' AS event
FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, MAX(o_orderdate) AS last, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS open FROM orders GROUP BY 1)""")
def tel_lineage(t: Tables) -> DataFrame:
    """A lineage event for each year's load of the orders: complete once none of them is pending."""
    years = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "P").alias("open"))
    event = F.when(F.col("open") == 0, "COMPLETE").otherwise("RUNNING")
    return years.select("year", T.lineage_events(F.concat(F.lit("gold-"), F.col("year").cast("string")), "gold", ["orders"], ["fact"], event, F.col("last")).alias("event"))


@query("SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE hits > 3) AS limited FROM (SELECT user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hits FROM events) GROUP BY 1")
def srv_rate_limit(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.events.select("user_id", F.count("*").over(w).alias("hits")).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("hits") > 3).alias("limited"))
