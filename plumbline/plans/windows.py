"""Window, sort, limit and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import windows as O
from plumbline.operators.ranks import percent_rank, with_ranks

from .base import Tables, both, query

Y = "CAST(year(o_orderdate) AS INT)"
YEARLY = f"(SELECT o_custkey, {Y} AS year, SUM(o_totalprice) AS revenue FROM orders GROUP BY 1, 2)"
YEARLY_T = f"(SELECT o_custkey, {Y} AS year, SUM(o_totalprice) AS revenue FROM {{orders}} GROUP BY o_custkey, {Y}) AS y"
MONTHLY = "(SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2, 3)"


def yearly(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue"))


def monthly(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


both("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY {Y} ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS r FROM {{orders}}")


@query(f"SELECT o_orderkey, ROUND(percent_rank() OVER (PARTITION BY {Y} ORDER BY o_totalprice) * 100, 4) AS pct FROM orders")
def win_percent_rank(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return with_ranks(rows, ["year"], "o_totalprice", pct=percent_rank()).select("o_orderkey", F.round(F.col("pct") * 100, 4).alias("pct"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def win_dedupe_latest(t: Tables) -> DataFrame:
    return O.latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey")


both("win_latest_snapshot", "SELECT event_id FROM (SELECT event_id, CAST(ts AS DATE) AS day, MAX(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last FROM {events}) AS x WHERE day = last")


@query(f"SELECT l_suppkey, year, month, ROUND(SUM(COALESCE(qty, 0)) OVER (PARTITION BY l_suppkey, year ORDER BY month), 2) AS ytd FROM {MONTHLY}")
def win_running_sum(t: Tables) -> DataFrame:
    return monthly(t).select("l_suppkey", "year", "month", F.round(O.running("qty", ["l_suppkey", "year"], "month"), 2).alias("ytd"))


both("win_share_of_group", "SELECT user_id, event_type, ROUND(COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY user_id), 4) AS pct FROM {events} GROUP BY user_id, event_type")
both("win_rank_of_agg", "SELECT c_nationkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY ROUND(SUM(c_acctbal), 2) DESC, c_mktsegment) AS INT) AS r FROM {customer} GROUP BY c_nationkey, c_mktsegment")
both("win_lag", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}")
both("win_lead", "SELECT event_id, LEAD(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM {events}")
both("win_shift_lags", f"SELECT o_custkey, year, ROUND(LAG(revenue, 1) OVER (PARTITION BY o_custkey ORDER BY year), 2) AS lag1, ROUND(LAG(revenue, 2) OVER (PARTITION BY o_custkey ORDER BY year), 2) AS lag2, ROUND(LAG(revenue, 3) OVER (PARTITION BY o_custkey ORDER BY year), 2) AS lag3 FROM {YEARLY_T}")


@query(f"SELECT l_suppkey, year, month, ROUND(COALESCE(SUM(qty) OVER (PARTITION BY l_suppkey ORDER BY year, month ROWS BETWEEN 17 PRECEDING AND 1 PRECEDING), 0), 2) AS l17 FROM {MONTHLY}")
def win_rolling_excl_current(t: Tables) -> DataFrame:
    return monthly(t).select("l_suppkey", "year", "month", F.round(O.trailing_without_current("qty", 17, ["l_suppkey"], "year", "month"), 2).alias("l17"))


@query(f"SELECT l_suppkey, year, month, COALESCE(GREATEST(0, w - LAG(w) OVER (PARTITION BY l_suppkey ORDER BY year, month) - 1), 0) AS gap FROM (SELECT *, year * 12 + month AS w FROM {MONTHLY})")
def win_gap(t: Tables) -> DataFrame:
    return monthly(t).select("l_suppkey", "year", "month", O.gap(F.col("year") * 12 + F.col("month"), ["l_suppkey"], "year", "month").alias("gap"))


@query(f"SELECT l_suppkey, year, month, MAX(month) OVER (PARTITION BY l_suppkey, year) AS last_month, MIN(year) OVER (PARTITION BY l_suppkey) AS first_year FROM {MONTHLY}")
def win_group_transform(t: Tables) -> DataFrame:
    return monthly(t).select("l_suppkey", "year", "month", F.max("month").over(Window.partitionBy("l_suppkey", "year")).alias("last_month"), F.min("year").over(Window.partitionBy("l_suppkey")).alias("first_year"))


both("win_cumsum", f"SELECT o_custkey, year, ROUND(SUM(revenue) OVER (PARTITION BY o_custkey ORDER BY year ROWS UNBOUNDED PRECEDING), 2) AS total FROM {YEARLY_T}")


@query(f"SELECT l_suppkey, year, month, ROUND((qty - LAG(qty, 2) OVER (PARTITION BY l_suppkey ORDER BY year, month)) / 2, 4) AS slope FROM {MONTHLY}")
def win_rolling_slope(t: Tables) -> DataFrame:
    return monthly(t).select("l_suppkey", "year", "month", F.round(O.slope3("qty", ["l_suppkey"], "year", "month"), 4).alias("slope"))


both("win_pct_change", f"SELECT * FROM (SELECT o_custkey, year, ROUND((revenue / LAG(revenue) OVER (PARTITION BY o_custkey ORDER BY year) - 1) * 100, 2) AS pct FROM {YEARLY_T}) AS x WHERE pct > 100 OR pct < -50")
both("win_diff", f"SELECT o_custkey, year, ROUND(revenue - LAG(revenue) OVER (PARTITION BY o_custkey ORDER BY year), 2) AS diff FROM {YEARLY_T}")


@query(f"SELECT l_suppkey, year, month, qty FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, year ORDER BY month DESC) AS r FROM {MONTHLY}) WHERE r = 1")
def win_terminal_row(t: Tables) -> DataFrame:
    return O.latest(monthly(t), ["l_suppkey", "year"], F.desc("month")).select("l_suppkey", "year", "month", "qty")


both("win_max_subquery", "SELECT o.o_orderkey, o.o_custkey FROM {orders} o WHERE o.o_orderdate = (SELECT MAX(i.o_orderdate) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT event_id, COALESCE(CASE WHEN event_id % 3 <> 0 THEN d - user_id END, d - LAST(CASE WHEN event_id % 3 <> 0 THEN user_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS age FROM (SELECT *, CAST(day(ts) AS BIGINT) AS d FROM events)")
def win_birth_year_backfill(t: Tables) -> DataFrame:
    rows = t.events.withColumn("d", F.dayofmonth("ts").cast("long")).withColumn("age", F.when(F.col("event_id") % 3 != 0, F.col("d") - F.col("user_id")))
    born = O.fill_forward(F.col("d") - F.col("age"), ["user_id"], "ts", "event_id")
    return rows.select("event_id", F.coalesce("age", F.col("d") - born).alias("age"))


@query("SELECT event_id, LAG(sha256(event_id::VARCHAR), 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def win_chain_prev(t: Tables) -> DataFrame:
    h = F.sha2(F.col("event_id").cast("string"), 256)
    return t.events.select("event_id", F.lag(h, 1, "").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("SELECT division, MIN_BY(s_suppkey, (-s_acctbal, s_suppkey)) AS leader FROM (SELECT *, LAST(CASE WHEN s_suppkey % 10 = 1 THEN s_name END IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS division FROM supplier) WHERE division IS NOT NULL GROUP BY 1")
def win_division_leader(t: Tables) -> DataFrame:
    header = F.when(F.col("s_suppkey") % 10 == 1, F.col("s_name"))
    rows = t.supplier.withColumn("division", O.fill_forward(header, [], "s_suppkey")).where(F.col("division").isNotNull())
    return O.latest(rows, ["division"], F.desc("s_acctbal"), "s_suppkey").select("division", F.col("s_suppkey").alias("leader"))


@query("SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5) AS INT) AS batch FROM events")
def win_batch_number(t: Tables) -> DataFrame:
    return t.events.select("event_id", O.batch_number(5, ["user_id"], "ts", "event_id").alias("batch"))


@query(f"SELECT o_custkey, year, CASE WHEN nxt < revenue AND nxt > 100000 THEN 1 ELSE 0 END AS label FROM (SELECT *, LEAD(revenue) OVER (PARTITION BY o_custkey ORDER BY year) AS nxt FROM {YEARLY})")
def win_next_year_target(t: Tables) -> DataFrame:
    nxt = F.lead("revenue").over(Window.partitionBy("o_custkey").orderBy("year"))
    return yearly(t).withColumn("nxt", nxt).select("o_custkey", "year", F.when((F.col("nxt") < F.col("revenue")) & (F.col("nxt") > 100000), 1).otherwise(0).alias("label"))


@query(f"SELECT a.o_custkey, ROUND(a.revenue, 2) AS perf, ROUND(COALESCE(b.revenue, 0), 2) AS next_cost FROM {YEARLY} a LEFT JOIN {YEARLY} b ON a.o_custkey = b.o_custkey AND b.year = 1998 WHERE a.year = 1997")
def jn_shifted_year(t: Tables) -> DataFrame:
    y = yearly(t)
    nxt = y.where("year = 1998").select("o_custkey", F.col("revenue").alias("n"))
    return y.where("year = 1997").join(nxt, "o_custkey", "left").select("o_custkey", F.round("revenue", 2).alias("perf"), F.round(F.coalesce("n", F.lit(0.0)), 2).alias("next_cost"))


# sort, limit, paging, sampling --------------------------------------------------------------------

both("srt_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM {customer} ORDER BY c_nationkey ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey")
both("srt_nulls_last", "SELECT event_id, NULLIF(value, 0) AS v FROM {events} ORDER BY v DESC NULLS LAST, event_id")
both("srt_expr", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem} ORDER BY l_extendedprice / NULLIF(l_quantity, 0) DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey")
both("lim_topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
both("lim_offset_page", "SELECT o_orderkey, o_totalprice, CAST(ceil(total / CAST(25 AS DOUBLE)) AS INT) AS pages FROM (SELECT o_orderkey, o_totalprice, COUNT(*) OVER () AS total FROM {orders}) AS x ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 20")
def lim_auto(t: Tables) -> DataFrame:
    from plumbline.functions.sqlguard import limited

    return t.sql(limited("SELECT n_nationkey FROM {nation} ORDER BY n_nationkey"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def lim_topk_per_group(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return t.events.withColumn("r", r).where("r <= 10").select("user_id", "event_id")


def both_tails(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    low = df.orderBy(value, key).limit(k).withColumn("side", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(value), key).limit(k).withColumn("side", F.lit("high")))


@query("(SELECT c_custkey, c_acctbal, 'low' AS side FROM customer ORDER BY c_acctbal, c_custkey LIMIT 50) UNION ALL (SELECT c_custkey, c_acctbal, 'high' FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50)")
def srt_both_tails(t: Tables) -> DataFrame:
    return both_tails(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 50)


@query()
def srt_random_sample(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").orderBy(F.rand(42)).limit(5)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 6")
def lim_search_prefix(t: Tables) -> DataFrame:
    return t.documents.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id").orderBy("doc_id").limit(6)


@query("SELECT event_id FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n >= 12")
def flt_group_size(t: Tables) -> DataFrame:
    big = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 12")
    return t.events.join(big, ["user_id", "event_type"], "left_semi").select("event_id")
