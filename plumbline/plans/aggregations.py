"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import aggregates as A
from plumbline.operators.ranks import quantiles

from .base import Tables, both, query

both("agg_basic", "SELECT CAST(year(o_orderdate) AS INT) AS year, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice), 2) AS mean, MAX(o_totalprice) AS top, MIN(o_totalprice) AS low, COUNT(*) AS n FROM {orders} GROUP BY CAST(year(o_orderdate) AS INT)")
both("agg_count_distinct", "SELECT CAST(year(o_orderdate) AS INT) AS year, COUNT(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY CAST(year(o_orderdate) AS INT)")
both("agg_stddev_pop", "SELECT o_orderstatus, ROUND(STDDEV_POP(o_totalprice), 4) AS spread FROM {orders} GROUP BY o_orderstatus")
both("agg_stddev_samp", "SELECT o_orderstatus, ROUND(STDDEV_SAMP(o_totalprice), 4) AS spread FROM {orders} GROUP BY o_orderstatus")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, ROUND(percentile_cont(0.75) WITHIN GROUP (ORDER BY o_totalprice), 2) AS p75, ROUND(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 2) AS p90, ROUND(percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice), 2) AS p95 FROM orders GROUP BY CAST(year(o_orderdate) AS INT)")
def agg_percentile_cont(t: Tables) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_totalprice")
    got = quantiles(rows, ["year"], "o_totalprice", {"p75": 0.75, "p90": 0.9, "p95": 0.95})
    return got.select("year", *(F.round(c, 2).alias(c) for c in ("p75", "p90", "p95")))


@query("SELECT c_mktsegment, list_sort(list(c_acctbal))[(COUNT(*) * 0.25)::INT + CASE WHEN (COUNT(*) * 0.25)::INT > COUNT(*) * 0.25 THEN 0 ELSE 1 END] AS q1, ROUND(median(c_acctbal), 4) AS mid FROM customer GROUP BY 1")
def agg_quartile_index(t: Tables) -> DataFrame:
    return A.quartile_by_index(t.customer, ["c_mktsegment"], "c_acctbal", 0.25, "q1", "mid")


both("agg_countif", "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(*) FILTER (WHERE value > 50) AS high FROM {events} GROUP BY user_id")


@query("SELECT user_id, ROUND(COUNT(*) FILTER (WHERE event_type = 'error') / NULLIF(COUNT(*) FILTER (WHERE event_type IN ('error', 'click')), 0), 4) AS share FROM events GROUP BY 1")
def agg_safe_ratio(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.try_divide(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type").isin("error", "click"))), 4).alias("share"))


both("agg_weighted_sum", "SELECT l_suppkey, ROUND(SUM(l_extendedprice * l_discount), 2) AS exposure FROM {lineitem} GROUP BY l_suppkey")
both("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) >= 12")
both("agg_ordinal_group", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2")


@query("SELECT o_custkey, ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f, ROUND(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS o, ROUND(SUM(o_totalprice) - SUM(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice ELSE 0 END), 2) + 0.0 AS other FROM orders GROUP BY 1")
def agg_conditional_pivot(t: Tables) -> DataFrame:
    on = lambda *k: F.sum(F.when(F.col("o_orderstatus").isin(*k), F.col("o_totalprice")).otherwise(0.0))
    return t.orders.groupBy("o_custkey").agg(F.round(on("F"), 2).alias("f"), F.round(on("O"), 2).alias("o"), (F.round(F.sum("o_totalprice") - on("F", "O"), 2) + 0.0).alias("other"))


@query("SELECT user_id, FIRST(value ORDER BY event_id) FILTER (WHERE event_type = 'click') AS click, FIRST(value ORDER BY event_id) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1")
def agg_pivot_first(t: Tables) -> DataFrame:
    return A.pivot_first(t.events, ["user_id"], "event_type", ["click", "error"], "value", "event_id")


@query("SELECT year, ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS \"F\", ROUND(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS \"O\" FROM (SELECT year(o_orderdate)::INT AS year, * FROM orders) GROUP BY 1")
def agg_pivot_fill(t: Tables) -> DataFrame:
    wide = t.orders.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.sum("o_totalprice"), 2))
    return wide.na.fill(0.0)


both("agg_two_level", "SELECT region, ROUND(AVG(mean), 4) AS league FROM (SELECT n_regionkey AS region, c_nationkey, AVG(c_acctbal) AS mean FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_nationkey) AS a GROUP BY region")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def agg_max_by_row(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice", r.alias("r")).where("r = 1").drop("r")


both("agg_multi_stat", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_quantity), 4) AS m, ROUND(STDDEV_SAMP(l_quantity), 4) AS sd, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(l_quantity) AS n, COUNT(DISTINCT l_quantity) AS k FROM {lineitem} GROUP BY l_returnflag")


@query("""SELECT b.bucket::INT AS bucket, COUNT(v)::BIGINT AS n, COALESCE(MIN(k), -1)::BIGINT AS first_member FROM range(15) b(bucket) LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS v, LEAST(floor(c_acctbal / w), 14)::INT AS bucket FROM customer, (SELECT ceil(MAX(c_acctbal) / 15) AS w FROM customer) WHERE c_acctbal >= 0) x ON x.bucket = b.bucket GROUP BY 1""")
def agg_histogram(t: Tables) -> DataFrame:
    h = A.histogram(t.customer.where("c_acctbal >= 0"), "c_acctbal", "c_custkey", 15)
    return h.select("bucket", "n", F.coalesce("first_member", F.lit(-1)).alias("first_member"))


both("agg_value_counts", "SELECT event_type, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 6) AS share FROM {events} GROUP BY event_type")


@query("SELECT o_orderstatus, ROUND(skewness(o_totalprice), 4) AS skew, ROUND(kurtosis(o_totalprice), 4) AS kurt FROM orders GROUP BY 1")
def agg_skew_kurt(t: Tables) -> DataFrame:
    skew, kurt = A.skew_kurt("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(F.round(skew, 4).alias("skew"), F.round(kurt, 4).alias("kurt"))


@query("SELECT bucket, CASE WHEN n < 2 THEN NULL WHEN tot = 0 THEN 0.0 ELSE ROUND(1 - res / tot, 4) END AS r2 FROM (SELECT l_returnflag AS bucket, COUNT(*) AS n, SUM((l_extendedprice - l_quantity * 1000) ** 2) AS res, VAR_POP(l_extendedprice) * COUNT(*) AS tot FROM lineitem GROUP BY 1)")
def agg_r2_by_bucket(t: Tables) -> DataFrame:
    return A.r2_by(t.lineitem.select(F.col("l_returnflag").alias("bucket"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p")), ["bucket"], "y", "p")


@query("SELECT 'evens' AS column_name, ROUND(AVG(CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 1.0 END), 4) AS null_rate FROM events UNION ALL SELECT 'value', ROUND(AVG(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM events")
def agg_null_rate(t: Tables) -> DataFrame:
    return A.null_rates(t.events.select(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("evens"), "value"))


both("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")


@query("SELECT c_nationkey, ROUND(SUM(total) OVER (ORDER BY total DESC, c_nationkey ROWS UNBOUNDED PRECEDING) / SUM(total) OVER (), 6) AS share FROM (SELECT c_nationkey, SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)")
def agg_cumulative_share(t: Tables) -> DataFrame:
    totals = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("total"))
    return A.cumulative_share(totals, "total", ["c_nationkey"]).select("c_nationkey", F.round("share", 6).alias("share"))


@query("""SELECT tp, fp, tn, fn, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 4) AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 4) AS recall, ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 4) AS f1, ROUND(COALESCE((tp + tn) / NULLIF(tp + tn + fp + fn, 0), 0), 4) AS accuracy FROM
(SELECT COUNT(*) FILTER (WHERE quality = 1 AND p) AS tp, COUNT(*) FILTER (WHERE quality = 0 AND p) AS fp, COUNT(*) FILTER (WHERE quality = 0 AND NOT p) AS tn, COUNT(*) FILTER (WHERE quality = 1 AND NOT p) AS fn FROM (SELECT quality, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)))""")
def agg_confusion(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("guess"))
    m = A.confusion(rows, "truth", "guess")
    return m.select("tp", "fp", "tn", "fn", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query("SELECT s_suppkey, ROUND((rank() OVER (ORDER BY s_nationkey) + (COUNT(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0) / COUNT(*) OVER () * 100, 4) AS pct FROM supplier")
def agg_rank_pct(t: Tables) -> DataFrame:
    return A.rank_pct(t.supplier, "s_nationkey").select("s_suppkey", F.round(F.col("pct") * 100, 4).alias("pct"))


both("agg_null_keys", "SELECT k, COUNT(*) AS n FROM (SELECT NULLIF(event_type, 'error') AS k FROM {events}) AS a GROUP BY k ORDER BY n DESC, k NULLS LAST")


@query()
def agg_topfactor(t: Tables) -> DataFrame:
    m = F.map_from_arrays(F.array(F.lit("qty"), F.lit("disc"), F.lit("tax"), F.lit("line")), F.array(F.col("l_quantity"), -F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_linenumber").cast("double")))
    return t.lineitem.select("l_orderkey", "l_linenumber", A.top_factors(m, 3).alias("factors"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def agg_string_list(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("segments"))


@query("SELECT c_nationkey, ROUND(SUM(c_acctbal) - COALESCE(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 0), 2) + 0.0 AS gap FROM customer GROUP BY 1")
def agg_aligned_diff(t: Tables) -> DataFrame:
    part = F.coalesce(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))), F.lit(0.0))
    return t.customer.groupBy("c_nationkey").agg((F.round(F.sum("c_acctbal") - part, 2) + 0.0).alias("gap"))


def _ranked(t: Tables) -> DataFrame:
    return t.customer.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")))


RANKED = "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)"


@query(f"SELECT c_nationkey, ROUND(SUM(c_acctbal), 2) AS top10 FROM {RANKED} WHERE r <= 10 GROUP BY 1")
def agg_topn_sum(t: Tables) -> DataFrame:
    return _ranked(t).where("r <= 10").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("top10"))


@query(f"SELECT c_nationkey, ROUND(SUM(c_acctbal), 2) AS band FROM {RANKED} WHERE r BETWEEN 11 AND 30 GROUP BY 1")
def agg_rank_band_sum(t: Tables) -> DataFrame:
    return _ranked(t).where("r between 11 and 30").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("band"))


@query("""SELECT c_mktsegment, a, b, CASE WHEN a >= b THEN 'n1' ELSE 'n2' END AS winner, ROUND(abs(a - b), 2) AS gap FROM (SELECT c_mktsegment, COALESCE(ROUND(SUM(c_acctbal) FILTER (WHERE c_nationkey = 1), 2), 0.0) AS a, COALESCE(ROUND(SUM(c_acctbal) FILTER (WHERE c_nationkey = 2), 2), 0.0) AS b FROM customer WHERE c_nationkey IN (1, 2) GROUP BY 1)""")
def agg_unstack_compare(t: Tables) -> DataFrame:
    wide = t.customer.where("c_nationkey in (1, 2)").groupBy("c_mktsegment").pivot("c_nationkey", [1, 2]).agg(F.round(F.sum("c_acctbal"), 2)).na.fill(0.0).toDF("c_mktsegment", "a", "b")
    return wide.withColumn("winner", F.when(F.col("a") >= F.col("b"), "n1").otherwise("n2")).withColumn("gap", F.round(F.abs(F.col("a") - F.col("b")), 2))


both("agg_describe", "SELECT COUNT(o_totalprice) AS n, ROUND(AVG(o_totalprice), 4) AS mean, ROUND(STDDEV_SAMP(o_totalprice), 4) AS sd, MIN(o_totalprice) AS lo, ROUND(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q2, ROUND(percentile_cont(0.75) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q3, MAX(o_totalprice) AS hi FROM {orders}")
