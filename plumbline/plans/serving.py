"""Read models for dashboards and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sqlguard import run_select
from plumbline.session import scratch

from .base import Tables, both, query
from .windows import both_tails

both("srv_usage_daily", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(*) FILTER (WHERE event_type <> 'error') AS good FROM {events} GROUP BY CAST(ts AS DATE)")
both("srv_top_endpoints", "SELECT event_type, COUNT(*) AS n, ROUND(COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (), 4) AS share FROM {events} GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")


@query("SELECT user_id, COUNT(*) FILTER (WHERE ts > last - INTERVAL 60 MINUTE) AS hour, COUNT(*) FILTER (WHERE ts > last - INTERVAL 1 DAY) AS day FROM events, (SELECT MAX(ts) AS last FROM events) GROUP BY 1")
def srv_limits(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    e = t.events.crossJoin(F.broadcast(last))
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") > F.col("last") - F.expr("interval 60 minutes")).alias("hour"), F.count_if(F.col("ts") > F.col("last") - F.expr("interval 1 day")).alias("day"))


@query("SELECT c_custkey, c_name, n_name, ROUND(COALESCE(total, 0), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def srv_roster(t: Tables) -> DataFrame:
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    dim = F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows
    return t.customer.join(dim, "c_nationkey").join(totals, "c_custkey", "left").select("c_custkey", "c_name", "n_name", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


both("srv_search_index", "SELECT c_custkey AS id, LOWER(c_name) AS k, 'customer' AS kind FROM {customer} UNION ALL SELECT s_suppkey, LOWER(s_name), 'supplier' FROM {supplier}")
both("srv_timeline", "SELECT CAST(o_orderdate AS DATE) AS day, 'order' AS kind, o_orderkey AS ref FROM {orders} WHERE o_custkey = 7 UNION ALL SELECT CAST(l_shipdate AS DATE), 'ship', l_orderkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey = 7")


@query("SELECT c_nationkey, COUNT(*) AS players, ROUND(SUM(c_acctbal), 2) AS cap, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_acctbal DESC, c_custkey) FILTER (WHERE r <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) GROUP BY 1")
def srv_war_room(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranked = t.customer.withColumn("r", r)
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "c_custkey"))))
    return ranked.groupBy("c_nationkey").agg(F.count("*").alias("players"), F.round(F.sum("c_acctbal"), 2).alias("cap"), F.array_join(F.transform(top, lambda x: x.c_custkey.cast("string")), ",").alias("top"))


@query("""SELECT '[{"n_nationkey": 0}, {"n_nationkey": 1}]' AS result, TRUE AS refused""")
def srv_sql_agent(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("plumbline_nation")
    ok = run_select(t.spark, "SELECT n_nationkey FROM plumbline_nation WHERE n_nationkey < 2 ORDER BY n_nationkey")
    return t.spark.createDataFrame([(ok, "error" in run_select(t.spark, "DROP TABLE x"))], "result string, refused boolean")


@query("(SELECT o_orderkey, ROUND(o_totalprice - 150000, 2) AS delta, 'low' AS side FROM orders ORDER BY delta, o_orderkey LIMIT 50) UNION ALL (SELECT o_orderkey, ROUND(o_totalprice - 150000, 2) AS delta, 'high' FROM orders ORDER BY delta DESC, o_orderkey LIMIT 50)")
def srv_misses(t: Tables) -> DataFrame:
    return both_tails(t.orders.select("o_orderkey", F.round(F.col("o_totalprice") - 150000, 2).alias("delta")), "delta", "o_orderkey", 50)


# streaming counterparts over the event feed ---------------------------------------------------------


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids FROM events")
def stm_dedupe(t: Tables) -> DataFrame:
    from plumbline.streaming import feeds

    once = feeds.drained(feeds.deduplicated(feeds.source(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema), "event_id", "ts", "7 days"), "append", ("event_id long, ts timestamp"))
    return once.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def stm_daily_usage(t: Tables) -> DataFrame:
    from plumbline.streaming import feeds

    daily = feeds.daily(feeds.source(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema))
    got = feeds.drained(daily, "complete", "start timestamp, event_type string, n long, total double")
    return got.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, COUNT(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) WHERE fresh = 1 GROUP BY 1")
def stm_sessions(t: Tables) -> DataFrame:
    from plumbline.streaming import feeds

    got = feeds.drained(feeds.sessions(feeds.source(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema), "6 hours"), "complete", "user_id long, start timestamp, n long")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"))


# a work queue, rate limits and late rows: state across triggers -------------------------------------

MAIL = "[a-z0-9_.]+@[a-z0-9_.]+[a-z]"


@query(f"SELECT sha256(text) AS content_hash, CASE WHEN len(m) > 0 THEN 'done' ELSE 'open' END AS status, len(m)::BIGINT AS n, COALESCE(list_min(m), '') AS first FROM (SELECT text, regexp_extract_all(text, '{MAIL}') AS m FROM (SELECT DISTINCT text FROM documents WHERE length(text) > 50))")
def stm_work_queue(t: Tables) -> DataFrame:
    """Contacts out of articles by a work queue in three triggers, the last of them repeated; articles without any stay open."""
    from plumbline.streaming import numbered, workqueue

    root = scratch(t.spark)
    docs = t.documents.where(F.length("text") > 50).select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "text", "doc_id")

    def work(items: DataFrame) -> DataFrame:
        found = F.regexp_extract_all("text", F.lit(f"({MAIL})"), F.lit(1))
        return items.select("content_hash", F.explode(found).alias("mail")).withColumn("error", F.lit(None).cast("string"))

    item = docs.select("content_hash", "text").schema
    queue = workqueue.WorkQueue(t.spark, f"{root}/queue", "content_hash", item, "mail string", work)
    run = lambda stream: numbered.run_once(stream, queue.step, f"{root}/state")
    numbered.in_arrivals((docs.where(F.col("doc_id") % 3 == k).drop("doc_id") for k in range(3)), f"{root}/in", run)
    numbered.uncommit(t.spark, f"{root}/state", 2)
    run(numbered.folder_stream(t.spark, f"{root}/in", item))
    done = queue.results().groupBy("content_hash").agg(F.count("*").alias("n"), F.min("mail").alias("first")).withColumn("status", F.lit("done"))
    left = queue.waiting().select("content_hash", F.lit(0).cast("long").alias("n"), F.lit("").alias("first"), F.lit("open").alias("status"))
    return done.unionByName(left)


RATES = {"free": 1, "pro": 2}


@query("""SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE hits > CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END) AS refused
FROM (SELECT user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events) GROUP BY 1""")
def stm_rate_limit(t: Tables) -> DataFrame:
    """Requests beyond the limit of their user's tier in the last 60 seconds, refused ones counted, over three arrivals."""
    from plumbline.streaming import numbered, ratelimit

    root = scratch(t.spark)
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(F.col("user_id") % 2 == 0, "free").otherwise("pro").alias("tier"))
    third = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    said = numbered.Numbered(t.spark, f"{root}/said", "user_id long, event_id long, allowed boolean")
    limited = lambda stream: ratelimit.decisions(stream, "user_id", "event_id", "ts", "tier", RATES, 60, count_refused=True)
    numbered.in_arrivals((events.where(third == k) for k in range(3)), f"{root}/in", lambda stream: numbered.run_once(limited(stream), said.write, f"{root}/state"))
    return said.all().groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("refused"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS kind, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def stm_late_days(t: Tables) -> DataFrame:
    """Daily totals of a feed that arrives out of order, a seventh of it twice."""
    from plumbline.streaming import latedays, numbered

    root = scratch(t.spark)
    days = latedays.DailyTotals(t.spark, f"{root}/totals", "event_id", "long", "ts", "event_type", "value")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    arrivals = (t.events.where((part == k) | ((part == 0) & (F.lit(k) > 0) & (F.col("event_id") % 7 == 0))) for k in range(3))
    numbered.in_arrivals(arrivals, f"{root}/in", lambda stream: numbered.run_once(stream, days.step, f"{root}/state"))
    return days.totals().select("day", "kind", "n", F.round("total", 2).alias("total"))
