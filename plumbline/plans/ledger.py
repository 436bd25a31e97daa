"""Ledger, resolution, scoring and registry queries. Events stand for forecasts: user = author, event type = category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.operators import ledger as L
from plumbline.operators.joins import events_after

from .base import Tables, both, query

HASH = "sha256(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || event_id || '|' || user_id || '|' || event_type)"
STATUS = "CASE WHEN event_id % 3 <> 0 THEN 'PENDING' WHEN value > 60 THEN 'CORRECT' WHEN value > 20 THEN 'INCORRECT' ELSE 'VOID' END"
LEDGER = f"(SELECT *, {STATUS} AS status, CASE WHEN event_id % 2 = 0 THEN 'NFL' ELSE 'MLB' END AS sport FROM events)"


def ledger(t: Tables) -> DataFrame:
    """Forecasts with their resolution (left join, status PENDING where there is none)."""
    done = t.events.where("event_id % 3 = 0").select("event_id", F.when(F.col("value") > 60, "CORRECT").when(F.col("value") > 20, "INCORRECT").otherwise("VOID").alias("status"))
    sport = F.when(F.col("event_id") % 2 == 0, F.lit("NFL")).otherwise("MLB")
    return t.events.join(done, "event_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING"))).withColumn("sport", sport)


def hashed(t: Tables) -> DataFrame:
    return t.events.withColumn("hash", S.forecast_hash(F.col("ts"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")))


query(f"SELECT event_id, {HASH} AS hash FROM events", "led_prediction_hash")(lambda t: hashed(t).select("event_id", "hash"))


@query(f"""WITH RECURSIVE r AS (SELECT event_id, user_id, {HASH} AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT user_id, n, event_id, sha256(h) AS chain_hash FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.event_id, sha256(r.h || c.chain_hash) FROM r JOIN c ON r.user_id = c.user_id AND r.n = c.n + 1) SELECT event_id, chain_hash FROM c""")
def led_chain_append(t: Tables) -> DataFrame:
    return L.append_chain(hashed(t), "user_id", ["ts", "event_id"], "hash").select("event_id", "chain_hash")


@query("SELECT user_id, MIN(n)::INT AS position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE event_id % 997 = 0 OR n IN (SELECT m + 1 FROM (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events) x WHERE u = user_id AND e % 997 = 0) GROUP BY 1")
def led_chain_verify(t: Tables) -> DataFrame:
    chained = L.append_chain(hashed(t), "user_id", ["ts", "event_id"], "hash")
    forged = chained.withColumn("chain_hash", F.when(F.col("event_id") % 997 == 0, F.lit("forged")).otherwise(F.col("chain_hash")))
    return L.first_break(forged, "user_id", ["ts", "event_id"], "hash")


@query("""SELECT event_id, sha256('{"as_of":"2024-02-01","event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS digest FROM events""")
def led_payload_snapshot(t: Tables) -> DataFrame:
    payload = F.to_json(F.struct(F.lit("2024-02-01").alias("as_of"), "event_id", "event_type"))
    return t.events.select("event_id", F.sha2(payload, 256).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN d <= o_orderdate THEN 1.0 WHEN n >= 365 THEN 2.0 WHEN n >= 90 THEN 1.5 WHEN n >= 30 THEN 1.25 WHEN n >= 7 THEN 1.1 ELSE 1.0 END::DOUBLE AS w FROM (SELECT *, TIMESTAMP '1998-06-01' AS d, floor(epoch(TIMESTAMP '1998-06-01' - o_orderdate) / 86400) AS n FROM orders)""")
def res_timeliness(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.timeliness(F.col("o_orderdate").cast("timestamp"), F.lit("1998-06-01").cast("timestamp")).alias("w"))


@query("SELECT event_id, ROUND(CASE WHEN event_id % 3 = 0 THEN (1 - (value / 100) ** 2) * 1.5 WHEN event_id % 3 = 1 THEN CASE WHEN value > 50 THEN 1.5 ELSE 0.0 END END, 10) AS score FROM events")
def res_weighted_score(t: Tables) -> DataFrame:
    e = F.col("event_id") % 3
    brier = F.when(e == 0, F.pow(F.col("value") / 100, F.lit(2)))
    return t.events.select("event_id", F.round(S.weighted(F.when(e == 1, F.col("value") > 50), brier, F.lit(1.5)), 10).alias("score"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'VOID' ELSE {STATUS} END AS status FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def res_record(t: Tables) -> DataFrame:
    from plumbline.sources.sinks import merge_upsert

    old = ledger(t).where("status <> 'PENDING'").select("event_id", "status")
    return merge_upsert(old, t.events.where("event_id % 5 = 0").select("event_id", F.lit("VOID").alias("status")), ["event_id"])


both("res_pending", "SELECT e.event_id, COALESCE(NULLIF(e.event_type, 'view'), 'NFL') AS sport FROM {events} e LEFT JOIN (SELECT event_id, CASE WHEN value > 50 THEN 'CORRECT' ELSE 'PENDING' END AS status FROM {events} WHERE event_id % 3 = 0) r ON e.event_id = r.event_id WHERE r.event_id IS NULL OR r.status = 'PENDING'")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Totals and accuracy; accuracy is null without resolved forecasts."""
    right, judged = F.count_if(F.col("status") == "CORRECT"), F.count_if(F.col("status").isin("CORRECT", "INCORRECT"))
    brier = F.when(F.col("status").isin("CORRECT", "INCORRECT"), F.pow(F.col("value") / 100 - F.when(F.col("status") == "CORRECT", 1).otherwise(0), F.lit(2)))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("status") != "PENDING").alias("resolved"), right.alias("correct"), F.round(F.try_divide(right, judged), 4).alias("accuracy"), F.round(F.avg(brier), 6).alias("avg_brier"))


SUMMARY = """COUNT(*) AS total, COUNT(*) FILTER (WHERE status <> 'PENDING') AS resolved, COUNT(*) FILTER (WHERE status = 'CORRECT') AS correct, ROUND(COUNT(*) FILTER (WHERE status = 'CORRECT') / NULLIF(COUNT(*) FILTER (WHERE status IN ('CORRECT', 'INCORRECT')), 0), 4) AS accuracy,
ROUND(AVG(CASE WHEN status IN ('CORRECT', 'INCORRECT') THEN (value / 100 - CASE WHEN status = 'CORRECT' THEN 1 ELSE 0 END) ** 2 END), 6) AS avg_brier"""
query(f"SELECT user_id, sport, {SUMMARY} FROM {LEDGER} GROUP BY 1, 2 ORDER BY accuracy DESC NULLS LAST", "res_pundit_summary")(lambda t: summary(ledger(t), "user_id", "sport").orderBy(F.desc_nulls_last("accuracy")))
query(f"SELECT event_type, {SUMMARY} FROM {LEDGER} WHERE user_id = 7 GROUP BY 1", "res_pundit_category")(lambda t: summary(ledger(t).where("user_id = 7"), "event_type"))
query(f"SELECT event_id, status FROM {LEDGER} WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20", "res_history")(lambda t: ledger(t).where("user_id = 7").orderBy(F.desc("ts"), "event_id").offset(20).limit(20).select("event_id", "status"))
query(f"SELECT event_id, status FROM {LEDGER} WHERE status IN ('CORRECT', 'INCORRECT') ORDER BY ts DESC, event_id LIMIT 10", "res_recent")(lambda t: ledger(t).where("status in ('CORRECT', 'INCORRECT')").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id", "status"))


@query(f"SELECT event_id, status, COUNT(*) OVER () AS total FROM {LEDGER} WHERE contains(lower(event_type), 'err') AND status = 'CORRECT' AND sport = 'NFL' ORDER BY ts DESC, event_id LIMIT 25")
def res_search(t: Tables) -> DataFrame:
    hits = ledger(t).where(F.contains(F.lower("event_type"), F.lit("err")) & (F.col("status") == "CORRECT") & (F.col("sport") == "NFL"))
    total = hits.agg(F.count("*").alias("total"))  # one row
    return hits.crossJoin(F.broadcast(total)).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "status", "total")


query(f"SELECT day(ts)::INT AS season, {SUMMARY} FROM {LEDGER} GROUP BY 1", "res_draft_summary")(lambda t: summary(ledger(t).withColumn("season", F.dayofmonth("ts")), "season"))


@query(f"SELECT status, COUNT(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS members FROM {LEDGER} WHERE user_id = 7 GROUP BY 1")
def res_draft_results(t: Tables) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    return ledger(t).where("user_id = 7").groupBy("status").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("members"))


@query("""SELECT COALESCE(a, 'all') AS prompt, COALESCE(b, 'all') AS provider, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'CORRECT') AS correct FROM (SELECT 'p' || event_id % 2 AS a, 'v' || event_id % 3 AS b, """ + STATUS + """ AS status FROM events) GROUP BY CUBE (a, b)""")
def res_provenance_quality(t: Tables) -> DataFrame:
    rows = ledger(t).select(F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("a"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("b"), "status")
    each = rows.cube("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "CORRECT").alias("correct"))
    return each.select(F.coalesce("a", F.lit("all")).alias("prompt"), F.coalesce("b", F.lit("all")).alias("provider"), "n", "correct")


@query(f"SELECT 'articles' AS report, source AS k, COUNT(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'status', status, COUNT(*) FROM {LEDGER} GROUP BY 2 UNION ALL SELECT 'authors', user_id::VARCHAR, COUNT(*) FROM {LEDGER} WHERE status IN ('CORRECT', 'INCORRECT') GROUP BY 2 HAVING COUNT(*) >= 3")
def res_precision_report(t: Tables) -> DataFrame:
    part = lambda name, df, k: df.groupBy(k.cast("string").alias("k")).agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "k", "n")
    led = ledger(t)
    return part("articles", t.documents, F.col("source")).unionByName(part("status", led, F.col("status"))).unionByName(part("authors", led.where("status in ('CORRECT', 'INCORRECT')"), F.col("user_id")).where("n >= 3"))


@query("""SELECT event_id, CASE WHEN length(blob) < 200 THEN 'insufficient_data' ELSE 'classified' END AS cls, COALESCE(first_id, -1)::BIGINT AS evidence FROM (SELECT a.event_id, COALESCE(string_agg(e.event_type || ':' || e.props, '---' ORDER BY e.ts, e.event_id), '') AS blob, MIN_BY(e.event_id, (e.ts, e.event_id)) AS first_id
FROM (SELECT * FROM events WHERE event_type = 'error') a LEFT JOIN LATERAL (SELECT * FROM events x WHERE x.user_id = a.user_id AND x.ts > a.ts AND x.ts <= a.ts + INTERVAL 3 DAY ORDER BY x.ts, x.event_id LIMIT 10) e ON TRUE GROUP BY 1)""")
def acc_scan(t: Tables) -> DataFrame:
    return scan(t, lambda blob: F.when(F.length(blob) < 200, "insufficient_data").otherwise("classified"))


def scan(t: Tables, classify) -> DataFrame:
    """(event_id, cls, evidence) of each miss: classify(text) of the first ten events within three days of it, and the first of them (-1: none). `classify` is any function of a text column: rules, or a vectorised UDF around a model."""
    cols = ["user_id", "event_id", "ts"]
    misses = t.events.where("event_type = 'error'").select(*cols)
    later = t.events.select(*cols, F.concat_ws(":", "event_type", "props").alias("text"))
    found = events_after(misses, later, "user_id", "ts", "ts", "event_id", 3 * 86_400, 10)
    # at most ten parts a miss
    blob = found.groupBy(F.col("anchor_event_id").alias("event_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "event_text", "event_event_id"))).alias("parts"))
    blob = blob.select("event_id", F.array_join(F.transform("parts", lambda p: p.event_text), "---").alias("blob"), F.col("parts")[0]["event_event_id"].alias("first_id"))
    joined = misses.select("event_id").join(blob, "event_id", "left")
    return joined.select("event_id", classify(F.coalesce("blob", F.lit(""))).alias("cls"), F.coalesce("first_id", F.lit(-1)).alias("evidence"))


both("acc_summary", "SELECT user_id, event_type, COUNT(*) AS n, ROUND(COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY user_id), 2) AS pct FROM {events} GROUP BY user_id, event_type")


@query()
def ded_cross_article(t: Tables) -> DataFrame:
    claims = t.events.select("event_id", "ts", "user_id", F.lower(F.trim("event_type")).alias("category"), F.concat_ws(" ", "event_type", "props").alias("claim"))
    return L.void_near_duplicates(claims, ["user_id", "category"], ["ts", "event_id"], "event_id", "claim")


@query()
def ded_claims(t: Tables) -> DataFrame:
    return L.distinct_claims(t.conversations, "conv_id", "turn", "text")


@query("SELECT user_id, COUNT(*) AS n FROM events WHERE event_type NOT IN ('signup', 'view') AND ts >= (SELECT MAX(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 HAVING COUNT(*) >= 12")
def reg_discovery(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    recent = t.events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("interval 7 days"))
    known = t.spark.createDataFrame([("signup",), ("view",)], "event_type string")
    return recent.join(F.broadcast(known), "event_type", "left_anti").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 12")


@query("SELECT c_custkey, CASE WHEN n >= 15 THEN 'daily' WHEN n >= 7 THEN 'twice_weekly' WHEN n >= 3 THEN 'weekly' WHEN n >= 1 THEN 'biweekly' ELSE 'monthly' END AS tier FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1)")
def reg_cadence(t: Tables) -> DataFrame:
    posts = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(posts, "c_custkey", "left").select("c_custkey", S.cadence(F.coalesce("n", F.lit(0))).alias("tier"))


@query("SELECT s_nationkey AS source_id, s_suppkey AS pundit_id FROM supplier WHERE s_suppkey % 2 = 1")
def reg_seed(t: Tables) -> DataFrame:
    nested = t.supplier.groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("pundits"))
    flat = nested.select(F.col("s_nationkey").alias("source_id"), F.explode("pundits").alias("pundit_id"))
    return flat.join(t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("pundit_id")), "pundit_id", "left_anti").select("source_id", "pundit_id")


@query("SELECT n_regionkey AS region, string_agg(n_name, '|' ORDER BY n_name) AS nations, COUNT(*)::INT AS n FROM nation GROUP BY 1")
def reg_export(t: Tables) -> DataFrame:
    packed = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("rows"))
    return packed.select("region", F.array_join(F.transform("rows", lambda r: r.n_name), "|").alias("nations"), F.size("rows").alias("n"))


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'author_field' WHEN contains(lower(substring(text, 1, 500)), 'les ') THEN 'byline' WHEN source IN ('src3', 'src4') THEN 'source_default' ELSE 'unmatched' END AS method FROM documents")
def med_match_cascade(t: Tables) -> DataFrame:
    author = F.when(F.col("source").isin("src1", "src2"), F.lit("author_field"))
    byline = F.when(F.contains(F.lower(F.substring("text", 1, 500)), F.lit("les ")), F.lit("byline"))
    default = F.when(F.col("source").isin("src3", "src4"), F.lit("source_default"))
    return t.documents.select("doc_id", F.coalesce(author, byline, default, F.lit("unmatched")).alias("method"))


@query("SELECT team, (n // 5)::INT AS batch, COUNT(*) AS articles, MIN(doc_id) AS first_doc FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY doc_id) - 1 AS n FROM (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'T' END, CASE WHEN regexp_matches(text, '(?i)\\band\\b') THEN 'A' END], lambda x: x IS NOT NULL)) AS team FROM documents)) GROUP BY 1, 2".replace("\\\\", "\\"))
def med_team_batch(t: Tables) -> DataFrame:
    from plumbline.functions.strings import mentions
    from plumbline.operators.windows import batch_number

    rows = t.documents.select("doc_id", F.explode(mentions(F.col("text"), {"the": "T", "and": "A"})).alias("team"))
    return rows.withColumn("batch", batch_number(5, ["team"], "doc_id")).groupBy("team", "batch").agg(F.count("*").alias("articles"), F.min("doc_id").alias("first_doc"))
