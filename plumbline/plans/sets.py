"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Tables, both, query

both("set_union_all_typed", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS DOUBLE) AS price, 'customer' AS kind FROM {customer} UNION ALL SELECT p_partkey, p_name, CAST(NULL AS DOUBLE), p_retailprice, 'part' FROM {part}")


@query("""SELECT CAST(o_orderdate AS DATE) AS day, 'ordered' AS kind, o_orderkey AS ref FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT CAST(l_shipdate AS DATE), 'shipped', l_orderkey FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT CAST(ts AS DATE), event_type, event_id FROM events WHERE event_type IN ('purchase', 'error')""")
def set_union_events(t: Tables) -> DataFrame:
    pick = lambda df, day, kind, ref: df.select(F.to_date(day).alias("day"), kind.alias("kind"), F.col(ref).alias("ref"))
    a = pick(t.orders.where("o_orderstatus = 'F'"), "o_orderdate", F.lit("ordered"), "o_orderkey")
    b = pick(t.lineitem.where("l_linenumber = 1"), "l_shipdate", F.lit("shipped"), "l_orderkey")
    c = pick(t.events.where("event_type in ('purchase', 'error')"), "ts", F.col("event_type"), "event_id")
    return a.unionByName(b).unionByName(c)


@query("SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def set_concat_frames(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


both("set_difference", "SELECT o_custkey FROM (SELECT c_custkey AS o_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders}) AS x")


@query("SELECT sha256(doc_id::VARCHAR || '|' || source) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_hash_difference(t: Tables) -> DataFrame:
    h = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source"), 256).alias("h")
    done = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(h)
    return t.documents.select(h).join(done, "h", "left_anti")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def set_dedupe_key(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("r", r).where("r = 1").select("user_id", "event_type", "event_id")


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY md5(user_id::VARCHAR || '|' || lower(trim(event_type))) ORDER BY event_id) = 1 THEN 'clean' ELSE 'duplicate' END AS part FROM events")
def set_dup_split(t: Tables) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.lower(F.trim("event_type"))))
    r = F.row_number().over(Window.partitionBy(key).orderBy("event_id"))
    return t.events.select("event_id", F.when(r == 1, "clean").otherwise("duplicate").alias("part"))
