"""Sources and sinks as round trips through files of the engine's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch
from plumbline.sources import files, html, sinks, text

from .base import Tables, query

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))


@query("SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def src_csv_glob(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    t.customer.write.option("header", True).csv(f"{root}/a")
    return files.csv_glob(t.spark, f"{root}/*/*.csv", CUSTOMER).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def src_csv_recursive(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    rows = t.customer.select("c_nationkey", "c_mktsegment")
    rows.write.option("header", True).csv(f"{root}/x/one")
    rows.write.option("header", True).csv(f"{root}/y/z/two")
    return files.csv_recursive(t.spark, root, "part-*.csv", "c_nationkey int, c_mktsegment string")


@query("SELECT year, COUNT(*) AS n, MAX(version) AS version FROM (SELECT EXTRACT(YEAR FROM o_orderdate)::INT AS year, 2 AS version FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def src_latest_file(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    rows = _orders(t)
    for version, part in ((1, rows), (2, rows.where("o_orderkey % 2 = 0"))):
        part.select("o_orderkey", "year", F.lit(version).alias("version")).repartition(1, "year").write.mode("append").partitionBy("year").parquet(f"{root}/t")
    got = t.spark.read.schema("o_orderkey long, version int, year int").parquet(f"{root}/t")
    return files.latest_files(got, F.regexp_extract(F.col("_metadata.file_path"), r"year=(\d+)", 1)).groupBy("year").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query("SELECT COUNT(*) AS n FROM region")
def src_first_existing_path(t: Tables) -> DataFrame:
    path = files.first_existing(t.spark, [f"{t.sf_dir}/no_such_{i}.parquet" for i in range(2)] + [f"{t.sf_dir}/region.parquet"])
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("SELECT EXTRACT(YEAR FROM o_orderdate)::INT AS year, COUNT(*) AS n FROM orders GROUP BY 1")
def src_year_from_filename(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    named = _orders(t).select("o_orderkey", F.concat(F.lit("cap_"), "year").alias("file"))
    named.write.partitionBy("file").option("header", True).csv(root)  # a folder named by the year for each year
    got = files.csv_glob(t.spark, f"{root}/file=*", "o_orderkey long")
    folder = F.regexp_replace(F.input_file_name(), r"/[^/]*$", "")
    return got.withColumn("year", files.year_of_path(folder)).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1")
def src_parquet(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_nationkey * 2 AS doubled FROM nation")
def src_json_records(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.nation.select("n_nationkey", "n_name").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).coalesce(1).write.text(path)
    return files.json_records(t.spark, path, "n_nationkey int, n_name string").withColumn("doubled", F.col("n_nationkey") * 2)


YAML = """
- region: AFRICA   # the lookup
  tier: 'low'
- region: ASIA
  tier: high
"""


@query("SELECT n_name, COALESCE(tier, 'mid') AS tier FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES ('AFRICA', 'low'), ('ASIA', 'high')) y(region, tier) ON r_name = region")
def src_yaml_config(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame(files.yaml_rows(YAML), "region string, tier string")
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(dim), F.col("r_name") == F.col("region"), "left")
    return named.select("n_name", F.coalesce("tier", F.lit("mid")).alias("tier"))


@query("SELECT s_suppkey, s_nationkey, ROUND(s_acctbal, 2) AS balance FROM supplier")
def src_seed(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").write.option("header", True).csv(root)
    return files.csv_glob(t.spark, root, "s_suppkey long, s_nationkey int, s_acctbal double").select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("balance"))


def _page(c: str, hidden: bool) -> F.Column:
    table = F.concat(F.lit("<table><tr><th>Name</th><th>Name</th></tr><tr><td>"), F.col(c), F.lit("</td><td><b>x</b> &amp; "), F.col(c), F.lit("</td></tr><tr><td>short</td></tr></table>"))
    return F.concat(F.lit("<html><!--"), table, F.lit("--></html>")) if hidden else table


@query("SELECT n_nationkey::BIGINT AS page_id, n_name AS name, 'x & ' || n_name AS name_1 FROM nation")
def src_html_table(t: Tables) -> DataFrame:
    pages = t.nation.select(F.col("n_nationkey").cast("long").alias("page_id"), _page("n_name", False).alias("html"))
    rows = html.html_tables(pages)
    cell = lambda name: F.element_at(F.map_from_arrays("header", "cells"), name)
    return rows.select("page_id", cell("name").alias("name"), cell("name_1").alias("name_1"))


@query("SELECT n_nationkey::BIGINT AS page_id, n_name AS name FROM nation")
def src_html_commented_tables(t: Tables) -> DataFrame:
    pages = t.nation.select(F.col("n_nationkey").cast("long").alias("page_id"), _page("n_name", True).alias("html"))
    return html.html_tables(pages, commented=True).select("page_id", F.col("cells")[0].alias("name"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1))::INT AS n_links FROM pages""")
def src_page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.title(F.col("html")).alias("title"), F.size(html.links(F.col("html"))).alias("n_links"))


@query("SELECT c_custkey AS doc_id, c_name AS name, c_mktsegment AS team, 'POS' AS pos, ROUND(c_acctbal, 2) AS value FROM customer WHERE c_acctbal > 0")
def src_text_rankings(t: Tables) -> DataFrame:
    body = F.concat_ws("\n", F.lit("# ranking"), F.col("c_name"), F.concat(F.col("c_mktsegment"), F.lit(", POS")), F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    docs = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"), body.alias("text"))
    return text.rankings(docs)


@query("SELECT doc_id, source AS author, CASE WHEN length(text) // 2 > 100 THEN 'summary' ELSE 'content' END AS picked FROM documents WHERE contains(lower(text), 'the')")
def src_rss(t: Tables) -> DataFrame:
    entry = t.documents.select("doc_id", F.col("source").alias("author"), F.expr("substring(text, 1, cast(length(text) div 2 as int))").alias("summary"), F.expr("substring('content', 1, 7)").alias("content"), F.lower("text").alias("low"))
    entry = entry.withColumn("content", F.rpad("content", 100, "."))
    body = files.longest_body(F.col("summary"), F.col("content"))
    return entry.where(F.contains("low", F.lit("the"))).select("doc_id", "author", F.when(body == F.col("content"), "content").otherwise("summary").alias("picked"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, DATE '2024-01-01' AS _ingested_at FROM customer")
def src_rest_json(t: Tables) -> DataFrame:
    """Customers as a service pages them, a hundred a response, and the records out of those responses."""
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    pages = t.customer.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list(record).alias("data"))).alias("body"))
    return files.rest_records(pages, "body", "data", "id: bigint, name: string, balance: double", F.to_date(F.lit("2024-01-01")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def src_table_select(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_totalprice")


@query("SELECT column_name, present FROM (VALUES ('c_acctbal', TRUE), ('c_name', TRUE), ('c_phone', FALSE)) v(column_name, present)")
def src_information_schema(t: Tables) -> DataFrame:
    have = set(t.customer.columns)
    return t.spark.createDataFrame([(c, c in have) for c in ("c_acctbal", "c_name", "c_phone")], "column_name string, present boolean")


# sinks: the table that results -------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def snk_append(t: Tables) -> DataFrame:
    path, rows = scratch(t.spark), t.nation.select("n_nationkey", "n_name")
    sinks.append(rows, path)
    sinks.append(rows.withColumn("n_nationkey", F.col("n_nationkey") + 100), path)
    return t.spark.read.parquet(path)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey < 5")
def snk_truncate(t: Tables) -> DataFrame:
    path, rows = scratch(t.spark), t.nation.select("n_nationkey")
    sinks.truncate(rows, path)
    sinks.truncate(rows.where("n_nationkey < 5"), path)
    return t.spark.read.parquet(path)


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def snk_ctas(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("SELECT EXTRACT(YEAR FROM o_orderdate)::INT AS year, COUNT(*) AS n, MIN(CASE WHEN EXTRACT(YEAR FROM o_orderdate) = 1997 THEN 'new' ELSE 'old' END) AS kind FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) <> 1997 OR o_orderkey % 3 = 0 GROUP BY 1")
def snk_partition_replace(t: Tables) -> DataFrame:
    path, rows = scratch(t.spark), _orders(t).select("o_orderkey", "year")
    sinks.replace_partitions(rows.withColumn("kind", F.lit("old")), path, "year")
    for _ in range(2):  # twice: idempotent
        sinks.replace_partitions(rows.where("year = 1997 and o_orderkey % 3 = 0").withColumn("kind", F.lit("new")), path, "year")
    return t.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))


@query("SELECT c_custkey, c_name, NULL::DOUBLE AS extra FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snk_insert_select(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    sinks.append(t.customer.where("c_acctbal < 0").select("c_custkey", "c_name", F.lit(None).cast("double").alias("extra")), path)
    sinks.append(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("extra")), path)
    return t.spark.read.parquet(path)


@query("""SELECT COALESCE(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, COALESCE(a.created, b.created) AS created
FROM (SELECT c_custkey AS k, c_acctbal AS v, 'first' AS created FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -c_acctbal END AS v, 'second' AS created FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def snk_merge_upsert(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    target = base.where("k % 3 <> 0").withColumn("created", F.lit("first"))
    source = base.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 != 0, -F.col("v")).alias("v"), F.lit("second").alias("created"))
    return sinks.merge_upsert(target, source, ["k"], keep=["created"])


@query("""SELECT k, v, start_date AS effective_start_date, CASE WHEN k % 2 = 0 THEN DATE '2024-06-01' END AS effective_end_date, k % 2 <> 0 AS is_current FROM (SELECT c_custkey AS k, c_acctbal AS v, DATE '2024-01-01' AS start_date FROM customer WHERE c_custkey % 3 = 0)
UNION ALL SELECT c_custkey, c_acctbal + 1, DATE '2024-06-01', NULL, TRUE FROM customer WHERE c_custkey % 2 = 0""")
def snk_scd2(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    current = base.where("k % 3 = 0").select("k", "v", F.to_date(F.lit("2024-01-01")).alias("effective_start_date"), F.lit(None).cast("date").alias("effective_end_date"), F.lit(True).alias("is_current"))
    batch = base.where("k % 2 = 0").select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), "v").select("k", "seq", (F.col("v") + F.col("seq")).alias("v"))
    return sinks.scd2(current, batch, "k", F.to_date(F.lit("2024-06-01")), F.col("seq"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'SWITCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def snk_update_from(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_mktsegment")
    return sinks.update_from(target, target.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("SWITCHED")), ["c_custkey"], ["c_mktsegment"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def snk_update_where(t: Tables) -> DataFrame:
    return sinks.update_where(t.customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0))


@query("SELECT doc_id FROM documents d WHERE NOT (text LIKE '%token%') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def snk_delete_where(t: Tables) -> DataFrame:
    rest = sinks.delete_where(t.documents, F.col("text").like("%token%")).select("doc_id")
    return sinks.delete_in(rest, t.labels.where("quality = 0").select("doc_id"), ["doc_id"])


@query("SELECT event_id, COALESCE(CASE WHEN event_id % 2 = 0 THEN event_type END, 'NFL') AS sport FROM events")
def snk_alter_add_column(t: Tables) -> DataFrame:
    half = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("sport"))
    return sinks.add_column(half, "sport", "string", F.lit("NFL"))


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def snk_csv(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    _orders(t).write.option("header", True).csv(path)
    return files.csv_glob(t.spark, path, ORDERS).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT EXTRACT(YEAR FROM o_orderdate)::INT AS year, COUNT(*) AS n FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1999 GROUP BY 1")
def snk_parquet_by_year(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    sinks.replace_partitions(_orders(t), path, "year")
    return t.spark.read.parquet(path).where("year = 1999").groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS v FROM customer")
def snk_json(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    odd = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    sinks.json_safe(t.customer.select("c_custkey", odd.alias("v"))).write.json(path)
    return t.spark.read.schema("c_custkey long, v double").json(path)


@query("SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def snk_view(t: Tables) -> DataFrame:
    t.orders.where("o_orderstatus = 'O'").createOrReplaceTempView("plumbline_open_orders")
    return t.spark.table("plumbline_open_orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_id % 2 = 1")
def snk_idempotent_insert(t: Tables) -> DataFrame:
    ids = t.events.select("event_id")
    return sinks.insert_missing(ids.where("event_id % 2 = 0"), ids.union(ids), ["event_id"])


@query("""SELECT c_custkey, '{"c_mktsegment":"' || c_mktsegment || '"}' AS old_value, '{"c_mktsegment":"NEW"}' AS new_value FROM customer WHERE c_custkey % 11 = 0 AND c_mktsegment <> 'NEW'""")
def snk_audit_append(t: Tables) -> DataFrame:
    before = t.customer.select("c_custkey", "c_mktsegment")
    return sinks.audit_rows(before, sinks.update_where(before, F.col("c_custkey") % 11 == 0, c_mktsegment=F.lit("NEW")), "c_custkey", ["c_mktsegment"])
