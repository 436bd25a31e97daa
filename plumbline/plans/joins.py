"""Join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.similarity import ratio
from plumbline.operators import joins as J
from plumbline.operators.fuzzy import best_match, near_names

from .base import Tables, both, query

YEARLY = "(SELECT o_custkey, EXTRACT(YEAR FROM o_orderdate)::BIGINT AS year, SUM(o_totalprice) AS revenue FROM orders GROUP BY 1, 2)"


def yearly(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("revenue"))


both("jn_inner_equi", """SELECT a.year, a.c_nationkey, ROUND(a.spend, 2) AS spend, ROUND(b.total, 2) AS total FROM
(SELECT CAST(year(o_orderdate) AS INT) AS year, c_nationkey, SUM(o_totalprice) AS spend FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY CAST(year(o_orderdate) AS INT), c_nationkey) a
JOIN (SELECT CAST(year(o_orderdate) AS INT) AS year, SUM(o_totalprice) AS total FROM {orders} GROUP BY CAST(year(o_orderdate) AS INT)) b ON a.year = b.year""")
both("jn_left_multi", """SELECT c_custkey, COALESCE(n_name, '?') AS nation, COALESCE(r_name, '?') AS region, COALESCE(o.n, 0) AS orders_n FROM {customer}
LEFT JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey""")
both("jn_left_filter", "SELECT d.doc_id, COALESCE(l.quality, -1) AS quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE COALESCE(l.quality, -1) <> 1")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def jn_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jn_semi_in(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


both("jn_not_exists", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality IN (SELECT MAX(quality) FROM {labels}))")


@query(f"SELECT a.o_custkey, a.year, ROUND(a.revenue, 2) AS revenue, ROUND(b.revenue, 2) AS lag1, ROUND(c.revenue, 2) AS lag2 FROM {YEARLY} a LEFT JOIN {YEARLY} b ON a.o_custkey = b.o_custkey AND b.year = a.year - 1 LEFT JOIN {YEARLY} c ON a.o_custkey = c.o_custkey AND c.year = a.year - 2")
def jn_self_lag(t: Tables) -> DataFrame:
    base = yearly(t)
    one = J.lag_by_key(base, ["o_custkey"], "year", "revenue", 1)
    two = base.select("o_custkey", (F.col("year") + 2).alias("year"), F.col("revenue").alias("revenue_lag2"))
    out = one.join(two, ["o_custkey", "year"], "left")
    return out.select("o_custkey", "year", F.round("revenue", 2).alias("revenue"), F.round("revenue_lag1", 2).alias("lag1"), F.round("revenue_lag2", 2).alias("lag2"))


both("jn_expr_key", "SELECT a.c_custkey, b.s_suppkey FROM {customer} a JOIN {supplier} b ON LOWER(TRIM(SUBSTRING(a.c_name, -3))) = LOWER(TRIM(SUBSTRING(b.s_name, -3))) AND a.c_nationkey = b.s_nationkey")


@query("SELECT c_custkey, short_name, n FROM customer JOIN (SELECT s_nationkey, 'C.' || substring(s_name, -1) AS short_name, COUNT(*) AS n FROM supplier GROUP BY 1, 2) ON c_nationkey = s_nationkey AND c_name LIKE substring(short_name, 1, 1) || '%' AND c_name LIKE '%' || substring(short_name, 3)")
def jn_theta_name(t: Tables) -> DataFrame:
    short = t.supplier.groupBy(F.col("s_nationkey").alias("nation"), F.concat(F.lit("C."), F.substring("s_name", -1, 1)).alias("short_name")).agg(F.count("*").alias("n"))
    return J.short_name_match(t.customer.withColumnRenamed("c_nationkey", "nation"), short, ["nation"], "c_name", "short_name").select("c_custkey", "short_name", "n")


FACTS = "(SELECT o_custkey AS k, o_totalprice AS v, o_orderdate::DATE AS valid_from, o_orderdate::DATE + INTERVAL 200 DAY AS valid_until FROM orders)"


def facts(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), day.alias("valid_from"), F.date_add(day, 200).alias("valid_until"))


@query(f"SELECT c_custkey AS k, v, valid_from FROM customer LEFT JOIN {FACTS} f ON c_custkey = f.k AND valid_from <= DATE '1998-09-01' AND valid_until > DATE '1998-09-01'")
def jn_asof_pit(t: Tables) -> DataFrame:
    return J.point_in_time(t.customer.select(F.col("c_custkey").alias("k")), facts(t), ["k"], F.lit("1998-09-01").cast("date")).select("k", "v", "valid_from")


@query(f"SELECT c_custkey AS k, v, valid_from FROM customer LEFT JOIN {FACTS} f ON c_custkey = f.k AND valid_from <= DATE '1998-09-01' AND valid_until > DATE '1998-09-01'")
def jn_asof_pit_all(t: Tables) -> DataFrame:
    return J.point_in_time(t.customer.select(F.col("c_custkey").alias("k")), facts(t), ["k"], F.lit("1998-09-01").cast("date")).select("k", "v", "valid_from")


@query(f"SELECT c_custkey AS k, y.year, v FROM customer CROSS JOIN (VALUES (1996), (1999)) y(year) LEFT JOIN {FACTS} f ON c_custkey = f.k AND valid_from <= make_date(y.year, 9, 1) AND valid_until > make_date(y.year, 9, 1)")
def jn_asof_diagonal(t: Tables) -> DataFrame:
    spine = t.customer.select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(1996), F.lit(1999))).alias("year")).withColumn("at", F.make_date("year", F.lit(9), F.lit(1)))
    return J.point_in_time(spine, facts(t), ["k"], "at").select("k", "year", "v")


@query(f"SELECT c_custkey AS k, y.year, v FROM customer CROSS JOIN (VALUES (1996), (1999)) y(year) LEFT JOIN {FACTS} f ON c_custkey = f.k AND valid_from <= make_date(y.year, 9, 1) AND valid_until > make_date(y.year, 9, 1)")
def jn_asof_diagonal_all(t: Tables) -> DataFrame:
    spine = t.customer.select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(1996), F.lit(1999))).alias("year")).withColumn("at", F.make_date("year", F.lit(9), F.lit(1)))
    return J.point_in_time(spine, facts(t), ["k"], "at").select("k", "year", "v")


@query("""SELECT user_id, anchor_event_id, event_event_id, rank FROM (SELECT a.user_id, a.event_id AS anchor_event_id, e.event_id AS event_event_id, row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY e.ts, e.event_id)::INT AS rank
FROM events a JOIN events e ON a.user_id = e.user_id AND e.ts > a.ts AND e.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'error') WHERE rank <= 10""")
def jn_interval_after(t: Tables) -> DataFrame:
    ev = t.events.select("user_id", "event_id", "ts")
    errors = t.events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    return J.events_after(errors, ev, "user_id", "ts", "ts", "event_id", 86_400, 10).select("user_id", "anchor_event_id", "event_event_id", "rank")


@query("SELECT o_orderkey, ROUND((o_totalprice - mu) / sigma, 4) AS z FROM orders CROSS JOIN (SELECT AVG(o_totalprice) AS mu, STDDEV_SAMP(o_totalprice) AS sigma FROM orders) WHERE abs(o_totalprice - mu) > 1.5 * sigma AND sigma > 0")
def jn_cross_scalar(t: Tables) -> DataFrame:
    one = t.orders.agg(F.avg("o_totalprice").alias("mu"), F.stddev_samp("o_totalprice").alias("sigma"))  # a single row
    return t.orders.crossJoin(F.broadcast(one)).where("abs(o_totalprice - mu) > 1.5 * sigma and sigma > 0").select("o_orderkey", F.round((F.col("o_totalprice") - F.col("mu")) / F.col("sigma"), 4).alias("z"))


@query("SELECT COALESCE(a.k, b.k) AS k, COALESCE(bought, 0.0) AS bought, COALESCE(sold, 0.0) AS sold FROM (SELECT c_nationkey AS k, ROUND(SUM(c_acctbal), 2) AS bought FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, ROUND(SUM(s_acctbal), 2) AS sold FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def jn_full_outer(t: Tables) -> DataFrame:
    a = t.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("bought"))
    b = t.supplier.where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal"), 2).alias("sold"))
    return J.full_outer_keep_first(a, b, ["k"], ["bought", "sold"])


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_left_indicator(t: Tables) -> DataFrame:
    marked = t.labels.select("doc_id").withColumn("hit", F.lit(True))
    return t.documents.select("doc_id").join(marked, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("matched"))


@query()
def jn_fuzzy_best(t: Tables) -> DataFrame:
    left = t.supplier.select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name")
    right = t.customer.select(F.col("c_nationkey").alias("nation"), "c_name")
    return best_match(left, right, ["nation"], "s_name", "c_name", ratio, 0.6).select("s_suppkey", "c_name", F.round("score", 4).alias("score"))


@query()
def jn_fuzzy_names(t: Tables) -> DataFrame:
    """The best-scoring other part of the same brand for each part, by lower-case name, from a ratio of 0.75 on."""
    names = t.part.select("p_partkey", "p_brand", F.lower("p_name").alias("name"))
    near = near_names(names, names, ["p_brand"], "name", "name", ratio, 0.75).where("a <> b")
    best = near.groupBy("p_brand", F.col("a").alias("name")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b"))).alias("x"))
    return names.join(best, ["p_brand", "name"]).select("p_partkey", F.col("x.b").alias("match"), F.round(-F.col("x.s"), 4).alias("score"))


def prefix5(t: Tables, few: int = 50_000) -> DataFrame:
    """The first customer of the key's nation whose 12-sign prefix the key contains: an equi-join on every part of the key that is as long as a prefix.

    Spark's estimates do not see how many parts a key has and would broadcast them: up to `few` prefixes are broadcast instead, more are sorted and merged.
    """
    named = t.customer.where(F.col("c_name").isNotNull() & F.col("c_nationkey").isNotNull())
    keys = named.select(F.concat_ws("_", F.lit("p"), "c_name", "c_nationkey", F.lit("1999")).alias("key"))
    prefixes = named.groupBy(F.col("c_nationkey").alias("nation"), F.substring("c_name", 1, 12).alias("prefix")).agg(F.min("c_custkey").alias("c_custkey"))
    lengths = dict(map(tuple, prefixes.groupBy(F.length("prefix")).count().collect()))  # 13 at most
    sizes = F.array(*map(F.lit, sorted(lengths) or [12]))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - n + 1, F.lit(1))), lambda i: F.substring("key", i, n))
    parsed = keys.withColumn("nation", F.regexp_extract("key", r"_(-?\d+)_\d{4}$", 1).cast("int")).withColumn("prefix", F.explode(F.array_distinct(F.flatten(F.transform(sizes, parts)))))
    right = F.broadcast(prefixes) if sum(lengths.values()) <= few else prefixes.hint("merge")
    return parsed.join(right, ["nation", "prefix"]).groupBy("key").agg(F.min("c_custkey").alias("c_custkey"))


PREFIX5 = "SELECT key, MIN(c.c_custkey) AS c_custkey FROM (SELECT 'p_' || c_name || '_' || c_nationkey || '_1999' AS key, c_nationkey AS nation FROM customer) k JOIN customer c ON c.c_nationkey = k.nation AND contains(k.key, substring(c.c_name, 1, 12)) GROUP BY key"


@query(PREFIX5)
def jn_prefix5(t: Tables) -> DataFrame:
    return prefix5(t)


@query(PREFIX5)
def jn_prefix5_all(t: Tables) -> DataFrame:
    return prefix5(t)


@query("SELECT doc_id, MIN(n_nationkey)::INT AS nation FROM documents JOIN nation ON contains(lower(text), lower(substring(n_name, 1, 3))) GROUP BY 1")
def jn_name_contains(t: Tables) -> DataFrame:
    names = t.nation.select("n_nationkey", F.lower(F.substring("n_name", 1, 3)).alias("part"))  # 25 rows by definition of the table
    return t.documents.select("doc_id", F.lower("text").alias("low")).join(F.broadcast(names), F.contains("low", "part")).groupBy("doc_id").agg(F.min("n_nationkey").alias("nation"))


@query("SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, COUNT(*) AS games FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2")
def jn_matchup_sym(t: Tables) -> DataFrame:
    games = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return games.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").alias("games"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN COALESCE((props->>'k')::INT, -1) ELSE -1 END AS k FROM events")
def jn_json_lookup(t: Tables) -> DataFrame:
    """The note of each event, -1 without one: errors and purchases carry notes."""
    notes = t.events.where("event_type in ('error', 'purchase')").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return t.events.select("event_id").join(notes, "event_id", "left").select("event_id", F.coalesce("k", F.lit(-1)).alias("k"))


@query("SELECT b.s_suppkey AS buyer, a.s_suppkey AS seller FROM supplier b JOIN supplier a ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE b.s_acctbal < 0 AND a.s_acctbal > 1000")
def jn_trade_candidates(t: Tables) -> DataFrame:
    needs = t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("need"), F.col("s_suppkey").alias("buyer"))
    have = t.supplier.where("s_acctbal > 1000").select(F.col("s_nationkey").alias("need"), F.col("s_suppkey").alias("seller"))
    return needs.join(have, "need").where("buyer <> seller").select("buyer", "seller")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn_broadcast_small(t: Tables) -> DataFrame:
    dims = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimensions of 25 and 5 rows
    return t.supplier.join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey, COALESCE(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS history, COUNT(o_orderkey)::INT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def jn_nested_mem(t: Tables) -> DataFrame:
    kids = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    out = J.nested(t.customer.select("c_custkey"), kids, "c_custkey", ["o_orderkey", "o_totalprice"], "history", ["o_orderkey"])
    return out.select("c_custkey", F.array_join(F.transform("history", lambda x: x.o_orderkey.cast("string")), ",").alias("history"), F.size("history").alias("n"))
