"""Cost marts and the efficiency fact. Orders stand for contracts, line items by month for game logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import valuation as V
from plumbline.operators.ranks import counted, from_counts, running_totals
from plumbline.operators.windows import running
from plumbline.session import scratch

from .base import Tables, both, query

Y = "CAST(year(o_orderdate) AS INT)"


@query(f"""WITH base AS (SELECT o_custkey AS player, n_name AS team, {Y} AS year, o_totalprice AS v, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 0),
p AS (SELECT player, team, year, SUM(v) AS spend FROM base GROUP BY 1, 2, 3), team AS (SELECT team, year, SUM(v) AS total, COUNT(DISTINCT player) AS players FROM base GROUP BY 1, 2),
y AS (SELECT year, AVG(v) AS mean, STDDEV_POP(v) AS spread, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90 FROM base GROUP BY 1)
SELECT p.player, p.team, p.year, ROUND(p.spend, 2) AS spend, ROUND(p.spend / total * 100, 4) AS team_pct, players, ROUND(mean, 2) AS year_mean, ROUND(spread, 2) AS year_spread, ROUND(p75, 2) AS p75, ROUND(p90, 2) AS p90,
ROUND(percent_rank() OVER (PARTITION BY p.year ORDER BY ROUND(p.spend, 2)), 6) AS pct, row_number() OVER (PARTITION BY p.year ORDER BY ROUND(p.spend, 2) DESC, p.player)::INT AS rank FROM p JOIN team ON p.team = team.team AND p.year = team.year JOIN y ON p.year = y.year""")
def fct_cost_by_player(t: Tables) -> DataFrame:
    """Flagship: spend per player, team and year with its share, the year's distribution, percentile and rank."""
    base = t.orders.where("o_totalprice > 0").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.select(F.col("o_custkey").alias("player"), F.col("n_name").alias("team"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    path = scratch(t.spark)
    base.groupBy("player", "team", "year").agg(F.sum("v").alias("spend")).write.parquet(path)  # what all but the year's distribution is made of
    p = t.spark.read.schema("player long, team string, year int, spend double").parquet(path)
    team = p.groupBy("team", "year").agg(F.sum("spend").alias("total"), F.count("*").alias("players"))  # a player has one team: his rows are already one per year
    values = counted(base, ["year"], "v")
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    y = values.groupBy("year").agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n") - mean * mean)).alias("spread"))
    y = y.join(from_counts(values, ["year"], "v", {"p75": 0.75, "p90": 0.9}), "year")
    r = lambda c, n: F.round(c, n)
    placed = running_totals(p.withColumn("spend", r("spend", 2)), ["year"], [F.desc("spend"), "player"], {"row": F.lit(1)})
    ties = placed.groupBy("year", "spend").agg((F.max("row_total") - 1 - F.max("row_before")).alias("smaller"))  # of equal amounts the last place tells how many are smaller
    pct = F.when(F.col("row_total") > 1, F.col("smaller") / (F.col("row_total") - 1)).otherwise(0.0)
    j = placed.join(ties, ["year", "spend"]).join(team, ["team", "year"]).join(F.broadcast(y), "year")  # one row per year
    return j.select(
        "player", "team", "year", "spend", r(F.col("spend") / F.col("total") * 100, 4).alias("team_pct"), "players", r("mean", 2).alias("year_mean"), r("spread", 2).alias("year_spread"), r("p75", 2).alias("p75"), r("p90", 2).alias("p90"),
        r(pct, 6).alias("pct"), (F.col("row_before") + 1).cast("int").alias("rank"),
    )


both("fct_cost_by_year", f"SELECT year, ROUND(SUM(v), 2) AS total, ROUND(AVG(v), 2) AS mean, COUNT(*) AS n, CAST(row_number() OVER (ORDER BY ROUND(SUM(v), 2) DESC, year) AS INT) AS r FROM (SELECT {Y} AS year, o_totalprice AS v FROM {{orders}}) AS x GROUP BY year")
both("fct_cost_trend", f"SELECT year, players, ROUND(total, 2) AS total, ROUND((total / LAG(total) OVER (ORDER BY year) - 1) * 100, 4) AS yoy FROM (SELECT {Y} AS year, COUNT(DISTINCT o_custkey) AS players, SUM(o_totalprice) AS total FROM {{orders}} GROUP BY {Y}) AS x")
both("dim_teams", "SELECT DISTINCT n_nationkey, n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
both("int_team_share", "SELECT c_custkey, n_name, ROUND(c_acctbal / NULLIF(total, 0) * 100, 6) AS pct, CASE WHEN c_acctbal / NULLIF(total, 0) > 0.03 THEN 'major' WHEN c_acctbal / NULLIF(total, 0) > 0.01 THEN 'moderate' ELSE 'minor' END AS impact FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN (SELECT c_nationkey AS k, SUM(c_acctbal) AS total FROM {customer} GROUP BY c_nationkey) AS s ON k = c_nationkey")

MONTHLY = "(SELECT l_suppkey AS player, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS week, ROUND(SUM(l_quantity), 2) AS perf, SUM(l_extendedprice) / 100000 AS cap FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""SELECT player, year, week, ROUND(ytd, 2) AS ytd, ROUND(GREATEST(hurdle - ytd, 0), 8) AS edce_risk, ROUND(hurdle - ytd, 8) AS true_bust_variance, ROUND(LEAST(ytd / hurdle, 10), 6) AS efficiency_ratio, CASE WHEN LEAST(ytd / hurdle, 10) < 0.70 THEN 1 ELSE 0 END AS is_bust_binary
FROM (SELECT *, GREATEST(cap * 20 * 0.6, dead, 0.5) AS hurdle FROM (SELECT m.*, SUM(perf) OVER (PARTITION BY m.player, year ORDER BY week) AS ytd, CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 END AS dead FROM {MONTHLY} m LEFT JOIN supplier ON player = s_suppkey))""")
def gold_fact(t: Tables) -> DataFrame:
    """Month by month: running performance against a hurdle from cost and dead money, and the targets that follow. One row per player, year and month."""
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("player"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("week")).agg(F.round(F.sum("l_quantity"), 2).alias("perf"), (F.sum("l_extendedprice") / 100000).alias("cap"))
    dead = t.supplier.select(F.col("s_suppkey").alias("player"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).alias("dead"))
    j = m.join(dead, "player", "left").withColumn("ytd", running("perf", ["player", "year"], "week"))
    x = V.targets(F.col("cap") * 20, F.col("dead"), F.col("ytd"))
    return j.select("player", "year", "week", F.round("ytd", 2).alias("ytd"), *(F.round(c, 6 if n == "efficiency_ratio" else 8).alias(n) if n != "is_bust_binary" else c.alias(n) for n, c in x.items()))


both("val_apy_eff", "SELECT p_partkey, ROUND(p_retailprice / NULLIF(p_size % 5, 0), 4) AS apy, ROUND(p_size / NULLIF(p_retailprice, 0), 6) AS efficiency FROM {part}")


@query("SELECT p_partkey, ROUND(1 / (1 + exp(-0.5 * (p_size - CASE WHEN p_type LIKE 'PROMO%' THEN 30 ELSE 32 END))) * p_retailprice, 4) AS v FROM part")
def val_edce(t: Tables) -> DataFrame:
    limit = F.when(F.startswith("p_type", F.lit("PROMO")), 30).otherwise(32)
    return t.part.select("p_partkey", F.round(V.age_risk_exposure(F.col("p_size"), limit, F.col("p_retailprice")), 4).alias("v"))


@query("SELECT p_partkey, ROUND(p_retailprice - p_size * r, 4) AS v FROM part, (SELECT SUM(p_retailprice) / SUM(p_size) AS r FROM part)")
def val_ied(t: Tables) -> DataFrame:
    rate = t.part.agg((F.sum("p_retailprice") / F.sum("p_size")).alias("r"))  # one row
    return t.part.crossJoin(F.broadcast(rate)).select("p_partkey", F.round(V.overpayment(F.col("p_retailprice"), F.col("p_size"), F.col("r")), 4).alias("v"))


@query("SELECT l_suppkey, ROUND(SUM(l_quantity) * 0.04 + SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) * 6 + SUM(l_linenumber) * -2, 4) AS points FROM lineitem GROUP BY 1")
def val_fantasy_points(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("y"), F.count_if(F.col("l_linestatus") == "F").alias("td"), F.sum("l_linenumber").alias("i"))
    return s.select("l_suppkey", F.round(V.fantasy_points(passing_yards=F.col("y"), rushing_tds=F.col("td"), interceptions=F.col("i")), 4).alias("points"))


@query(f"SELECT md5(lower(c_name)) AS player_id, COALESCE(f.year, p.year) AS year, ROUND(f.v, 2) AS cap, p.n AS perf FROM (SELECT o_custkey AS k, {Y} AS year, SUM(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) f FULL JOIN (SELECT o_custkey AS k, {Y} AS year, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) p ON f.k = p.k AND f.year = p.year JOIN customer ON c_custkey = COALESCE(f.k, p.k)")
def val_timeline(t: Tables) -> DataFrame:
    part = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year"))
    both_ = part("F").agg(F.round(F.sum("o_totalprice"), 2).alias("cap")).join(part("O").agg(F.count("*").alias("perf")), ["k", "year"], "full_outer")
    return both_.join(t.customer, F.col("k") == F.col("c_custkey")).select(F.md5(F.lower("c_name").cast("binary")).alias("player_id"), "year", "cap", "perf")


@query("SELECT p_partkey, ROUND(p_size / GREATEST(p_retailprice / 2000 * 100, 0.1), 6) AS efficiency, p_size > 40 AS is_future FROM part")
def val_master_table(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.col("p_size") / F.greatest(F.col("p_retailprice") / 2000 * 100, F.lit(0.1)), 6).alias("efficiency"), (F.col("p_size") > 40).alias("is_future"))


@query("SELECT p_partkey, CASE WHEN e > 0.03 THEN 'steal' WHEN e < 0.005 THEN 'overpay' ELSE 'fair' END AS kind FROM (SELECT p_partkey, p_size / p_retailprice AS e FROM part JOIN (SELECT l_partkey FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) ORDER BY e DESC, p_partkey LIMIT 100")
def val_fair_value(t: Tables) -> DataFrame:
    sold = t.part.join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").withColumn("e", F.col("p_size") / F.col("p_retailprice"))
    return sold.orderBy(F.desc("e"), "p_partkey").limit(100).select("p_partkey", F.when(F.col("e") > 0.03, "steal").when(F.col("e") < 0.005, "overpay").otherwise("fair").alias("kind"))


@query(f"SELECT o_custkey, ROUND(now_g + later_g, 4) AS dead_pre, ROUND(now_c - (now_g + later_g), 4) AS savings_pre, ROUND(now_g, 4) AS dead_post, ROUND(now_c - now_g, 4) AS savings_post, ROUND(later_g, 4) AS dead_next_year FROM (SELECT o_custkey, SUM(CASE WHEN {Y} = 1998 THEN o_totalprice ELSE 0 END) AS now_c, SUM(CASE WHEN {Y} = 1998 THEN o_totalprice * 0.25 ELSE 0 END) AS now_g, SUM(CASE WHEN {Y} > 1998 THEN o_totalprice * 0.25 ELSE 0 END) AS later_g FROM orders GROUP BY 1)")
def val_dead_money_split(t: Tables) -> DataFrame:
    y, v = F.year("o_orderdate"), F.col("o_totalprice")
    s = t.orders.groupBy("o_custkey").agg(F.sum(F.when(y == 1998, v).otherwise(0.0)).alias("c"), F.sum(F.when(y == 1998, v * 0.25).otherwise(0.0)).alias("g"), F.sum(F.when(y > 1998, v * 0.25).otherwise(0.0)).alias("l"))
    return s.select("o_custkey", *(F.round(c, 4).alias(n) for n, c in V.cut_split(F.col("c"), F.col("g"), F.col("l")).items()))


both("val_cut_calc", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice * (1 - l_discount) - l_extendedprice * l_tax, 6) AS savings FROM {lineitem}")
both("val_risk_exposure", "SELECT c_nationkey, ROUND(SUM(spend * risk), 2) AS exposure, ROUND(SUM(spend), 2) AS total FROM (SELECT o_custkey, SUM(o_totalprice) AS spend FROM {orders} GROUP BY o_custkey) AS a JOIN (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.9E0 ELSE 0.1E0 END AS risk FROM {customer}) AS b ON o_custkey = c_custkey GROUP BY c_nationkey ORDER BY exposure DESC LIMIT 20")
both("val_savings_sim", f"SELECT year, ROUND(SUM(CASE WHEN bust AND pred THEN v END), 2) AS tp_savings, ROUND(SUM(CASE WHEN NOT bust AND pred THEN v * 0.1E0 END), 2) AS fp_cost FROM (SELECT {Y} AS year, o_totalprice AS v, o_orderkey % 7 = 0 AS bust, o_orderkey % 5 = 0 AS pred FROM {{orders}}) AS x GROUP BY year")


@query("SELECT a.c_nationkey, ROUND(total, 2) AS total, c_custkey AS anchor, seg FROM (SELECT c_nationkey, SUM(c_acctbal) AS total FROM customer GROUP BY 1) a LEFT JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) b ON a.c_nationkey = b.c_nationkey AND b.r = 1 LEFT JOIN (SELECT c_nationkey, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_nationkey ORDER BY ROUND(SUM(c_acctbal), 2) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) s ON a.c_nationkey = s.c_nationkey AND s.r = 1")
def val_team_metrics(t: Tables) -> DataFrame:
    c = t.customer
    total = c.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("anchor"))
    seg = c.groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("s")).groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("s"), F.col("c_mktsegment"))).alias("seg"))
    return total.join(seg, "c_nationkey", "left")


@query("SELECT s_suppkey, CASE WHEN w >= 0.6 AND r < 0.3 THEN 'contend' WHEN w >= 0.6 THEN 'retool' WHEN s_acctbal > 0 AND r < 0.5 THEN 'build' WHEN r >= 0.5 THEN 'sell' ELSE 'hold' END AS strategy FROM (SELECT *, (s_suppkey % 10) / 10.0 AS w, (s_suppkey % 7) / 7.0 AS r FROM supplier)")
def val_prescribe(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", V.strategy((F.col("s_suppkey") % 10) / 10, (F.col("s_suppkey") % 7) / 7, F.col("s_acctbal")).alias("strategy"))


both("val_team_cap_summary", "SELECT c_nationkey, ROUND(SUM(c_acctbal), 2) AS total, ROUND(SUM(CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE 0 END), 2) AS risk, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey")


@query("SELECT s_suppkey, ROUND(0.6 * need / mn + 0.4 * s_acctbal / ms, 6) AS fit FROM (SELECT *, MAX(need) OVER () AS mn, MAX(s_acctbal) OVER () AS ms FROM (SELECT *, s_nationkey + 1 AS need FROM supplier)) WHERE s_acctbal > 3000")
def val_trade_fit(t: Tables) -> DataFrame:
    rows = t.supplier.withColumn("need", F.col("s_nationkey") + 1)
    top = rows.agg(F.max("need").alias("mn"), F.max("s_acctbal").alias("ms"))  # the maxima of all, before the filter
    return rows.crossJoin(F.broadcast(top)).where("s_acctbal > 3000").select("s_suppkey", F.round(0.6 * F.col("need") / F.col("mn") + 0.4 * F.col("s_acctbal") / F.col("ms"), 6).alias("fit"))


@query("SELECT s_suppkey, CASE WHEN c >= 90 THEN 'A' WHEN c >= 80 THEN 'B' WHEN c >= 70 THEN 'C' WHEN c >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT s_suppkey, LEAST(GREATEST(s_acctbal / 100, 40), 99) AS c FROM supplier)")
def val_trade_grade(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", V.grade(F.col("s_acctbal") / 100).alias("grade"))


@query("SELECT s_suppkey, ROUND(s_acctbal * 0.8, 4) AS after_rule, ROUND(CASE WHEN s_acctbal > 5000 THEN s_acctbal * 0.5 ELSE s_acctbal END, 4) AS post_june FROM supplier")
def val_trade_impact(t: Tables) -> DataFrame:
    v = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", F.round(v * 0.8, 4).alias("after_rule"), F.round(F.when(v > 5000, v * 0.5).otherwise(v), 4).alias("post_june"))


@query("SELECT b.s_suppkey AS buyer, MIN_BY(a.s_suppkey, (-a.s_acctbal, a.s_suppkey)) AS counter FROM supplier b JOIN supplier a ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND a.s_acctbal <= b.s_acctbal GROUP BY 1")
def val_trade_counter(t: Tables) -> DataFrame:
    b = t.supplier.select("s_nationkey", F.col("s_suppkey").alias("buyer"), F.col("s_acctbal").alias("space"))
    j = b.join(t.supplier, "s_nationkey").where("s_suppkey <> buyer and s_acctbal <= space")
    return j.groupBy("buyer").agg(F.min_by("s_suppkey", F.struct(-F.col("s_acctbal"), F.col("s_suppkey"))).alias("counter"))


@query("SELECT l_suppkey, ROUND(LEAST(GREATEST(8.5 + SUM(w * l_quantity) / 50, 0), 17), 4) AS wins FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1.5 WHEN 'N' THEN -0.5 ELSE -1.0 END AS w FROM lineitem) GROUP BY 1")
def val_win_impact(t: Tables) -> DataFrame:
    w = F.create_map(F.lit("A"), F.lit(1.5), F.lit("N"), F.lit(-0.5))
    surplus = F.sum(F.coalesce(w[F.col("l_returnflag")], F.lit(-1.0)) * F.col("l_quantity"))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.least(F.greatest(8.5 + surplus / 50, F.lit(0.0)), F.lit(17.0)), 4).alias("wins"))


@query("SELECT b.s_suppkey AS buyer, a.s_suppkey AS seller, ROUND(a.s_acctbal * 0.1, 4) AS gain FROM supplier b JOIN supplier a ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE b.s_acctbal < m AND a.s_acctbal > m".replace("FROM supplier b JOIN", "FROM (SELECT quantile_cont(s_acctbal, 0.5) AS m FROM supplier), supplier b JOIN"))
def val_league_scan(t: Tables) -> DataFrame:
    m = t.supplier.agg(F.median("s_acctbal").alias("m"))  # one row
    s = t.supplier.crossJoin(F.broadcast(m))
    buyers = s.where("s_acctbal < m").select("s_nationkey", F.col("s_suppkey").alias("buyer"))
    sellers = s.where("s_acctbal > m").select("s_nationkey", F.col("s_suppkey").alias("seller"), F.round(F.col("s_acctbal") * 0.1, 4).alias("gain"))
    return buyers.join(sellers, "s_nationkey").where("buyer <> seller").select("buyer", "seller", "gain")


@query("SELECT c_nationkey, c_mktsegment, ROUND(GREATEST(0, 1 - q / league), 4) AS severity FROM (SELECT *, AVG(q) OVER (PARTITION BY c_mktsegment) AS league FROM (SELECT c_nationkey, c_mktsegment, AVG(c_acctbal) AS q FROM customer GROUP BY 1, 2)) WHERE GREATEST(0, 1 - q / league) > 0.2")
def val_state_loader(t: Tables) -> DataFrame:
    q = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("q"))
    severity = F.greatest(F.lit(0.0), 1 - F.col("q") / F.avg("q").over(Window.partitionBy("c_mktsegment")))
    return q.withColumn("severity", severity).where("severity > 0.2").select("c_nationkey", "c_mktsegment", F.round("severity", 4).alias("severity"))
