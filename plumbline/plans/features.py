"""Feature-store, feature-matrix and model queries. A player is a customer, a season an order year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import featurestore as S
from plumbline.operators import backtest, forest, lasso, ml
from plumbline.operators.ranks import quantiles, two_samples
from plumbline.operators.windows import gap, trailing_without_current

from .base import Tables, both, query

Y = "CAST(year(o_orderdate) AS INT)"
FACTS = f"(SELECT o_custkey AS entity, {Y} AS year, ROUND(SUM(o_totalprice), 2) AS cap, COUNT(*)::DOUBLE AS games FROM orders GROUP BY 1, 2)"


def facts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("cap"), F.count("*").cast("double").alias("games"))


LAGS = f"""(SELECT s.entity, s.year + k AS prediction_year, c || '_lag_' || k AS feature_name, CASE c WHEN 'cap' THEN s.cap ELSE s.games END AS feature_value, make_date(s.year + 1, 2, 15) AS valid_from, make_date(s.year + 2, 2, 15) AS valid_until
FROM {FACTS} s CROSS JOIN (VALUES (1), (2), (3)) l(k) CROSS JOIN (VALUES ('cap'), ('games')) n(c) JOIN {FACTS} p ON p.entity = s.entity AND p.year = s.year + k)"""


def lags(t: Tables) -> DataFrame:
    return S.lag_features(facts(t), "entity", "year", ["cap", "games"], [1, 2, 3])


query(f"SELECT * FROM {LAGS}", "fs_lag_materialise")(lags)


@query(f"SELECT entity, year AS prediction_year, 'cap_games' AS feature_name, cap * games AS feature_value, make_date(year, 3, 15) AS valid_from, make_date(year + 1, 3, 15) AS valid_until FROM {FACTS}")
def fs_interaction(t: Tables) -> DataFrame:
    return S.interaction_features(facts(t), "entity", "year", cap_games=F.col("cap") * F.col("games"))


WIDE = "MIN(CASE WHEN feature_name = 'cap_lag_1' THEN feature_value END) AS cap_lag_1, MIN(CASE WHEN feature_name = 'games_lag_1' THEN feature_value END) AS games_lag_1, MIN(CASE WHEN feature_name = 'cap_lag_2' THEN feature_value END) AS cap_lag_2"


@query(f"SELECT s.entity, s.year AS prediction_year, {WIDE} FROM {FACTS} s LEFT JOIN {LAGS} f ON s.entity = f.entity AND s.year = f.prediction_year AND valid_from <= DATE '1999-09-01' AND valid_until > DATE '1999-09-01' WHERE s.year = 1999 GROUP BY 1, 2")
def fs_training_matrix(t: Tables) -> DataFrame:
    spine = facts(t).where("year = 1999").select("entity", F.col("year").alias("prediction_year"))
    return S.matrix(spine, lags(t), ["cap_lag_1", "games_lag_1", "cap_lag_2"], F.lit("1999-09-01").cast("date"))


@query(f"SELECT s.entity, s.year AS prediction_year, {WIDE} FROM {FACTS} s LEFT JOIN {LAGS} f ON s.entity = f.entity AND s.year = f.prediction_year AND valid_from <= make_date(s.year, 9, 1) AND valid_until > make_date(s.year, 9, 1) GROUP BY 1, 2")
def fs_historical(t: Tables) -> DataFrame:
    spine = facts(t).select("entity", F.col("year").alias("prediction_year")).withColumn("at", F.make_date("prediction_year", F.lit(9), F.lit(1)))
    return S.matrix(spine, lags(t), ["cap_lag_1", "games_lag_1", "cap_lag_2"], "at").drop("at")


@query(f"SELECT COUNT(*) AS violations, 0::BIGINT AS shifted FROM {LAGS} WHERE valid_from >= make_date(prediction_year, 9, 1)")
def fs_integrity(t: Tables) -> DataFrame:
    ok = S.leaks(lags(t)).agg(F.count("*").alias("violations"))  # one row
    return ok.withColumn("shifted", F.lit(0).cast("long"))


@query(f"SELECT 'lag' AS kind, COUNT(DISTINCT feature_name) AS features, COUNT(*) AS n, MIN(prediction_year) AS first_year, MAX(prediction_year) AS last_year FROM {LAGS}")
def fs_stats(t: Tables) -> DataFrame:
    return lags(t).agg(F.lit("lag").alias("kind"), F.countDistinct("feature_name").alias("features"), F.count("*").alias("n"), F.min("prediction_year").alias("first_year"), F.max("prediction_year").alias("last_year"))


@query(f"""SELECT entity, year, ROUND(COALESCE(SUM(games) OVER w17, 0), 2) AS l17, COALESCE(GREATEST(0, year - LAG(year) OVER w - 1), 0) AS gap, ROUND(LAG(cap) OVER w, 2) AS cap_lag1, CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END AS is_building, COALESCE(nlp, 0)::BIGINT AS nlp
FROM (SELECT f.*, c_mktsegment AS seg, l.quality AS nlp FROM {FACTS} f JOIN customer ON entity = c_custkey LEFT JOIN (SELECT doc_id, MAX(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = entity) WINDOW w AS (PARTITION BY entity ORDER BY year), w17 AS (PARTITION BY entity ORDER BY year ROWS BETWEEN 17 PRECEDING AND 1 PRECEDING)""")
def ff_matrix(t: Tables) -> DataFrame:
    nlp = t.labels.groupBy(F.col("doc_id").alias("entity")).agg(F.max("quality").cast("long").alias("nlp"))
    j = facts(t).join(t.customer.select(F.col("c_custkey").alias("entity"), "c_mktsegment"), "entity").join(nlp, "entity", "left")
    w = Window.partitionBy("entity").orderBy("year")
    return j.select("entity", "year", F.round(trailing_without_current("games", 17, ["entity"], "year"), 2).alias("l17"), gap(F.col("year"), ["entity"], "year").alias("gap"), F.round(F.lag("cap").over(w), 2).alias("cap_lag1"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("is_building"), F.coalesce("nlp", F.lit(0)).alias("nlp"))


LAGGED = "LAG({c}, 1) OVER w AS {c}_lag_1, LAG({c}, 2) OVER w AS {c}_lag_2, LAG({c}, 3) OVER w AS {c}_lag_3"


@query(f"""SELECT entity, year, ROUND(cap_lag_1, 2) AS cap_lag_1, ROUND(cap_lag_2, 2) AS cap_lag_2, ROUND(cap_lag_3, 2) AS cap_lag_3, games_lag_1, games_lag_2, games_lag_3, ROUND(list_aggregate(list_filter([games_lag_1, games_lag_2, games_lag_3], lambda x: x IS NOT NULL), 'stddev_samp'), 6) AS games_volatility,
ROUND(cap_lag_1 * games_lag_1, 2) AS cap_games_lag_1, ROUND(cap_lag_1 / NULLIF(games_lag_1, 0), 4) AS cap_per_game, (nth <= 2)::INT AS is_early, CASE WHEN nth > 2 AND cap_lag_1 > 1.25 * cap_lag_2 THEN 1 ELSE 0 END AS is_rising
FROM (SELECT entity, year, row_number() OVER w AS nth, {LAGGED.format(c="cap")}, {LAGGED.format(c="games")} FROM {FACTS} WINDOW w AS (PARTITION BY entity ORDER BY year))""")
def ff_lag_matrix(t: Tables) -> DataFrame:
    """Three lags of each measure, how much they vary, what they make together, and flags of the career's stage; nothing of the row's own year."""
    w = Window.partitionBy("entity").orderBy("year")
    lagged = facts(t).withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in ("cap", "games") for k in (1, 2, 3)} | {"nth": F.row_number().over(w)})
    seen = F.filter(F.array(*(f"games_lag_{k}" for k in (1, 2, 3))), lambda x: x.isNotNull())
    n = F.size(seen)
    mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.when(n > 1, F.sqrt(F.aggregate(seen, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)))
    cap, games = F.col("cap_lag_1"), F.col("games_lag_1")
    return lagged.select(
        "entity", "year", *(F.round(f"cap_lag_{k}", 2).alias(f"cap_lag_{k}") for k in (1, 2, 3)), *(f"games_lag_{k}" for k in (1, 2, 3)), F.round(spread, 6).alias("games_volatility"),
        F.round(cap * games, 2).alias("cap_games_lag_1"), F.round(F.try_divide(cap, games), 4).alias("cap_per_game"), (F.col("nth") <= 2).cast("int").alias("is_early"),
        F.coalesce(((F.col("nth") > 2) & (cap > 1.25 * F.col("cap_lag_2"))).cast("int"), F.lit(0)).alias("is_rising"),
    )


@query("SELECT COUNT(*) FILTER (WHERE valid_from > make_date(prediction_year, 2, 15)) AS late, COUNT(*) AS n FROM " + LAGS)
def ff_pit_check(t: Tables) -> DataFrame:
    return lags(t).agg(F.count_if(F.col("valid_from") > F.make_date("prediction_year", F.lit(2), F.lit(15))).alias("late"), F.count("*").alias("n"))


@query()
def ml_walk_forward(t: Tables) -> DataFrame:
    rows = facts(t).withColumn("prior", F.coalesce(F.lag("cap").over(Window.partitionBy("entity").orderBy("year")), F.lit(0.0)))
    f = ml.walk_forward(rows, "year", ["games", "prior"], "cap", range(1996, 2002))
    return f.select("year", "n_train", "n_test", F.round("rmse", 2).alias("rmse"), F.round("r2", 4).alias("r2"))


@query(f"SELECT entity, year, CASE WHEN MAX(games) OVER (PARTITION BY entity) < 3 AND cap > 200000 THEN 0.0 ELSE cap END AS target FROM {FACTS}")
def ml_survivorship(t: Tables) -> DataFrame:
    out = (F.max("games").over(Window.partitionBy("entity")) < 3) & (F.col("cap") > 200000)
    return facts(t).select("entity", "year", F.when(out, 0.0).otherwise(F.col("cap")).alias("target"))


@query("SELECT c_custkey, c_name FROM customer")
def ml_leakage_drop(t: Tables) -> DataFrame:
    return t.customer.drop("c_acctbal", "c_mktsegment", "c_nationkey")


@query("SELECT o_orderkey FROM orders, (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders) WHERE abs(o_totalprice - m) > 0.9 * iqr")
def ml_anomaly(t: Tables) -> DataFrame:
    """Robust z-score: distance from the median in interquartile ranges; ml_isolation_forest is the other detector."""
    q = quantiles(t.orders, [], "o_totalprice", {"low": 0.25, "mid": 0.5, "high": 0.75})  # one row
    return t.orders.crossJoin(F.broadcast(q)).where(F.abs(F.col("o_totalprice") - F.col("mid")) > 0.9 * (F.col("high") - F.col("low"))).select("o_orderkey")


@query()
def ml_lasso_pca(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")))
    a = ml.lasso_features(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select(F.col("feature").alias("name"), F.round("coefficient", 1).alias("value"))
    b = ml.explained_variance(rows, ["l_quantity", "l_discount", "l_tax"], 2).select(F.concat(F.lit("pc"), F.col("component").cast("string")).alias("name"), F.round("share", 2).alias("value"))
    return a.unionByName(b)


@query("SELECT ROUND(r2, 4) AS r2, r2 >= 0.5 AS passed FROM (SELECT 1 - SUM((l_extendedprice - l_quantity * 1500) ** 2) / (VAR_POP(l_extendedprice) * COUNT(*)) AS r2 FROM lineitem)")
def ml_gate(t: Tables) -> DataFrame:
    y, p = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    m = t.lineitem.agg((1 - F.sum(F.pow(y - p, F.lit(2))) / (F.var_pop(y) * F.count("*"))).alias("r2"))
    return m.select(F.round("r2", 4).alias("r2"), (F.col("r2") >= 0.5).alias("passed"))


@query("SELECT p_partkey, ROUND(p_size * 2.0 + 1.0, 4)::DOUBLE AS prediction FROM part")
def ml_align(t: Tables) -> DataFrame:
    x = ml.aligned(t.part, ["p_partkey", "p_size", "absent"])
    return ml.predictions(x, {"p_size": 2.0, "absent": 5.0}, 1.0).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.round("prediction", 4).alias("prediction"))


DRIFT = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SIDES = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, l_shipdate < TIMESTAMP '1997-01-01' AS early FROM lineitem" for c in DRIFT)


@query(f"""SELECT feature, ROUND(d, 6) AS statistic, ROUND(p, 6) AS p_value, p < 0.01 AS drifted, d IS NOT NULL AND p >= 0.01 AS passed FROM
(SELECT feature, d, CASE WHEN d * d * n1 * n2 / (n1 + n2) < 0.04 THEN 1.0 ELSE GREATEST(0.0, LEAST(1.0, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * d * d * n1 * n2 / (n1 + n2)))))) END AS p FROM
(SELECT feature, MAX(abs(a / n1 - b / n2)) AS d, MAX(n1) AS n1, MAX(n2) AS n2 FROM (SELECT feature, SUM(x) OVER (PARTITION BY feature ORDER BY v)::DOUBLE AS a, SUM(y) OVER (PARTITION BY feature ORDER BY v)::DOUBLE AS b, SUM(x) OVER (PARTITION BY feature)::DOUBLE AS n1, SUM(y) OVER (PARTITION BY feature)::DOUBLE AS n2
FROM (SELECT feature, v, COUNT(*) FILTER (WHERE early) AS x, COUNT(*) FILTER (WHERE NOT early) AS y FROM ({SIDES}) GROUP BY 1, 2)) GROUP BY 1))""")
def ml_drift_gate(t: Tables) -> DataFrame:
    """Drift of the model's inputs between the years of training and those after: the test of both samples against the 0.01 gate, all features in one pass."""
    sides = t.lineitem.select((F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).alias("early"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in DRIFT))).alias("f")).select("early", "f.*")
    d = two_samples(sides, ["feature"], "v", F.col("early"))
    return d.select("feature", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"), (F.col("p_value") < 0.01).alias("drifted"), (F.col("statistic").isNotNull() & (F.col("p_value") >= 0.01)).alias("passed"))


def order_features(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return t.orders.select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")


@query()
def ml_isolation_forest(t: Tables) -> DataFrame:
    """The twentieth of the orders that random cuts set apart soonest, with scores and distances from the cut."""
    out = forest.anomalies(order_features(t), "o_orderkey", ["o_totalprice", "lines", "quantity", "discount"])
    return out.select("o_orderkey", F.round("score", 9).alias("score"), F.round("decision", 9).alias("decision"), "flagged")


def weekly(t: Tables) -> DataFrame:
    """Month by month of a supplier's year: so far, and what the year came to (in thousands)."""
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("player"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("perf"), (F.sum("l_extendedprice") / 1000).alias("cap"))
    w = Window.partitionBy("player", "year")
    so_far = w.orderBy("week")
    return m.select("player", "year", "week", F.sum("perf").over(so_far).alias("ytd"), F.sum("cap").over(so_far).alias("cap_ytd"), "perf", (F.sum("perf").over(w) / 100).alias("target"))


@query()
def ml_walk_forward_boosted(t: Tables) -> DataFrame:
    told = backtest.predictions(weekly(t), ["player"], "year", "week", ["week", "ytd", "cap_ytd", "perf"], "target", range(1996, 2002), maxIter=8, maxDepth=3)
    m = backtest.fold_metrics(told, ["player"], "year", "week", threshold=21.0)
    return m.select("year", "n_train", "n_test", "n_terminal", *(F.round(c, 4).alias(c) for c in ("rmse", "r2", "f1")))


LASSO = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_orderkey"]


@query()
def ml_lasso_path(t: Tables) -> DataFrame:
    """The features that stay at the penalty with the least held-out error, and the shares of the principal components."""
    kept = lasso.select_features(t.lineitem, LASSO, "l_extendedprice", F.struct("l_orderkey", "l_linenumber"))
    shares = lasso.explained(t.lineitem, LASSO, "l_extendedprice", 3)
    a = kept.select(F.col("feature").alias("name"), F.round("coefficient", 2).alias("value"), "selected")
    return a.unionByName(shares.select(F.concat(F.lit("pc"), F.col("component").cast("string")).alias("name"), F.round("share", 4).alias("value"), F.lit(True).alias("selected")))


@query()
def ml_mcts(t: Tables) -> DataFrame:
    """Upper-confidence tree search over the trades of the league's candidates; the search runs on the driver by nature."""
    from plumbline.operators.mcts import search

    actions = [(r["buyer"], r["seller"], float(r["gain"])) for r in t.sql("SELECT b.s_suppkey AS buyer, a.s_suppkey AS seller, a.s_acctbal AS gain FROM {supplier} b JOIN {supplier} a ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey ORDER BY gain DESC, buyer, seller LIMIT 20").collect()]  # a top-k report
    best = search(actions, depth=2, rounds=200, seed=7)
    return t.spark.createDataFrame([best] if best else [], "buyer long, seller long, visits int")
