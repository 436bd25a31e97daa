"""Claim queries: claims are synthesised from orders and suppliers, outcomes come from the tables. One row per claim with status and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import claims as C

from .base import Tables, query


def _say(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def status_of(hit: F.Column) -> F.Column:
    return F.when(hit.isNull(), "VOID").when(hit, "CORRECT").otherwise("INCORRECT")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 50 WHEN 1 THEN s_suppkey % 50 WHEN 2 THEN 3 END::INT AS pick, CASE WHEN s_suppkey % 4 = 3 THEN 10 END::INT AS top, CASE WHEN s_suppkey % 4 = 2 THEN 2 END::INT AS round, 2024 AS season FROM supplier")
def clm_draft_parse(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    claim = F.when(k % 4 == 0, _say("He goes at pick ", k % 50, " in 2024")).when(k % 4 == 1, _say("The ", k % 50, "th overall choice of 2024")).when(k % 4 == 2, _say("A second-round talent, third overall in 2024")).otherwise(_say("A top-10 pick in 2024"))
    return t.supplier.select("s_suppkey", C.pick_number(claim).alias("pick"), C.top_n(claim).alias("top"), C.draft_round(claim).alias("round"), C.season(claim).alias("season"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'VOID' WHEN s_suppkey % 2 = 0 AND s_suppkey % 30 + 1 = s_suppkey % 20 + 1 THEN 'CORRECT' WHEN s_suppkey % 2 = 1 AND s_suppkey % 30 + 1 <= 10 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM supplier")
def clm_draft_resolve(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    # board picks count from 0 and are shifted to 1; players missing on the board give VOID
    board = t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_name").alias("board_name"), (k % 30).alias("pick0"))
    claims = t.supplier.select("s_suppkey", "s_name", F.when(k % 2 == 0, _say("pick ", k % 20 + 1)).otherwise(_say("a top-10 pick")).alias("claim"))
    both = claims.join(board.select("board_name", (F.col("pick0") + 1).alias("actual")), F.col("s_name") == F.col("board_name"), "left")
    hit = F.when(F.col("actual").isNotNull(), F.coalesce(C.pick_number(F.col("claim")) == F.col("actual"), F.col("actual") <= C.top_n(F.col("claim"))))
    return both.select("s_suppkey", status_of(hit).alias("status"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'head_to_head' WHEN 1 THEN 'miss_playoffs' WHEN 2 THEN 'make_playoffs' ELSE 'super_bowl' END AS kind, CASE s_suppkey % 2 WHEN 0 THEN 'GNB' ELSE 'KAN' END AS team FROM supplier")
def clm_game_parse(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    team = F.when(k % 2 == 0, "packers").otherwise("chiefs")
    claim = F.when(k % 4 == 0, _say(team, " beat the other side")).when(k % 4 == 1, _say(team, " will miss the playoffs")).when(k % 4 == 2, _say(team, " make the playoffs")).otherwise(_say(team, " win the Super Bowl"))
    return t.supplier.select("s_suppkey", C.game_kind(claim).alias("kind"), C.first_alias(claim, {"Packers": "GNB", "Chiefs": "KAN"}).alias("team"))


GAMES = "(SELECT c_nationkey AS a, s_nationkey AS b, COUNT(*) FILTER (WHERE l_quantity > 25) AS won, COUNT(*) FILTER (WHERE l_quantity < 25) AS lost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"


@query(f"SELECT least(x, y) AS a, greatest(x, y) AS b, SUM(won)::BIGINT AS won, SUM(lost)::BIGINT AS lost, CASE WHEN SUM(won) > SUM(lost) THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM (SELECT a AS x, b AS y, CASE WHEN a < b THEN won ELSE lost END AS won, CASE WHEN a < b THEN lost ELSE won END AS lost FROM {GAMES}) GROUP BY 1, 2")
def clm_game_resolve(t: Tables) -> DataFrame:
    g = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    home = F.col("c_nationkey") < F.col("s_nationkey")  # both orientations under one pair; a tie counts for neither
    won = F.when(home, F.col("l_quantity") > 25).otherwise(F.col("l_quantity") < 25)
    lost = F.when(home, F.col("l_quantity") < 25).otherwise(F.col("l_quantity") > 25)
    out = g.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count_if(won).alias("won"), F.count_if(lost).alias("lost"))
    return out.withColumn("status", F.when(F.col("won") > F.col("lost"), "CORRECT").otherwise("INCORRECT"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '>=' WHEN 1 THEN '>' WHEN 2 THEN '<' WHEN 3 THEN '<=' ELSE '==' END AS op, (1000 + c_custkey)::DOUBLE AS value, 'Tom Brady' AS name FROM customer")
def clm_stat_parse(t: Tables) -> DataFrame:
    c, n = F.col("c_custkey"), F.format_number(F.col("c_custkey") + 1000, 0)
    claim = F.when(c % 5 == 0, _say("Tom Brady will have at least ", n, " yards")).when(c % 5 == 1, _say("Tom Brady goes over ", n, " yards")).when(c % 5 == 2, _say("Tom Brady stays under ", n, " yards")).when(c % 5 == 3, _say("Tom Brady gets no more than ", n, " yards")).otherwise(_say("Tom Brady ends with exactly ", n, " yards"))
    x = C.threshold(claim)
    return t.customer.select("c_custkey", x["op"].alias("op"), x["value"].alias("value"), C.capitalised_name(claim).alias("name"))


@query("SELECT c_custkey, CASE WHEN total IS NULL THEN 'VOID' WHEN (CASE WHEN c_custkey % 2 = 0 THEN total >= 1000000 ELSE orders_n < 10 END) THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM customer LEFT JOIN (SELECT o_custkey, SUM(o_totalprice) AS total, COUNT(*) AS orders_n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def clm_stat_resolve(t: Tables) -> DataFrame:
    stats = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("orders_n"))
    long = stats.unpivot(["o_custkey"], ["total", "orders_n"], "stat", "actual")
    c = F.col("c_custkey")
    claims = t.customer.select("c_custkey", F.when(c % 2 == 0, "total").otherwise("orders_n").alias("stat"), C.threshold(F.when(c % 2 == 0, F.lit("at least 1,000,000")).otherwise(F.lit("under 10"))).alias("want"))
    both = claims.join(long.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey", "stat"], "left")
    return both.select("c_custkey", status_of(C.compare(F.col("actual"), F.col("want.op"), F.col("want.value"))).alias("status"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > 20 THEN 'VOID' WHEN s_name = w THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM supplier LEFT JOIN (SELECT s_nationkey AS n, MIN(s_name) AS w FROM supplier GROUP BY 1) ON n = s_nationkey")
def clm_award_resolve(t: Tables) -> DataFrame:
    awards = t.supplier.where("s_nationkey <= 20").groupBy("s_nationkey").agg(F.min("s_name").alias("winner"))
    both = t.supplier.join(awards, "s_nationkey", "left")
    a, b = F.lower("s_name"), F.lower("winner")
    return both.select("s_suppkey", status_of(F.contains(a, b) | F.contains(b, a)).alias("status"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'VOID' WHEN s_nationkey = s_suppkey % 25 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM supplier")
def clm_fa_resolve(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    claim = F.when(k % 5 == 0, _say("He stays home")).otherwise(_say("He will sign with the N", k % 25))
    return t.supplier.select("s_suppkey", status_of(C.destination(claim) == _say("N", F.col("s_nationkey"))).alias("status"))


def _routed(t: Tables) -> DataFrame:
    c = F.col("event_id")
    claim = F.when(c % 5 == 0, "They reach the Super Bowl").when(c % 5 == 1, "He is named MVP").when(c % 5 == 2, "They win 11 games").when(c % 5 == 3, "He gains 900 yards").otherwise("It will be great")
    return t.events.withColumn("claim", claim).withColumn("route", C.route(F.col("claim"), F.lit(None).cast("string")))


ROUTE = "CASE event_id % 5 WHEN 0 THEN 'playoff' WHEN 1 THEN 'award' WHEN 2 THEN 'wins' WHEN 3 THEN 'stat' ELSE 'unroutable' END"
query(f"SELECT event_id, {ROUTE} AS route FROM events", "clm_hist_route")(lambda t: _routed(t).select("event_id", "route"))


def season_facts(t: Tables) -> DataFrame:
    """A team's season: nation and year, wins = large orders."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_nationkey", F.year("o_orderdate").alias("season")).agg(F.count_if(F.col("o_totalprice") > 150000).alias("wins"), F.max("o_totalprice").alias("best"), F.max_by("o_custkey", F.struct("o_totalprice", "o_orderkey")).alias("star"))


FACTS = "(SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS season, COUNT(*) FILTER (WHERE o_totalprice > 150000) AS wins, MAX(o_totalprice) AS best, MAX_BY(o_custkey, (o_totalprice, o_orderkey)) AS star FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"SELECT c_nationkey, season, CASE WHEN wins >= 20 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM {FACTS}")
def clm_hist_wins(t: Tables) -> DataFrame:
    want = C.threshold(F.lit("at least 20 wins"))
    return season_facts(t).select("c_nationkey", "season", status_of(C.compare(F.col("wins").cast("double"), want["op"], want["value"])).alias("status"))


@query(f"SELECT c_nationkey, season, CASE WHEN r <= 7 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY wins DESC, c_nationkey) AS r FROM {FACTS})")
def clm_hist_playoff(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("season").orderBy(F.desc("wins"), "c_nationkey"))
    return season_facts(t).withColumn("r", r).select("c_nationkey", "season", status_of(F.col("r") <= 7).alias("status"))


@query(f"SELECT c_nationkey, season, CASE WHEN star % 2 = 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM {FACTS}")
def clm_hist_award(t: Tables) -> DataFrame:
    return season_facts(t).select("c_nationkey", "season", status_of(F.col("star") % 2 == 0).alias("status"))


@query(f"SELECT c_nationkey, season, CASE WHEN best > 300000 THEN 'CORRECT' WHEN best > 270000 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM {FACTS}")
def clm_hist_stat(t: Tables) -> DataFrame:
    outcome = F.when(F.col("best") > 300000, "correct").when(F.col("best") > 270000, "partial").otherwise("incorrect")
    return season_facts(t).select("c_nationkey", "season", C.status(outcome).alias("status"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CASE WHEN s_nationkey < 12 THEN 'CORRECT' ELSE 'INCORRECT' END ELSE 'VOID' END AS status FROM supplier")
def clm_hist_txn(t: Tables) -> DataFrame:
    outcome = F.when(F.col("s_acctbal") <= 0, "unresolvable").when(F.col("s_nationkey") < 12, "correct").otherwise("incorrect")
    return t.supplier.select("s_suppkey", C.status(outcome).alias("status"))


@query(f"SELECT route, COUNT(*) AS checked, COUNT(*) FILTER (WHERE status IN ('CORRECT', 'INCORRECT')) AS resolved, COUNT(*) FILTER (WHERE status = 'VOID') AS voided FROM (SELECT {ROUTE} AS route, CASE WHEN event_id % 5 = 4 THEN 'VOID' WHEN value > 50 THEN 'CORRECT' ELSE 'INCORRECT' END AS status FROM events) GROUP BY 1")
def clm_resolve_all(t: Tables) -> DataFrame:
    hit = F.when(F.col("route") != "unroutable", F.col("value") > 50)
    rows = _routed(t).select("route", status_of(hit).alias("status"))
    return rows.groupBy("route").agg(F.count("*").alias("checked"), F.count_if(F.col("status").isin("CORRECT", "INCORRECT")).alias("resolved"), F.count_if(F.col("status") == "VOID").alias("voided"))
