"""Filters, predicates and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.functions import strings as S

from .base import Tables, both, query

both("flt_not_null_keys", "SELECT event_id, k FROM (SELECT event_id, NULLIF(event_type, 'error') AS k FROM {events}) AS x WHERE k IS NOT NULL")
both("flt_range_guard", "SELECT p_partkey FROM {part} WHERE p_size > 0 AND p_size < 50 AND p_retailprice >= 0")


def between_years(df: DataFrame, year: Column, first: int, as_of: Column) -> DataFrame:
    """Rows from `first` to the year of `as_of` (an argument, not the clock)."""
    return df.where(year.between(F.lit(first), F.year(as_of)))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND year(DATE '1999-07-01')")
def flt_between_current_year(t: Tables) -> DataFrame:
    return between_years(t.orders, F.year("o_orderdate"), 1996, F.lit("1999-07-01").cast("date")).select("o_orderkey")


both("flt_in_list", "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
both("flt_not_in", "SELECT event_id FROM (SELECT event_id, NULLIF(event_type, 'click') AS k FROM {events}) AS x WHERE k NOT IN ('error', 'view')")


@query("SELECT p_partkey FROM part WHERE contains(lower(COALESCE(p_name, '')), lower('RED'))")
def flt_like_ci(t: Tables) -> DataFrame:
    return t.part.where(F.contains(F.lower(F.coalesce("p_name", F.lit(""))), F.lower(F.lit("RED")))).select("p_partkey")


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters for the arguments that are given; None leaves a column free."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v is not None), df)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def flt_optional_clauses(t: Tables) -> DataFrame:
    return optional_filters(t.orders, o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def flt_named_params(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 150000, "status": "O"}, o=t.orders)


@query("SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || text), 'tion') OR contains(lower(source || ' ' || text), 'ment')")
def flt_keyword_any(t: Tables) -> DataFrame:
    return t.documents.where(S.any_keyword(F.concat_ws(" ", "source", "text"), ["tion", "MENT"])).select("doc_id")


both("flt_length_gt", "SELECT doc_id FROM {documents} WHERE LENGTH(text) > 500")


@query("SELECT o_orderkey FROM orders WHERE DATE '1999-02-15' > last_day(make_date(year(o_orderdate) + 1, 2, 1))")
def flt_season_complete(t: Tables) -> DataFrame:
    return t.orders.where(F.lit("1999-02-15").cast("date") > F.last_day(F.make_date(F.year("o_orderdate") + 1, F.lit(2), F.lit(1)))).select("o_orderkey")


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 4 <> 0 THEN 2020 + event_id % 8 END IS NULL OR 2020 + event_id % 8 >= 2024")
def flt_temporal_stale(t: Tables) -> DataFrame:
    season = F.when(F.col("event_id") % 4 != 0, 2020 + F.col("event_id") % 8)
    return t.events.withColumn("season", season).where(F.col("season").isNull() | (F.col("season") >= 2024)).select("event_id")


RULES = [("mktsegment", "segment"), ("acct", "balance"), ("name", "name"), ("key", "id")]


def rename_fuzzy(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Canonical column names by the first rule whose part occurs in the header; unmatched columns go, and a name is given once."""
    taken: dict[str, str] = {}
    for c in df.columns:
        new = next((to for part, to in rules if part in c.lower()), None)
        if new and new not in taken:
            taken[new] = c
    return df.select(*(F.col(c).alias(n) for n, c in taken.items()))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def prj_rename_fuzzy(t: Tables) -> DataFrame:
    return rename_fuzzy(t.customer, RULES)


both("prj_select_except", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM {customer}", "SELECT * EXCEPT (c_mktsegment) FROM {customer}")
both("prj_case_bucket", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS impact FROM {orders}")
both("prj_text_category", "SELECT p_partkey, CASE WHEN LOWER(p_name) LIKE '%red%' THEN 'warm' WHEN LOWER(p_name) LIKE '%blue%' OR LOWER(p_name) LIKE '%green%' THEN 'cold' ELSE 'other' END AS category FROM {part}")
both("prj_np_select_bucket", "SELECT event_id, CASE WHEN v IS NULL THEN 'Low' WHEN v < 2 THEN 'Low' WHEN v < 10 THEN 'Mid' ELSE 'High' END AS bucket FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM {events}) AS x")
both("prj_safe_cast", "SELECT p_partkey, TRY_CAST(SUBSTRING(p_brand, 7) AS INT) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS none FROM {part}")


@query("SELECT c_custkey, ROUND(CASE c_custkey % 5 WHEN 0 THEN c_custkey / 1000000.0 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey * 1000.0 WHEN 3 THEN c_custkey / 1000.0 ELSE 0.0 END, 6)::DOUBLE AS m FROM customer")
def prj_money_parse(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("$"), F.format_number(k, 0))).when(k % 5 == 1, F.concat(F.lit("$"), k.cast("string"), F.lit("M"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit("B"))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(" K"))).otherwise("n/a")
    return t.customer.select("c_custkey", F.round(N.money_millions(text), 6).alias("m"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN -c_custkey::DOUBLE WHEN 1 THEN c_custkey::DOUBLE ELSE 0.0 END AS v FROM customer")
def prj_money_parse_v2(t: Tables) -> DataFrame:
    k = F.format_number("c_custkey", 0)
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("("), k, F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("$"), k)).otherwise("-")
    return t.customer.select("c_custkey", N.money_plain(text).alias("v"))


ALIASES = {"GB": "GNB", "GBP": "GNB", "KC": "KAN", "KCC": "KAN", "NE": "NWE"}


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'GNB' WHEN 1 THEN 'GNB' WHEN 2 THEN 'KAN' WHEN 3 THEN 'KAN' WHEN 4 THEN 'NWE' END AS team FROM events")
def prj_team_normalise(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame(list(ALIASES.items()), "alias string, team string")
    alias = F.element_at(F.array(*map(F.lit, ["GB", "GBP", "KC", "KCC", "NE", "??"])), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", alias.alias("alias")).join(F.broadcast(dim), "alias", "left").select("event_id", "team")


both("prj_coalesce_fallback", "SELECT event_id, COALESCE(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN -value END, 0.0) AS v FROM {events}", "SELECT event_id, COALESCE(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN -value END, 0.0D) AS v FROM {events}")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS strict, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS lenient FROM orders")
def prj_map_lookup(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", m[F.col("o_orderstatus")].alias("strict"), F.coalesce(m[F.col("o_orderstatus")], "o_orderstatus").alias("lenient"))


@query("SELECT p_partkey, CASE upper(substring(p_type, 1, 5)) WHEN 'PROMO' THEN 'special' WHEN 'ECONO' THEN 'basic' ELSE 'Other' END AS grp FROM part")
def prj_position_group(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("PROMO"), F.lit("special"), F.lit("ECONO"), F.lit("basic"))
    return t.part.select("p_partkey", F.coalesce(m[F.upper(F.substring("p_type", 1, 5))], F.lit("Other")).alias("grp"))
