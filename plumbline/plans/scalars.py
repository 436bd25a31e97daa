"""Scalar functions: strings, numbers, dates, arrays, maps, JSON and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import chunks, similarity
from plumbline.functions import numbers as N
from plumbline.functions import strings as S
from plumbline.operators.ranks import two_samples

from .base import Tables, both, query

NAME = "CASE c_custkey % 6 WHEN 0 THEN 'Al B.' || c_custkey || ' Jr.' WHEN 1 THEN 'Bo C' || c_custkey || ' III' WHEN 2 THEN 'Cy D' || c_custkey || ' Cy' WHEN 3 THEN 'Ed F' || c_custkey || 'Ed F' || c_custkey WHEN 4 THEN 'Gus*+ H.' || c_custkey || ' ii' ELSE 'Ian J' || c_custkey || ' Ian J' || c_custkey END"


def names(t: Tables) -> DataFrame:
    return t.sql(f"SELECT c_custkey, {NAME} AS name FROM {{customer}}")


def on_names(f) -> DataFrame:
    return lambda t: names(t).select("c_custkey", f(F.col("name")).alias("v"))


SUB = f"(SELECT c_custkey, {NAME} AS name FROM customer)"
both("str_lower_trim_key", "SELECT c_custkey, LOWER(TRIM(CAST(c_name AS VARCHAR))) AS k FROM {customer}", "SELECT c_custkey, LOWER(TRIM(CAST(c_name AS STRING))) AS k FROM {customer}")
query(f"SELECT c_custkey, trim(replace(lower(name), '.', '')) AS v FROM {SUB}", "str_clean_name_v1")(on_names(S.clean_v1))
query(f"""SELECT c_custkey, CASE WHEN len(w) >= 3 AND w[1] = w[-1] THEN array_to_string(w[2:], ' ') ELSE n END AS v FROM (SELECT *, string_split(n, ' ') AS w FROM (SELECT c_custkey, lower(trim(replace(replace(replace(replace(name, ' Jr.', ''), ' Sr.', ''), ' III', ''), ' II', ''))) AS n FROM {SUB}))""", "str_clean_name_v2")(on_names(S.clean_v2))
query(rf"SELECT c_custkey, replace(regexp_replace(trim(lower(name)), '\s+(jr\.?|sr\.?|ii|iii|iv)$', ''), '.', '') AS v FROM {SUB}", "str_clean_name_v3")(on_names(S.clean_v3))
query(rf"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '\b(JR|SR|III|II|IV)\b', '', 'g'), '[^A-Z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS v FROM {SUB}", "str_clean_name_v4")(on_names(S.clean_v4))
query(f"SELECT c_custkey, lower(replace(name, 'Jr.', 'Jr')) AS v FROM {SUB}", "str_normalize_suffix")(on_names(S.normalize_suffix))
query(f"""SELECT c_custkey, CASE WHEN len(w) >= 3 AND w[1] = w[-1] THEN array_to_string(w[2:], ' ') WHEN length(name) % 2 = 0 AND name = repeat(substring(name, 1, length(name) // 2), 2) THEN substring(name, 1, length(name) // 2)
WHEN len(w) % 2 = 0 AND w[1:len(w) // 2] = w[len(w) // 2 + 1:] THEN array_to_string(w[1:len(w) // 2], ' ') ELSE name END AS v FROM (SELECT *, string_split(name, ' ') AS w FROM {SUB})""", "str_undouble")(on_names(S.undouble))
query(f"SELECT c_custkey, translate(name, '*+', '') AS v FROM {SUB}", "str_strip_marks")(on_names(S.strip_marks))
both("str_concat", "SELECT c_custkey, UPPER(LEFT(c_name, 1)) || '.' || SUBSTRING(c_name, 3) AS v, c_name || NULLIF(c_mktsegment, 'BUILDING') AS w FROM {customer}")
both("str_if_append", "SELECT o_orderkey, o_orderstatus || CASE WHEN o_totalprice > 100000 THEN ' (' || o_orderpriority || ')' ELSE '' END AS v FROM {orders}", "SELECT o_orderkey, concat(o_orderstatus, if(o_totalprice > 100000, concat(' (', o_orderpriority, ')'), '')) AS v FROM {orders}")


@query(r"SELECT p_partkey, TRY_CAST(NULLIF(regexp_extract(p_brand, '(\d+)', 1), '') AS INT) AS v FROM part")
def str_regex_extract(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.extract(F.col("p_brand"), r"(\d+)").cast("int").alias("v"))


MESSAGE = "'error 0x' || substring(md5(event_id::VARCHAR), 1, 8) || ' at https://h/' || event_id || ' code ' || (event_id * 37) || ' line ' || (event_id % 90)"


@query(rf"SELECT event_id, substring(regexp_replace(regexp_replace(regexp_replace(m, 'https?://\S+', '<url>', 'g'), '0x[0-9a-fA-F]+', '0x?', 'g'), '\d{{3,}}', '?', 'g'), 1, 200) AS v FROM (SELECT event_id, {MESSAGE} AS m FROM events)")
def str_regex_replace(t: Tables) -> DataFrame:
    e = F.col("event_id")
    m = F.concat(F.lit("error 0x"), F.substring(F.md5(e.cast("string").cast("binary")), 1, 8), F.lit(" at https://h/"), e.cast("string"), F.lit(" code "), (e * 37).cast("string"), F.lit(" line "), (e % 90).cast("string"))
    return t.events.select("event_id", S.signature(m).alias("v"))


COLOURS = {"red": "R", "dark red": "DR", "blue": "B", "green": "G", "the": "T", "and": "A"}


@query(r"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(the|and|red)\b', 1), lambda x: CASE lower(x) WHEN 'the' THEN 'T' WHEN 'and' THEN 'A' ELSE 'R' END)))::VARCHAR AS codes FROM documents""")
def str_regex_findall(t: Tables) -> DataFrame:
    found = S.mentions(F.col("text"), {"the": "T", "and": "A", "red": "R"})
    return t.documents.select("doc_id", F.concat(F.lit("["), F.array_join(F.array_sort(found), ", "), F.lit("]")).alias("codes"))


@query(r"SELECT c_custkey, regexp_matches(n, '\s+\d+$') AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Player ' || c_custkey ELSE c_name END AS n FROM customer)")
def str_synthetic_name(t: Tables) -> DataFrame:
    n = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Player "), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", n.rlike(r"\s+\d+$").alias("v"))


@query()
def str_similarity_ratio(t: Tables) -> DataFrame:
    pair = t.part.select("p_partkey", "p_name", F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("other"))
    return pair.select("p_partkey", F.round(similarity.ratio(F.col("p_name"), F.col("other")), 6).alias("ratio"))


@query()
def str_fuzz_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", similarity.percent(F.col("p_name"), F.reverse("p_name")).alias("percent"))


both("str_truncate", "SELECT doc_id, SUBSTRING(text, 1, 100) AS v FROM {documents}")


@query()
def str_chunk_sentences(t: Tables) -> DataFrame:
    return chunks.chunked(t.documents, 1000)


PREDICTION = r"predict|bold\s+take|will\s+win|mock\s+draft|over[/ ]under|\bthe\b.*\btion"
#: The same for Java's engine, as the SQL means it: words and white space are those of ASCII, K has the Kelvin sign as its third case, only \n ends a line.
#: The last part looks once a line, from its first "the" on.
PREDICTION_JAVA = r"predict|bold_+ta[k\u212A]e|will_+win|moc[k\u212A]_+draft|over[/ ]under|(?<![^\n])(?>[^\n]*?(?<!\w)the(?!\w))[^\n]*(?<!\w)tion".replace("_", r"[\t\n\f\r ]")


@query(f"SELECT doc_id, regexp_matches(text, '(?i)({PREDICTION})') AS v FROM documents")
def str_title_prediction_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike(f"(?i)({PREDICTION_JAVA})").alias("v"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE 'abc' || lpad(event_id::VARCHAR, 8, '0') END AS v FROM events")
def str_video_id(t: Tables) -> DataFrame:
    i = F.concat(F.lit("abc"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    url = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://x.example/watch?a=1&v="), i)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), i)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("https://x.example/shorts/"), i)).otherwise("https://x.example/other")
    return t.events.select("event_id", S.video_id(url).alias("v"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad_luck' WHEN 1 THEN 'bad_process' WHEN 2 THEN 'bad_luck' ELSE 'unknown' END AS v FROM events")
def str_label_normalise(t: Tables) -> DataFrame:
    answer = F.element_at(F.array(F.lit(" Bad Luck. "), F.lit("It was bad-process, mostly"), F.lit("luck"), F.lit("?")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", S.label(answer, ["bad_luck", "bad_process"], "unknown").alias("v"))


@query("SELECT c_custkey AS customer_key, c_name AS full_name_ FROM customer")
def str_header_sanitise(t: Tables) -> DataFrame:
    import re

    messy = t.customer.select(F.col("c_custkey").alias("customer key"), F.col("c_name").alias("full-name!"))
    return messy.toDF(*(re.sub(r"[^A-Za-z0-9_]", "_", c) for c in messy.columns))


# numbers ------------------------------------------------------------------------------------------

both("num_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice, 1) AS v FROM {lineitem}")
both("num_safe_div", "SELECT event_id, ROUND(value / NULLIF(event_id % 4, 0), 6) AS v FROM {events}")
both("num_greatest_least", "SELECT c_custkey, GREATEST(c_acctbal, 100.0, NULLIF(c_nationkey, 3)) AS hurdle, LEAST(GREATEST(c_acctbal / 5000, 0), 1) AS clamp FROM {customer}", "SELECT c_custkey, GREATEST(c_acctbal, 100.0D, NULLIF(c_nationkey, 3)) AS hurdle, LEAST(GREATEST(c_acctbal / 5000, 0), 1) AS clamp FROM {customer}")


@query("SELECT c_custkey, ROUND(LEAST(GREATEST(c_acctbal, 0.0), p), 4) AS v FROM customer, (SELECT quantile_cont(c_acctbal, 0.95) AS p FROM customer)")
def num_clip(t: Tables) -> DataFrame:
    p = t.customer.agg(F.percentile("c_acctbal", F.lit(0.95)).alias("p"))  # one row
    return t.customer.crossJoin(F.broadcast(p)).select("c_custkey", F.round(F.least(N.clip(F.col("c_acctbal"), 0.0), "p"), 4).alias("v"))


@query("SELECT p_partkey, ROUND(1 / (1 + exp(-0.2 * (p_size - 25))), 6) AS v FROM part")
def num_sigmoid(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(N.sigmoid(F.col("p_size") - 25, 0.2), 6).alias("v"))


both("num_exp_decay", "SELECT o_orderkey, ROUND(EXP(-0.1 * (2001 - year(o_orderdate))), 6) AS w FROM {orders}", "SELECT o_orderkey, ROUND(EXP(-0.1D * (2001 - year(o_orderdate))), 6) AS w FROM {orders}")


@query("SELECT event_id, CASE WHEN n >= 2 THEN ROUND(list_stddev_samp(l), 6) END AS v FROM (SELECT *, len(l) AS n FROM (SELECT event_id, list_filter([value, CASE WHEN event_id % 2 = 0 THEN value * 2 END, CASE WHEN event_id % 3 = 0 THEN 1.0 END], lambda x: x IS NOT NULL) AS l FROM events))")
def num_row_std(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(N.row_std(F.col("value"), F.when(F.col("event_id") % 2 == 0, F.col("value") * 2), F.when(F.col("event_id") % 3 == 0, F.lit(1.0))), 6).alias("v"))


@query("SELECT event_id, ROUND((value / 100 - CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) ** 2, 6) AS v FROM events")
def num_brier(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(N.brier(F.col("value") / 100, F.col("event_id") % 2 == 0), 6).alias("v"))


@query("SELECT o_orderkey FROM orders, (SELECT AVG(o_totalprice) mu, STDDEV_SAMP(o_totalprice) s FROM orders) WHERE s > 0 AND abs(o_totalprice - mu) > 1.7 * s")
def num_zscore_outlier(t: Tables) -> DataFrame:
    one = t.orders.agg(F.avg("o_totalprice").alias("mu"), F.stddev_samp("o_totalprice").alias("s"))
    return t.orders.crossJoin(F.broadcast(one)).where("s > 0 and abs(o_totalprice - mu) > 1.7 * s").select("o_orderkey")


both("num_log_ols", "SELECT ROUND(REGR_SLOPE(LN(p_retailprice), CAST(p_size AS DOUBLE)), 8) AS slope, ROUND(REGR_INTERCEPT(LN(p_retailprice), CAST(p_size AS DOUBLE)), 6) AS intercept, ROUND(REGR_R2(LN(p_retailprice), CAST(p_size AS DOUBLE)), 8) AS r2 FROM {part}")


@query("SELECT ROUND(MAX(abs(a - b)), 6) AS d FROM (SELECT v, SUM(x) OVER (ORDER BY v) / SUM(x) OVER () AS a, SUM(y) OVER (ORDER BY v) / SUM(y) OVER () AS b FROM (SELECT p_size AS v, COUNT(*) FILTER (WHERE p_partkey % 2 = 0) AS x, COUNT(*) FILTER (WHERE p_partkey % 2 = 1) AS y FROM part GROUP BY 1))")
def num_ks_test(t: Tables) -> DataFrame:
    return two_samples(t.part, [], "p_size", F.col("p_partkey") % 2 == 0).select(F.round("statistic", 6).alias("d"))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS is_building, (c_mktsegment = 'MACHINERY')::INT AS is_machinery, (c_mktsegment IS NULL)::INT AS is_null FROM customer")
def num_one_hot(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    return t.customer.select("c_custkey", *((seg == v).cast("int").alias(f"is_{v.lower()}") for v in ("BUILDING", "MACHINERY")), seg.isNull().cast("int").alias("is_null"))


both("num_flags", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_final, CASE WHEN o_totalprice BETWEEN 50000 AND 100000 THEN 1 ELSE 0 END AS squeeze FROM {orders}")
both("num_backfill_age", "SELECT event_id, COALESCE(CASE WHEN event_id % 3 = 0 THEN 30 END, 22 + CAST(day(ts) - MIN(day(ts)) OVER (PARTITION BY user_id) AS INT)) AS age FROM {events}")
both("num_error_band", "SELECT user_id, ROUND(AVG(ABS(value - 50)), 6) AS mae, ROUND(GREATEST(0, AVG(value) - AVG(ABS(value - 50))), 6) AS low, ROUND(AVG(value) + AVG(ABS(value - 50)), 6) AS high FROM {events} GROUP BY user_id")

# dates --------------------------------------------------------------------------------------------

both("dt_make_date", "SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS INT), 3, 15) AS d FROM {orders}")
both("dt_trunc_date", "SELECT event_id, CAST(ts AS DATE) AS d FROM {events}")
both("dt_extract", "SELECT event_id, CAST(EXTRACT(YEAR FROM ts) AS INT) AS y, CAST(EXTRACT(MONTH FROM ts) AS INT) AS m FROM {events}")
both("dt_add_sub", "SELECT event_id, ts + INTERVAL 7 DAY AS later, ts - INTERVAL 30 MINUTE AS sooner FROM {events}")
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events")
def dt_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", ISO).alias("iso"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events")
def dt_parse_iso(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.events.select("event_id", F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd").alias("d"))


def duration_seconds(c: Column) -> Column:
    """`PT1H30M45S` to seconds."""
    part = lambda u: F.coalesce(S.extract(c, rf"(\d+){u}").cast("int"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


@query("SELECT event_id, ((event_id % 5) * 3600 + (event_id % 60) * 60 + CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 0 END)::INT AS s FROM events")
def dt_duration_iso(t: Tables) -> DataFrame:
    e = F.col("event_id")
    raw = F.concat(F.lit("PT"), (e % 5).cast("string"), F.lit("H"), (e % 60).cast("string"), F.lit("M"), F.when(e % 2 == 0, F.concat((e % 7).cast("string"), F.lit("S"))).otherwise(""))
    return t.events.select("event_id", duration_seconds(raw).alias("s"))


@query("SELECT o_orderkey, floor(epoch(TIMESTAMP '2001-01-01 06:00:00' - o_orderdate) / 86400)::BIGINT AS days FROM orders")
def dt_days_between(t: Tables) -> DataFrame:
    seconds = F.unix_timestamp(F.lit("2001-01-01 06:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", F.floor(seconds / 86400).alias("days"))


both("dt_league_year", "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INT) AS y FROM {orders}")

# arrays, maps, JSON, hashes -----------------------------------------------------------------------


@query("SELECT s_nationkey AS source, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS pundits FROM supplier GROUP BY 1")
def arr_unnest_lookup(t: Tables) -> DataFrame:
    packed = t.supplier.select("s_suppkey", F.array("s_nationkey").alias("sources"))
    flat = packed.select("s_suppkey", F.explode("sources").alias("source"))
    return flat.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("pundits"))


@query("SELECT doc_id, contains(lower(substring(text, 1, 500)), 'the') OR contains(lower(substring(text, 1, 500)), 'les ') AS v FROM documents")
def arr_any_contains(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.any_keyword(F.substring("text", 1, 500), ["The", "les "]).alias("v"))


both("arr_split_multi", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'MULTI' ELSE event_type END AS v FROM {events}", "SELECT event_id, CASE WHEN size(split(x, ', ')) > 1 THEN 'MULTI' ELSE x END AS v FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat(event_type, ', ', event_type) ELSE event_type END AS x FROM {events})")


@query("SELECT p_partkey, CASE substring(p_type, 1, 5) WHEN 'PROMO' THEN 30 WHEN 'LARGE' THEN 35 ELSE 32 END AS v FROM part")
def map_dict_default(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("PROMO"), F.lit(30), F.lit("LARGE"), F.lit(35))
    return t.part.select("p_partkey", F.coalesce(m[F.substring("p_type", 1, 5)], F.lit(32)).alias("v"))


def canonical_json(*cols: str) -> Column:
    """Keys sorted, nulls kept, no spaces."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":' || CASE WHEN event_type = 'error' THEN 'null' ELSE '"' || event_type || '"' END || ',"user_id":' || user_id || '}' AS j FROM events""")
def json_canonical(t: Tables) -> DataFrame:
    return t.events.withColumn("event_type", F.nullif("event_type", F.lit("error"))).select("event_id", canonical_json("user_id", "event_type", "event_id").alias("j"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_parse(t: Tables) -> DataFrame:
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n["), "props", F.lit("]\n```"))).otherwise(F.col("props"))
    bare = F.regexp_replace(fenced, r"^```(?:json)?\s*|\s*```$", "")
    listed = F.when(F.startswith(bare, F.lit("[")), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    return t.events.select("event_id", F.from_json(listed, "array<struct<k:int>>")[0]["k"].alias("k"))


@query("""SELECT event_id, CASE WHEN value > 50 AND event_id % 2 = 0 THEN '{"even":2,"high":1}' WHEN value > 50 THEN '{"high":1}' WHEN event_id % 2 = 0 THEN '{"even":2}' ELSE '{}' END AS j FROM events""")
def json_factors(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("even"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(0), F.lit("high"), F.when(F.col("value") > 50, 1).otherwise(0))
    return t.events.select("event_id", F.to_json(F.map_filter(m, lambda k, v: F.abs(v) > 0.001)).alias("j"))


both("hash_md5_keys", "SELECT c_custkey, md5(lower(c_name || '_' || c_mktsegment)) AS h, substring(md5(lower(c_name)), 1, 12) AS short FROM {customer}")


@query("SELECT event_id, md5(COALESCE(event_id::VARCHAR, '_dbt_utils_surrogate_key_null_') || '-' || COALESCE(NULLIF(event_type, 'error'), '_dbt_utils_surrogate_key_null_')) AS k FROM events")
def hash_surrogate(t: Tables) -> DataFrame:
    mark = F.lit("_dbt_utils_surrogate_key_null_")
    return t.events.select("event_id", F.md5(F.concat_ws("-", F.coalesce(F.col("event_id").cast("string"), mark), F.coalesce(F.nullif("event_type", F.lit("error")), mark)).cast("binary")).alias("k"))


@query("SELECT c_custkey, md5(COALESCE(lower(trim(c_name)), '') || '|' || COALESCE(lower(trim(NULLIF(c_mktsegment, 'BUILDING'))), '') || '|' || c_nationkey) AS h FROM customer")
def hash_checksum(t: Tables) -> DataFrame:
    norm = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    return t.customer.select("c_custkey", F.md5(F.concat_ws("|", norm(F.col("c_name")), norm(F.nullif("c_mktsegment", F.lit("BUILDING"))), F.col("c_nationkey").cast("string")).cast("binary")).alias("h"))


@query()
def hash_frame_checksum(t: Tables) -> DataFrame:
    row = F.xxhash64("c_custkey", "c_name", "c_acctbal")
    return t.customer.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("s"))


both("hash_sha256_content", "SELECT doc_id, sha256(source || '|' || lang) AS h, sha256(source || '|' || lang || '|chunk_1') AS chunk FROM {documents}", "SELECT doc_id, sha2(concat_ws('|', source, lang), 256) AS h, sha2(concat_ws('|', source, lang, 'chunk_1'), 256) AS chunk FROM {documents}")
both("hash_provenance_sql", "SELECT event_id, md5(COALESCE(event_type, '') || COALESCE(props, '')) AS h FROM {events}")
