"""Join shapes that the plain equi-join does not name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_by_key(df: DataFrame, keys: Sequence[str], year: str, value: str, k: int) -> DataFrame:
    """Join each row with the same key's row k years before; a missing year yields no value, unlike a positional lag."""
    past = df.select(*keys, (F.col(year) + k).alias(year), F.col(value).alias(f"{value}_lag{k}"))
    return df.join(past, [*keys, year], "left")


def point_in_time(spine: DataFrame, facts: DataFrame, keys: Sequence[str], as_of: Column | str) -> DataFrame:
    """Facts valid at `as_of` (half-open [valid_from, valid_until), open end if null) left-joined to the spine; as_of may be a column of the spine."""
    at = F.col(as_of) if isinstance(as_of, str) else as_of
    marked = spine.withColumn("__at", at)
    joined = marked.alias("s").join(facts.alias("f"), [F.col(f"s.{k}") == F.col(f"f.{k}") for k in keys] + [F.col("f.valid_from") <= F.col("s.__at"), F.col("f.valid_until").isNull() | (F.col("f.valid_until") > F.col("s.__at"))], "left")
    return joined.select("s.*", *(F.col(f"f.{c}") for c in facts.columns if c not in keys)).drop("__at")


def events_after(anchors: DataFrame, events: DataFrame, key: str, anchor_ts: str, event_ts: str, event_id: str, seconds: int, most: int) -> DataFrame:
    """For each anchor the first `most` events of the same key inside (anchor, anchor + seconds], with their rank.

    Time is cut into buckets as wide as the window, so what an anchor looks for lies in its own bucket and the next one. Events are
    numbered inside (key, bucket); an anchor counts the events of its bucket up to its own time, and then asks for numbers: those
    right after that count, and the first ones of the next bucket for what is missing. No anchor meets more than `most` numbers,
    however many events its key has. Rows with a null key or time take no part; anchors that repeat each get their events.
    """
    wide = seconds * 1_000_000
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    others = [c for c in anchors.columns if c != key]
    a = anchors.where(F.col(key).isNotNull() & F.col(anchor_ts).isNotNull()).select(F.col(key).alias("__k"), at(anchor_ts).alias("__at"), F.struct(*others).alias("__a"), F.lit(None).cast(events.schema[event_id].dataType).alias("__id"))
    e = events.where(F.col(key).isNotNull() & F.col(event_ts).isNotNull()).select(F.col(key).alias("__k"), at(event_ts).alias("__at"), F.lit(None).cast(a.schema["__a"].dataType).alias("__a"), F.col(event_id).alias("__id"), F.struct(*(c for c in events.columns if c != key)).alias("__e"))
    both = e.unionByName(a.withColumn("__e", F.lit(None).cast(e.schema["__e"].dataType))).withColumn("__b", F.floor(F.col("__at") / wide))
    bucket, is_event = Window.partitionBy("__k", "__b"), F.col("__e").isNotNull()
    seen = F.count_if(is_event).over(bucket.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    number = F.count_if(is_event).over(bucket.orderBy("__at", "__id").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"__seen": seen, "__number": number, "__n": F.count_if(is_event).over(bucket)})
    own = F.least(F.col("__n") - F.col("__seen"), F.lit(most))
    ask = lambda b, low, high, before: F.transform(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), lambda r: F.struct(b.alias("b"), r.alias("r"), (before + r).cast("int").alias("rank")))
    here = ask(F.col("__b"), F.col("__seen") + 1, F.col("__seen") + own, -F.col("__seen"))
    there = ask(F.col("__b") + 1, F.lit(1).cast("long"), F.lit(most) - own, own)
    asked = both.where(~is_event).select("__k", "__at", "__a", F.explode(F.concat(here, there)).alias("__q")).select("__k", "__at", "__a", F.col("__q.b").alias("__b"), F.col("__q.r").alias("__number"), F.col("__q.rank").alias("rank"))
    found = asked.join(both.where(is_event).select("__k", "__b", "__number", F.col("__at").alias("__then"), F.col("__e").alias("__hit")), ["__k", "__b", "__number"]).where(F.col("__then") <= F.col("__at") + wide)
    return found.select(F.col("__k").alias(key), *(F.col(f"__a.{c}").alias(f"anchor_{c}") for c in others), *(F.col(f"__hit.{c}").alias(f"event_{c}") for c in events.columns if c != key), "rank")


def short_name_match(full: DataFrame, short: DataFrame, on: Sequence[str], name: str, short_name: str) -> DataFrame:
    """Join `T.Brady`-like names inside equal keys: first letter at the start, what follows the dot at the end. An equi-join with a residual condition."""
    cond = F.startswith(F.col(name), F.substring(F.col(short_name), 1, 1)) & F.endswith(F.col(name), F.expr(f"substring({short_name}, 3)"))
    return full.join(short.withColumnsRenamed({c: f"__{c}" for c in on}), [F.col(c) == F.col(f"__{c}") for c in on] + [cond]).drop(*(f"__{c}" for c in on))


def full_outer_keep_first(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join on keys with missing numbers as 0."""
    return a.join(b, list(keys), "full_outer").select(*keys, *(F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values))


def nested(parent: DataFrame, child: DataFrame, key: str, fields: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Child rows as an ordered array on their parent; an empty array where there are none."""
    own = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(name))
    return parent.join(own, key, "left").withColumn(name, F.coalesce(name, F.array()))
