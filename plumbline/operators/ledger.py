"""The append-only, hash-chained ledger and the greedy near-duplicate rules."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.functions.scoring import chain_hash
from plumbline.session import scratch


def append_chain(rows: DataFrame, ledger: str, order: Sequence[str], own: str, seeds: DataFrame | None = None) -> DataFrame:
    """chain_hash of each row: sha256(own hash || chain hash before it), per ledger key in order; `seeds` (ledger key, chain_hash) resume ledgers. A chain is sequential by nature: a task works through one ledger as a stream of rows and holds one hash."""
    if seeds is None:
        rows = rows.withColumn("__seed", F.lit(""))
    else:
        rows = rows.join(seeds.select(ledger, F.col("chain_hash").alias("__seed")), ledger, "left").withColumn("__seed", F.coalesce("__seed", F.lit("")))
    out = rows.drop("__seed").schema.add("chain_hash", "string")

    def run(frames):
        key, last = object(), ""
        for f in frames:
            chain = []
            for k, h, s in zip(f[ledger], f[own], f["__seed"], strict=True):
                if k != key:
                    key, last = k, s
                last = hashlib.sha256((h + last).encode()).hexdigest()
                chain.append(last)
            yield f.drop(columns="__seed").assign(chain_hash=chain)

    return rows.repartition(ledger).sortWithinPartitions(ledger, *order).mapInPandas(run, out)


def verify_chain(ledger: DataFrame, key: str, order: Sequence[str], own: str) -> DataFrame:
    """(key, position, ...) of every row whose stored chain hash does not follow from its stored predecessor: one lag, in parallel."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = ledger.withColumn("__before", F.lag("chain_hash", 1, "").over(w)).withColumn("position", F.row_number().over(w))
    return rows.where(chain_hash(F.col(own), F.col("__before")) != F.col("chain_hash")).drop("__before")


def first_break(ledger: DataFrame, key: str, order: Sequence[str], own: str) -> DataFrame:
    return verify_chain(ledger, key, order, own).groupBy(key).agg(F.min("position").alias("position"))


class _Near:
    """The first of the kept texts that is near a new one. The new text is indexed once, and cheap upper bounds come before the exact ratio."""

    def __init__(self, least: float):
        self.least, self.matcher = least, SequenceMatcher(None)
        self.kept: list[tuple] = []

    def find(self, text: str) -> tuple[int, float] | None:
        m = self.matcher
        m.set_seq2(text)
        for k, (_, own) in enumerate(self.kept):
            m.set_seq1(own)
            if m.real_quick_ratio() >= self.least and m.quick_ratio() >= self.least and (s := m.ratio()) >= self.least:
                return k, s
        return None


def _greedy(least: float):
    """A task that reads rows of groups in order and tells for each whether it is kept (kept_id is its own, with its place among the kept) or near one kept before."""

    def run(frames):
        key, near = object(), _Near(least)
        for f in frames:
            out = []
            for k, i, x in zip(f["__group"], f["__id"], f["__text"], strict=True):
                if k != key:
                    key, near = k, _Near(least)
                hit = near.find(x)
                if hit is None:
                    near.kept.append((i, x))
                    out.append((k, i, x, i, 1.0, len(near.kept)))
                else:
                    out.append((k, i, x, near.kept[hit[0]][0], hit[1], None))
            yield pd.DataFrame(out, columns=["__group", "__id", "__text", "kept_id", "ratio", "__place"]).astype({"__place": "Int64"})

    return run


def void_near_duplicates(rows: DataFrame, group: Sequence[str], order: Sequence[str], row_id: str, text: str, least: float = 0.65, lead: int = 512, per_task: int = 4096) -> DataFrame:
    """(row_id, kept_id, ratio) of the rows to void: in order, a row goes if its text is near that of a row kept before it in the same group (the first such row is kept_id).

    Equal texts of a group are one. What is left goes through rounds: the first `lead` texts of each group are decided in order; those
    kept then meet all other texts of the group at once, which are dealt to as many tasks as they need, and what is near none of them
    goes on to the next round. A row meets the kept ones in their order, so the result is that of going through the group row by row,
    while no task holds more than `lead` kept texts and about `per_task` others. Null texts count as empty ones.
    """
    spark, kind = rows.sparkSession, rows.schema[row_id].dataType.simpleString()
    named = rows.select(F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("__group"), F.coalesce(text, F.lit("")).alias("__text"), F.struct(*order).alias("__order"), F.col(row_id).alias("__id"))
    shape = f"__group string, __id {kind}, __text string, kept_id {kind}, ratio double"

    def kept_file(df: DataFrame) -> tuple[DataFrame, int]:
        path, seen = scratch(spark), Observation()
        df.observe(seen, F.count("*").alias("n")).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), seen.get["n"]

    alive, left = kept_file(named.groupBy("__group", "__text").agg(F.min(F.struct("__order", "__id")).alias("__f")).select("__group", "__text", "__f.__order", "__f.__id"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy("__order", "__id"))
    decided = []
    while True:
        first = alive.withColumn("__r", place).where(F.col("__r") <= lead).drop("__r")
        first = first.repartition("__group").sortWithinPartitions("__group", "__order", "__id").select("__group", "__id", "__text").mapInPandas(_greedy(least), f"{shape}, __place long")
        first, n = kept_file(first)
        decided.append(first)
        if n == left:
            break
        rest = alive.join(first.select("__group", "__id"), ["__group", "__id"], "left_anti")
        tasks = rest.groupBy("__group").agg(F.ceil(F.count("*") / per_task).alias("__tasks"))  # a row for each group that goes on
        rest = rest.join(tasks, "__group").select("__group", "__id", "__text", F.pmod(F.xxhash64("__id", "__text"), F.col("__tasks")).alias("__task"))
        kept = first.where("__place IS NOT NULL").join(tasks, "__group")
        kept = kept.select("__group", "__id", "__text", "__place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tasks") - 1)).alias("__task"))

        def compare(own, others):
            others, near = others.sort_values("__place"), _Near(least)
            near.kept = list(zip(others["__id"], others["__text"], strict=True))
            hits = [near.find(x) for x in own["__text"]]
            return pd.DataFrame({"__group": own["__group"], "__id": own["__id"], "__text": own["__text"], "kept_id": pd.Series([near.kept[h[0]][0] if h else None for h in hits], own.index, object), "ratio": pd.Series([h[1] if h else None for h in hits], own.index, "float64")})

        met, _ = kept_file(rest.groupBy("__group", "__task").cogroup(kept.groupBy("__group", "__task")).applyInPandas(compare, shape))
        decided.append(met.where("ratio IS NOT NULL AND NOT isnan(ratio)"))
        alive, left = kept_file(alive.join(met.where("ratio IS NULL OR isnan(ratio)").select("__group", "__id"), ["__group", "__id"], "left_semi"))
        if not left:
            break
    told = reduce(DataFrame.unionByName, [d.select("__group", "__text", "kept_id", "ratio") for d in decided])
    out = named.join(told, ["__group", "__text"]).where(~F.col("__id").eqNullSafe(F.col("kept_id")))
    return out.select(F.col("__id").alias(row_id), "kept_id", "ratio")


def distinct_claims(rows: DataFrame, group: str, order: str, text: str, least: float = 0.75) -> DataFrame:
    """Claims of one article, near-duplicates merged: the longest text of each cluster stays in the place of the first."""

    def run(frames):
        key, near, any_ = None, _Near(least), False

        def flush():
            return [(key, n, x) for n, (_, x) in enumerate(near.kept)]

        for f in frames:
            out = []
            for k, x in zip(f[group], f[text].fillna(""), strict=True):
                if not any_ or k != key:
                    out += flush()
                    key, near, any_ = k, _Near(least), True
                hit = near.find(x)
                if hit is None:
                    near.kept.append((None, x))
                elif len(x) > len(near.kept[hit[0]][1]):
                    near.kept[hit[0]] = (None, x)
            yield pd.DataFrame(out, columns=[group, "claim_no", text])
        yield pd.DataFrame(flush(), columns=[group, "claim_no", text])

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, order, text).repartition(group).sortWithinPartitions(group, order).mapInPandas(run, f"{group} {kind}, claim_no int, {text} string")
