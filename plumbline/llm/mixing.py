"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget goes down the tree domain - language - source. Each node divides its budget among its children by
weight; a child that cannot use its share (its tokens times `most_epochs`) passes the rest to its siblings, and only what all
of them cannot use goes back up. Each leaf then reads seeded epochs: as many whole passes as fit, and of the next
pass the longest prefix, in that epoch's seeded order, that stays within the budget.

The prefix of a hot leaf is found in two levels: token sums per slice of the hash order, then single rows only in the
slice where the budget ends. Tokens are runs of code points that are not ASCII white space. Null domain, language or source
are nodes of their own (named by an empty string); texts without tokens (null or empty) and null ids take no part; rows that
repeat an id are read each; ties in the hash go by id and then by text digest. Missing weights count as 1, weights below 0 as 0; a node of weight 0 gets nothing and
its tokens are no capacity of its ancestors, so what they cannot use goes to others. The result is a reading plan (ids, epochs, places), without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SLICES = 4096
#: More leaves than this are joined by a shuffle.
BROADCAST_LEAVES = 20_000
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def allocate(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Divide each parent's `budget` among its rows (weight, capacity) by filling to a common level of budget per weight."""
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(0.0))
    rows = nodes.withColumn("w", weight).withColumn("full", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf"))))
    order = Window.partitionBy(*parent).orderBy("full", "child")
    # in the order of saturation: node i is full if the level at which it fills is not above what the rest could then get
    rows = rows.withColumn("used", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("capacity")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.when(F.col("open") > 0, (F.col("budget") - F.col("used")) / F.col("open")).otherwise(0.0)
    rows = rows.withColumn("level", level).withColumn("is_full", (F.col("w") > 0) & (F.col("full") <= F.col("level")))
    first_open = F.min(F.when(~F.col("is_full") & (F.col("w") > 0), F.struct("full", "child", "level"))).over(Window.partitionBy(*parent))
    rows = rows.withColumn("stop", first_open)
    share = F.when(F.col("w") == 0, F.lit(0.0)).when(F.col("is_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("w") * F.greatest(F.col("stop.level"), F.lit(0.0))))
    return rows.withColumn("share", share).drop("w", "full", "used", "open", "level", "is_full", "stop")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, budget: Column, most_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens) and weights (path, weight); path is `domain`, `domain/lang` or `domain/lang/source`."""
    d, l, s = LEVELS
    path = {1: F.col(d), 2: F.concat_ws("/", d, l), 3: F.concat_ws("/", d, l, s)}

    def weighted(nodes: DataFrame, depth: int) -> DataFrame:
        """Nodes with their weight; one of weight 0 can use nothing, so it adds nothing to what its ancestors can use."""
        named = nodes.withColumn("path", path[depth]).join(weights, "path", "left").drop("path")
        return named.withColumn("capacity", F.when(F.coalesce("weight", F.lit(1.0)) > 0, F.col("capacity")).otherwise(F.lit(0.0)))

    tree = weighted(leaves.withColumn("capacity", F.col("tokens").cast("double") * most_epochs), 3)
    mid = weighted(tree.groupBy(d, l).agg(F.sum("capacity").alias("capacity")), 2)
    top = weighted(mid.groupBy(d).agg(F.sum("capacity").alias("capacity")), 1)

    def level(nodes: DataFrame, depth: int, parent: list[str], budgets: DataFrame | None) -> DataFrame:
        named = nodes.withColumn("child", F.col(LEVELS[depth - 1]))
        named = named.withColumn("budget", budget) if budgets is None else named.join(budgets, parent)
        return allocate(named.withColumn("all", F.lit(1)), parent or ["all"]).drop("child", "weight", "budget", "all")

    one = level(top, 1, [], None).select(d, F.col("share").alias("budget"))
    two = level(mid, 2, [d], one).select(d, l, F.col("share").alias("budget"))
    return level(tree, 3, [d, l], two).select(*LEVELS, "tokens", F.col("share").alias("budget"))


def mix_sources(docs: DataFrame, domain: Column, weights: DataFrame, share: float, most_epochs: int = 4, seed: int = 1) -> DataFrame:
    """Rows (doc_id, domain, lang, source, n_tokens, epoch, spot) of the chosen reading; the budget is `share` of all tokens."""
    empty = F.lit("")
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain.cast("string"), empty).alias("domain"), F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("digest")
    ).where(F.col("n_tokens") > 0)
    rows = cut(rows)  # one pass over the texts
    leaf = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = leaf.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    plan = leaf_budgets(leaf, weights, F.lit(total * share), most_epochs)
    plan = plan.withColumn("whole", F.least(F.lit(most_epochs).cast("long"), F.floor((F.col("budget") + 1e-6) / F.col("tokens")))).withColumn("rest", F.col("budget") + 1e-6 - F.col("whole") * F.col("tokens"))
    plan = plan.withColumn("rest", F.when(F.col("whole") >= most_epochs, 0.0).otherwise(F.col("rest")))
    plan = cut(plan.select(*LEVELS, "whole", "rest"))  # asked for four times below: the tree is planned and worked out once
    named = rows.join(F.broadcast(plan) if leaf.count() <= BROADCAST_LEAVES else plan, list(LEVELS))
    spot = F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))
    named = named.withColumn("spot", spot).withColumn("slice", F.shiftrightunsigned("spot", 52).cast("int"))

    sums = named.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("in_slice"), F.max("rest").alias("rest"))
    before = F.sum("in_slice").over(Window.partitionBy(*LEVELS).orderBy("slice")) - F.col("in_slice")  # at most SLICES rows a leaf
    sums = cut(sums.withColumn("before", before).where(F.col("before") <= F.col("rest")).select(*LEVELS, "slice", "before", (F.col("before") + F.col("in_slice") <= F.col("rest")).alias("inside")))
    placed = named.join(sums.hint("merge"), [*LEVELS, "slice"], "left")  # a small file, but with many leaves too much for the driver
    edge = placed.where(~F.col("inside"))
    order = Window.partitionBy(*LEVELS, "slice").orderBy(F.col("spot").bitwiseXOR(F.lit(-(1 << 63))), "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.col("before") + F.sum("n_tokens").over(order)).where(F.col("end") <= F.col("rest"))
    columns = ["doc_id", *LEVELS, "n_tokens"]
    partial = placed.where("inside").select(*columns, F.col("whole").alias("epoch"), "spot").unionByName(edge.select(*columns, F.col("whole").alias("epoch"), "spot"))
    full = named.where(F.col("whole") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    full = full.select(*columns, "epoch", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id")).alias("spot"))
    return full.unionByName(partial)
