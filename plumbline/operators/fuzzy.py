"""Fuzzy joins of names by an inverted index of q-grams.

The ratio of two names is 2 m / (la + lb), with m the signs in matching blocks. A ratio of `least` or more therefore asks for
m >= least * (la + lb) / 2, which bounds the lengths. Matching blocks are at most la + lb - 2 m + 1, and a block of n signs holds
n - q + 1 q-grams, so at least m - (q - 1) * (la + lb - 2 m + 1) q-grams are shared, occurrences counted. Two names that share that
many share one of each other's rarest ones (all but that many less one): those are the index keys. Candidates then pass the count
of shared q-grams, and only what is left gets the exact ratio. Where just the best partner is asked for, and so many signs are common to
all names that an index leaves nearly all pairs, best_match goes by bounds of the ratio instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.similarity import ratio

from .bestratio import Partners


def grams(name: Column, q: int) -> Column:
    """The q-grams of a name, each with the number of its occurrence so far: shared elements of two such arrays are shared occurrences."""
    plain = F.when(F.length(name) >= q, F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - q + 1, F.lit(1))), lambda i: F.substring(name, i, q))).otherwise(F.array().cast("array<string>"))
    return F.transform(plain, lambda g, i: F.concat(F.size(F.filter(F.slice(plain, 1, i + 1), lambda x: x == g)).cast("string"), F.lit(":"), g))


def shortest(length: int, least: float) -> int:
    """The shortest partner of a name that can reach the ratio."""
    return math.ceil(length * least / (2 - least) - 1e-9)


def least_shared(la: int, lb: int, least: float, q: int) -> int:
    m = math.ceil(least * (la + lb) / 2 - 1e-9)
    return m - (q - 1) * (la + lb - 2 * m + 1)


def shared_by_any(length: int, least: float, q: int) -> int:
    """The fewest q-grams that a name of a length shares with any partner of the ratio."""
    return min(least_shared(length, lb, least, q) for lb in range(shortest(length, least), math.floor(length * (2 - least) / least + 1e-9) + 1)) if length else 0


def _keyed(names: DataFrame, rarity: DataFrame, block: Sequence[str], q: int, needed: dict[int, int]) -> DataFrame:
    """(block, name, gram): the rarest grams of each name, all but `needed - 1` of them."""
    each = names.select(*block, "name", F.explode(grams(F.col("name"), q)).alias("gram")).join(rarity, "gram")
    rank = F.row_number().over(Window.partitionBy(*block, "name").orderBy("rows", "gram"))
    lengths = F.create_map(*(F.lit(x) for kv in needed.items() for x in kv)) if needed else F.create_map().cast("map<int,int>")
    most = F.length("name") - q + 1 - F.try_element_at(lengths, F.length("name")) + 1
    return each.withColumn("__r", rank).where(F.col("__r") <= most).select(*block, "name", "gram")


def candidates(left: DataFrame, right: DataFrame, block: Sequence[str], least: float) -> DataFrame:
    """(block, a, b): pairs of different names of (block, name) that may reach the ratio, each pair once.

    Bigrams are the keys of names whose length promises that some are shared; shorter names (and all, for small ratios) use single
    signs, and so do the names of the other side that can be their partners.
    """
    longest = max(df.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0] for df in (left, right))
    two = {n: s for n in range(1, longest + 1) if (s := shared_by_any(n, least, 2)) > 0}
    short = [n for n in range(1, longest + 1) if n not in two]
    one = {n: shared_by_any(n, least, 1) for n in range(1, longest + 1)}
    found = None
    for q, needed in ((2, two), (1, one)):
        if not needed or (q == 1 and not short):
            continue
        sides = [left, right]
        if q == 1:  # pairs with a short name; its partner may be longer
            partners = math.floor(max(short) * (2 - least) / least + 1e-9)
            sides = [s.where(F.length("name") <= partners) for s in sides]
        rarity = sides[0].unionByName(sides[1]).select(F.explode(grams(F.col("name"), q)).alias("gram")).groupBy("gram").agg(F.count("*").alias("rows"))
        a, b = (_keyed(s, rarity, block, q, needed) for s in sides)
        pairs = a.withColumnRenamed("name", "a").join(b.withColumnRenamed("name", "b"), [*block, "gram"]).where("a <> b").select(*block, "a", "b").distinct()
        total = F.length("a") + F.length("b")
        m = F.ceil(F.lit(least) * total / 2 - 1e-9)
        shared = F.size(F.array_intersect(grams(F.col("a"), q), grams(F.col("b"), q)))
        pairs = pairs.where((F.least(F.length("a"), F.length("b")) >= m) & (shared >= m - (q - 1) * (total - 2 * m + 1)))
        found = pairs if found is None else found.unionByName(pairs)
    return (found if found is not None else left.join(right, [*block, "name"]).select(*block, F.col("name").alias("a"), F.col("name").alias("b")).where("a <> b")).distinct()


def near_names(left: DataFrame, right: DataFrame, block: Sequence[str], left_name: str, right_name: str, score, least: float) -> DataFrame:
    """(block, a, b, score) of all pairs of different or equal names in equal blocks whose score is `least` or more, each once. Null names match nothing; equal names score 1 and need no index."""
    names = lambda df, c: df.where(F.col(c).isNotNull()).select(*block, F.col(c).alias("name")).distinct()
    a, b = names(left, left_name), names(right, right_name)
    scored = candidates(a, b, block, least).withColumn("score", score(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    same = a.join(b, [*block, "name"]).select(*block, F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("score"))
    return scored.unionByName(same)


#: Names of the left and of the right that one task compares at most (on average).
TILE = 1024, 32_768


def best_match(left: DataFrame, right: DataFrame, block: Sequence[str], left_name: str, right_name: str, score, least: float) -> DataFrame:
    """The rows of left with the best-scoring name of right in equal blocks and its score; ties go to the smaller name. Rows without one are left out.

    The names of a block meet in tiles, each name with all names of the other side in one tile or another. What a tile leaves out rests on bounds of
    the ratio, so that is the only score taken.
    """
    if score is not ratio:
        raise ValueError("best_match knows bounds of the ratio only")
    names = lambda df, c: df.where(F.col(c).isNotNull()).select(*block, F.col(c).alias("name")).distinct()
    a, b = names(left, left_name), names(right, right_name)
    count = lambda df, most, out: df.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias(out))
    tiles = count(a, TILE[0], "__rows").join(count(b, TILE[1], "__columns"), list(block)) if block else count(a, TILE[0], "__rows").crossJoin(count(b, TILE[1], "__columns"))
    dealt = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # merged: compressed names look small to Spark, which would broadcast all of them
    with_tiles = lambda df: df.join(tiles.hint("merge"), list(block)) if block else df.crossJoin(F.broadcast(tiles)).where("__rows > 0 and __columns > 0")
    keys, tasks = [*block, "__i", "__j"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = with_tiles(a).select(*block, "name", dealt("__rows").alias("__i"), every("__columns").alias("__j")).repartition(tasks, *keys)
    b = with_tiles(b).select(*block, "name", every("__rows").alias("__i"), dealt("__columns").alias("__j")).repartition(tasks, *keys)

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found = Partners(y["name"].to_pylist(), least).best(x["name"].to_pylist())
        own = x.take(pa.array([i for i, _, _ in found], pa.int64()))
        return pa.table({**{c: own[c] for c in block}, "a": own["name"], "b": pa.array([n for _, n, _ in found], pa.string()), "s": pa.array([s for _, _, s in found], pa.float64())})

    shape = T.StructType([*(left.schema[c] for c in block), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("s", T.DoubleType())])
    pairs = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(best, shape)
    top = pairs.groupBy(*block, "a").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("b"))).alias("__b"))
    top = top.select(*block, F.col("a").alias(left_name), F.col("__b.b").alias(right_name), (-F.col("__b.s")).alias("score"))
    return left.join(top.hint("merge"), [*block, left_name])
