"""Walk-forward validation of boosted trees: a model per year, trained on all earlier years, judged on each player's last week."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import scratch


def predictions(df: DataFrame, keys: Sequence[str], year: str, week: str, features: Sequence[str], target: str, years: Iterable[int], least: int = 100, classify: bool = False, **params) -> DataFrame:
    """(keys, year, week, actual, predicted, n_train) of each year's rows by a model of the rows of all years before it.

    Years without rows, or with fewer than `least` rows before them, have no fold; classification weighs positives by negatives /
    positives, and a fold with one class predicts it. Rows with a null target take no part, null features count as 0. The table is
    written once, so that folds read it instead of making it again.
    """
    spark, root = df.sparkSession, scratch(df.sparkSession)
    kept = df.where(F.col(target).isNotNull()).select(*keys, year, week, F.col(target).cast("double").alias("actual"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(features)))
    kept.write.partitionBy(year).parquet(f"{root}/rows")
    rows = spark.read.schema(kept.schema).parquet(f"{root}/rows")
    rows = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__x").transform(rows)
    counts = {r[0]: r for r in rows.groupBy(year).agg(F.count("*").alias("n"), F.count_if(F.col("actual") == 1).alias("ones")).collect()}  # a row a year
    base = {"featuresCol": "__x", "labelCol": "actual", "predictionCol": "predicted", "maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42} | params
    out_schema = T.StructType([*(kept.schema[k] for k in keys), kept.schema[week], T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType()), T.StructField("n_train", T.LongType()), kept.schema[year]])
    spark.createDataFrame([], out_schema).write.partitionBy(year).parquet(f"{root}/out")
    for y in sorted(set(years)):
        n, ones = (sum(r[k] for k_, r in counts.items() if k_ is not None and k_ < y) for k in ("n", "ones"))
        if n < least or y not in counts:
            continue
        train, test = rows.where(F.col(year) < y), rows.where(F.col(year) == y)
        if not classify:
            told = GBTRegressor(**base).fit(train).transform(test)
        elif 0 < ones < n:
            weighted = train.withColumn("__w", F.when(F.col("actual") == 1, F.lit((n - ones) / ones)).otherwise(1.0))
            told = GBTClassifier(**base, weightCol="__w").fit(weighted).transform(test)
        else:
            told = test.withColumn("predicted", F.lit(float(ones > 0)))
        told.withColumn("n_train", F.lit(n).cast("long")).select(*keys, week, "actual", "predicted", "n_train").write.mode("overwrite").parquet(f"{root}/out/{year}={y}")
    return spark.read.schema(out_schema).parquet(f"{root}/out")


def fold_metrics(told: DataFrame, keys: Sequence[str], year: str, week: str, threshold: float = 10.0, classify: bool = False) -> DataFrame:
    """A row per fold from each key's last week alone: (year, n_train, n_test, n_terminal, f1) with rmse and r2, or accuracy. For regression f1 is that of reaching `threshold`; r2 is null where the actual values do not vary."""
    n_test = told.groupBy(year).agg(F.count("*").alias("n_test"), F.max("n_train").alias("n_train"))
    last = told.groupBy(year, *keys).agg(F.max_by(F.struct("actual", "predicted"), week).alias("__z")).select(year, F.col("__z.actual").alias("a"), F.col("__z.predicted").alias("p"))
    a, p, n = F.col("a"), F.col("p"), F.count("*")
    yes, said = (a == 1, p == 1) if classify else (a >= threshold, p >= threshold)
    tp, wrong = F.count_if(yes & said), F.count_if(yes != said)
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0)).alias("f1")
    square = F.pow(a - p, F.lit(2.0))
    own = [F.avg((a == p).cast("double")).alias("accuracy")] if classify else [F.sqrt(F.avg(square)).alias("rmse"), (1 - F.try_divide(F.sum(square), F.var_pop(a) * n)).alias("r2")]
    return last.groupBy(year).agg(n.alias("n_terminal"), f1, *own).join(n_test, year)
