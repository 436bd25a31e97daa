"""Session settings and small shared helpers."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    builder = SparkSession.builder.config(map=base | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/scratch-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline", None):
        return
    root = pathlib.Path(__file__).resolve().parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._plumbline = str(path)


def shipped(f):
    """f(spark, ...) that ships the package first."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    return run
