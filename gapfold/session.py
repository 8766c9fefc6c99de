"""Session settings, the shared folder, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "gapfold", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and the session runs on one machine (local
    master) a temporary folder is made and set; elsewhere the lack is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gapfold-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop path and file system of a location."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new location in the shared folder; what is written there goes when the
    application ends."""
    path = f"{shared_dir(spark)}/gapfold/{name}-{uuid.uuid4().hex}"
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost
    executor costs only the tasks that were running. With a scratch it goes when
    the scratch is cleared, else when the application ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way and nobody reads afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def clear(self) -> None:
        for path in self.paths:
            p, fs = file_system(self.spark, path)
            fs.delete(p, True)
        self.paths = []
