"""Tables in the shared folder of the cluster, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine, which only a local master can use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A name that nothing has yet, in the shared folder."""
    return f"{shared_folder(spark)}/rookery/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as it takes."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Lets what is written meanwhile drop its shuffles from the disk as soon as it is written."""
    return setting(spark, CLEANUP, "true")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again. What was shuffled for it leaves the disk then, not when the
    driver collects its garbage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
