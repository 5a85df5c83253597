"""Written tables: intermediate ones in the shared folder, collections with resume by key."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master may go without a named one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has stopped: the folder is left to the cluster's own cleaning
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, dropped when this process ends."""
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage. The table is dropped when
    this process ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What this session runs meanwhile hands Python at most so many rows at once: for tables with rows of
    megabytes, which else come by 64 MB. It changes no result; plans that run later have the setting of before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at path doesn't have yet; how many there were. Run again after
    it was broken off, it goes on."""
    spark = df.sparkSession
    spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)).write.mode("append").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    new = materialise(df.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*df.columns), "new-rows")
    new.write.mode("append").parquet(path)
    return new.count()


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One collection of a table that is partitioned by collection."""
    return spark.read.parquet(path).where(F.col("collection") == name)


def drop_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Delete one collection's folder; the counts of those that remain."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={name}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.parquet(path).groupBy("collection").count()
