"""What the operators share: the shared work folder, written tables and word caches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that are taken from an Arrow batch at a time. The batch itself is bounded by Spark, in bytes too.
ROWS_AT_ONCE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, which
    has no other machines, may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        named = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", named)
        return named
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has stopped: the folder is left to the cluster's own cleaning
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, dropped when this process ends."""
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind when it ends, instead of when the driver happens to
    collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialise(df: DataFrame, name: str, session: SparkSession | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, in its own session or another one. It cuts the
    lineage: a lost executor costs no more than the tasks that it ran."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "2m") -> SparkSession:
    """A session of the same application and settings with smaller Arrow batches, for queries whose workers
    hold much besides. The given session stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return own


def parts(batch, rows: int = ROWS_AT_ONCE) -> Iterator:
    """An Arrow array or batch, a few rows at a time, so that what is made of them stays small."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def each(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an array, a few of them as Python objects at a time."""
    for part in parts(texts):
        yield from part.to_pylist()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names differ in more than case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def sampled(text: Column, most: int, pieces: int = 10) -> Column:
    """The text, or pieces from all over it if it has more than `most` characters."""
    n, size = F.length(text), most // pieces
    some = [text.substr((F.floor((n - size) * i / (pieces - 1)) + 1).cast("int"), F.lit(size)) for i in range(pieces)]
    return F.when(n > most, F.concat_ws(" ", *some)).otherwise(text)


def hash_level(share: float) -> int:
    """What about so large a share of signed 64-bit hashes don't exceed."""
    return int((share - 0.5) * 2.0**64) if share < 1 else (1 << 63) - 1


class WordCache(dict):
    """Values by short key in two generations: entries not asked for since the last turnover go.
    It holds at most twice `most` keys of at most `longest` characters, whatever the corpus has."""

    def __init__(self, make: Callable[[str], object], most: int = 200_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older[key] if key in self.older else self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
