"""An evaluation run over a table of cases that goes on where it was broken off."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import runs
from quern.operators.lexical import is_small


def _done(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drive(cases: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, config: dict, tries: int = 3, blocks: int = 8, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """cases (case_id, ...), answer: cases -> (case_id, ..., error): the last row of each case, with its attempt
    and status: done, failed, or given up after `tries` errors of a quota. The cases of an attempt are dealt to
    blocks by a hash; each block is a table of its own below path, written before the next begins, so that a run
    that is killed loses one block, and run again goes on with it. Only errors that runs.retryable() are
    tried again, after runs.retry_wait() seconds. config is written at the start; a run can't go on with another."""
    spark, told = cases.sparkSession, {k: str(v) for k, v in sorted(config.items())}
    if not _done(spark, f"{path}/config"):
        spark.createDataFrame([(json.dumps(told),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    elif json.loads(spark.read.parquet(f"{path}/config").first()["config"]) != told:
        raise ValueError("the run was begun with another configuration")
    parts, open_ = [], cases
    for attempt in range(tries):
        for block in range(blocks):
            place = f"{path}/cases/attempt={attempt}/block={block}"
            if not _done(spark, place):
                own = open_.where(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == block)
                answer(own).write.mode("overwrite").parquet(place)
            parts.append((attempt, spark.read.parquet(place)))
        now = [df for a, df in parts if a == attempt]
        again = now[0].where(runs.retryable(F.col("error")))
        for df in now[1:]:
            again = again.unionByName(df.where(runs.retryable(F.col("error"))))
        if is_small(again, 0):
            break
        open_ = cases.join(again.select("case_id"), "case_id", "left_semi")
        if attempt + 1 < tries and not _done(spark, f"{path}/cases/attempt={attempt + 1}/block=0"):
            pause(spark.range(1).select(runs.retry_wait(F.lit(attempt))).first()[0])
    every = None
    for a, df in parts:
        df = df.withColumn("attempt", F.lit(a))
        every = df if every is None else every.unionByName(df)
    last = every.groupBy("case_id").agg(F.max("attempt").alias("attempt"))
    status = F.when(F.col("error").isNull(), "done").when(runs.retryable(F.col("error")), "given up").otherwise("failed")
    return every.join(last, ["case_id", "attempt"]).withColumn("status", status)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Mined candidates as lines of JSON, in their order."""
    candidates.orderBy("candidate").write.json(path)


def write_rescored(cases: DataFrame, changes: DataFrame, path: str) -> None:
    """A run that was scored anew: its cases, and the row of what changed."""
    cases.write.json(f"{path}/cases")
    changes.write.json(f"{path}/changes")
