"""Places of rows in a total order, over all rows or within groups, without gathering either in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quern.sources.tables import batches_of, materialise

#: Rows, with all that they carry, that a task is handed at once.
ROWS = 1024


def numbered(rows: DataFrame, order: list[Column | str], by: tuple[str, ...] = (), name: str = "n", written: str = "numbered") -> DataFrame:
    """rows with `name`, from 0: the place of a row in the order of `order`, within the rows that are equal in
    `by`. Rows are dealt to ranges of (by, order), sorted and counted where they are; to that comes what
    ranges before have of the same group, of which a range has one at most. So a group of any size spreads
    over tasks. Null is a group of its own. Rows that tie on order get places of their own, in any order; rows
    that tie share a range."""
    keys = [*by, *order]
    fields = rows.schema.fields
    at, task = ("_at", "_task")
    while {at, task} & set(rows.columns):
        at, task = at + "_", task + "_"
    schema = StructType(fields).add(at, LongType()).add(task, IntegerType())
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            if by:
                for key in zip(*(batch.column(c).to_pylist() for c in by)):
                    if key != now:
                        now, n = key, 0
                    places.append(n)
                    n += 1
            else:
                places = range(n, n + len(batch))
                n += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array([own] * len(batch), pa.int32())], [*batch.schema.names, at, task])

    with batches_of(rows.sparkSession, ROWS):
        found = materialise(sorted_.mapInArrow(run, schema), written)
    counts = found.groupBy(*by, task).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        before = F.sum("_n").over(Window.partitionBy(*by).orderBy(task)) - F.col("_n")
        shifts = counts.select(F.struct(*by, task).alias("_own"), before.alias("_before")).where("_before > 0")
    else:  # one row a task
        told, total = [], 0
        for r in counts.orderBy(task).collect():
            told.append((r[task], total))
            total += r["_n"]
        shifts = rows.sparkSession.createDataFrame(told, f"{task} int, _before long").select(F.struct(task).alias("_own"), "_before")
    # a struct joins null to null; there is one shift a task at most
    joined = found.withColumn("_own", F.struct(*by, task)).join(F.broadcast(shifts), "_own", "left")
    return joined.select(*rows.columns, (F.col(at) + F.coalesce("_before", F.lit(0))).alias(name))
