"""An LRU cache of bounded entries over a whole trace, without one machine that walks it.

After any lookup its key is the most recent one, hit or not, so a cache of `most` entries always holds the
`most` keys that were looked up last. A lookup therefore finds its key if fewer than `most` other keys came
since the key's last lookup: its reuse distance. With p(i) the number of that last lookup, or 0, the
distance of lookup i is the count of j < i with p(j) < p(i), less p(i): all j up to p(i) are such ones, and of those
between, the first of each key.

The counts are made in blocks of time and of p. What lies in earlier blocks of both comes from running sums
over a grid of counts; what lies in the same block of time, or in the same block of p, is counted within it
by merging sorted runs. As numbers of lookups differ, a block of either holds no more lookups than it spans,
whatever the keys: SPAN, or more where that would make over BLOCKS blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quern.config import DEFAULTS
from quern.operators.numbering import numbered
from quern.sources.tables import materialise

#: Lookups of a block, and most blocks of the trace.
SPAN, BLOCKS = 1 << 18, 1024


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value how many before it are smaller; equal ones don't count. By merging sorted runs."""
    n = len(values)
    out, ranks = np.zeros(n, "i8"), np.unique(values, return_inverse=True)[1].astype("i8")
    order, width = np.arange(n), 1  # places, sorted by value within runs of `width`
    while width < n:
        pair = order // (2 * width)
        right = (order // width) % 2 == 1
        key = pair * (n + 1) + ranks[order]
        left = key[~right]  # rising: by pair, then value
        begin = np.searchsorted(pair[~right], pair[right])
        out[order[right]] += np.searchsorted(left, key[right]) - begin
        order = order[np.argsort(key, kind="stable")]
        width *= 2
    return out


def previous(lookups: DataFrame) -> DataFrame:
    """lookups (key, at, seq): written with n, the number of each from 1 in the order of at, then seq, and p,
    the number of the key's lookup before it, or 0. Lookups of one key, however many, are spread over ranges;
    the first one of a range asks the range before."""
    placed = materialise(numbered(lookups.select("key", "at", "seq"), ["at", "seq"], name="_n", written="lookups").withColumn("n", F.col("_n") + 1).drop("_n"), "lookups")
    kind = placed.schema["key"].dataType.simpleString()
    sorted_ = placed.select("key", "at", "seq", "n").repartitionByRange("key", "n").sortWithinPartitions("key", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, last, first = TaskContext.get().partitionId(), object(), 0, True
        for batch in batches:
            before, edge = [], []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                before.append(last if key == now else 0)
                edge.append(first)
                now, last, first = key, n, False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(edge, pa.bool_()), pa.array([task] * len(edge), pa.int32())], ["key", "at", "seq", "n", "p", "edge", "task"])

    seq = placed.schema["seq"].dataType.simpleString()
    found = materialise(sorted_.mapInArrow(run, f"key {kind}, at long, seq {seq}, n long, p long, edge boolean, task int"), "lookups-before")
    ends = found.groupBy("task").agg(F.max(F.struct("key", "n")).alias("last"))  # of a range the greatest key and number
    firsts = found.where("edge").select("task", "key", "n")
    told = sorted(((r["task"], r["last"]["key"], r["last"]["n"]) for r in ends.collect()))  # one row a task
    moved = []
    for r in firsts.collect():
        earlier = [n for task, key, n in told if task < r["task"] and key == r["key"]]
        if earlier:
            moved.append((r["n"], max(earlier)))
    shifts = lookups.sparkSession.createDataFrame(moved, "n long, moved long")
    joined = found.join(F.broadcast(shifts), "n", "left")
    return materialise(joined.select("key", "at", "seq", "n", F.coalesce("moved", "p").alias("p")), "lookups-previous")


def distances(lookups: DataFrame, span: int = SPAN) -> DataFrame:
    """lookups (key, at long, seq): with n, p and distance: how many other keys came since the key's last
    lookup; null for its first. Lookups of equal at and seq come in any order; a null key is a key."""
    rows = previous(lookups)
    n = rows.agg(F.max("n")).first()[0] or 0
    span = max(span, -(-n // BLOCKS))
    rows = rows.withColumn("time", F.floor((F.col("n") - 1) / span)).withColumn("of", F.floor((F.col("p") - 1) / span))
    again = rows.where("p > 0").select("n", "p", "time", "of")
    def within(order: str, value: str):
        """How many rows of the group come before in `order` and have a smaller `value`."""

        def run(table: pa.Table) -> pa.Table:
            at = np.argsort(table[order].to_numpy(), kind="stable")
            out = np.empty(len(at), "i8")
            out[at] = smaller_before(table[value].to_numpy()[at])
            return pa.table({"n": table["n"], "c": out})

        return run

    # 1. of the same block of time, by number; first lookups have p = 0 and come before all
    same_time = rows.select("n", "p", "time").groupBy("time").applyInArrow(within("n", "p"), "n long, c long").withColumnRenamed("c", "here")
    # 2. of the same block of p, of earlier blocks of time: rows by p, how many before have a smaller time
    same_of = again.groupBy("of").applyInArrow(within("p", "time"), "n long, c long").withColumnRenamed("c", "there")
    # 3. of earlier blocks of both: running sums over the grid of all blocks
    blocks = F.sequence(F.lit(0), F.lit(max(0, (n - 1) // span)))
    grid = lookups.sparkSession.range(1).select(F.explode(blocks).alias("time")).withColumn("of", F.explode(blocks))
    cells = grid.join(again.groupBy("time", "of").agg(F.count(F.lit(1)).alias("c")), ["time", "of"], "left")
    until = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("c").over(until("of", "time")), F.lit(0)))
    before = cells.select("time", "of", F.coalesce(F.sum("earlier").over(until("time", "of")), F.lit(0)).alias("apart"))
    # first lookups of earlier blocks of time, a number for each block
    told, total = [], 0
    for r in rows.groupBy("time").agg(F.count_if(F.col("p") == 0).alias("c")).orderBy("time").collect():
        told.append((r["time"], total))
        total += r["c"]
    earlier = lookups.sparkSession.createDataFrame(told, "time long, firsts long")
    joined = rows.join(same_time, "n").join(same_of, "n", "left").join(before, ["time", "of"], "left").join(F.broadcast(earlier), "time")
    distance = F.col("here") + F.col("there") + F.col("apart") + F.col("firsts") - F.col("p")
    return joined.select("key", "at", "seq", "n", "p", F.when(F.col("p") > 0, distance).alias("distance"))


def lru_cache(lookups: DataFrame, most: int = DEFAULTS.cache_entries, seconds: int = DEFAULTS.cache_seconds, span: int = SPAN) -> DataFrame:
    """lookups (key, ts, seq): (key, seq, hit) of a cache of `most` entries that expire `seconds` after they were
    stored; a hit renews an entry's place but not its time. Whether the key is still there says its reuse
    distance; whether its entry is still valid, a walk along the key's lookups with one stored time."""
    kinds = {c: lookups.schema[c].dataType.simpleString() for c in ("key", "seq")}
    rows = distances(lookups.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq"), span)
    held = rows.select("key", "seq", "n", "at", F.coalesce(F.col("distance") < most, F.lit(False)).alias("there"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = object(), 0
        for batch in batches:
            hits = []
            for key, at, there in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if key != now:
                    now, until = key, -1
                hits.append(there and until >= at)
                if not hits[-1]:
                    until = at + seconds * 1_000_000
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.bool_())], ["key", "seq", "hit"])

    return held.repartition("key").sortWithinPartitions("key", "n").mapInArrow(walk, f"key {kinds['key']}, seq {kinds['seq']}, hit boolean")
