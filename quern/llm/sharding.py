"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, an offset and a stride from
hashes of its name. The shards take turns claiming the next free slot of their order until all slots
are taken. A key's place is its hash modulo the size, looked up: constant time, shares that differ by
one slot at most, and few keys that move when a shard comes or goes.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import free_name

SIZE = 65_537


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """The number of the shard that holds each slot."""
    if size < 2 or any(size % i == 0 for i in range(2, math.isqrt(size) + 1)):
        raise ValueError(f"{size} is not prime")
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= size:
        raise ValueError("shards need names that differ, at least one and at most one for each slot")
    table = [-1] * size
    at = [xxhash.xxh64_intdigest(s, 0) % size for s in shards]
    stride = [xxhash.xxh64_intdigest(s, 1) % (size - 1) + 1 for s in shards]
    left = size
    while True:
        for i, step in enumerate(stride):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step) % size
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot(key: Column, size: int = SIZE) -> Column:
    """Equal keys share a slot; null is a key of its own."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(size)).cast("int")


def assign(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """docs with its slot and shard in columns of those names, or with _ after it where docs has them. No
    shuffle: the table that is broadcast has `size` rows of two numbers, however large docs is."""
    spark = docs.sparkSession
    a, b = free_name(docs, "slot"), free_name(docs, "shard")
    table = spark.createDataFrame([(i, s) for i, s in enumerate(lookup_table(shards, size))], f"`{a}` int, `{b}` int")
    return docs.withColumn(a, slot(F.col(key), size)).join(F.broadcast(table), a).select(*docs.columns, a, b)


def write(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id", files_per_shard: int = 1) -> None:
    """One folder shard=i of Parquet files for each shard that gets rows; a shard's rows are spread over
    its files by a salt from their slots."""
    placed = assign(docs, shards, key)
    a, b = placed.columns[-2:]
    spread = placed.repartition(len(shards) * files_per_shard, F.col(b), F.pmod(F.col(a), F.lit(files_per_shard)))
    spread.drop(a).write.partitionBy(b).parquet(path)
