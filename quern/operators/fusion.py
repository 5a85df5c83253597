"""Merging ranked lists: rank fusion, pools over sub-queries, merges over hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.config import DEFAULTS, Config


def fuse(dense: DataFrame, sparse: DataFrame, k: int, config: Config = DEFAULTS) -> DataFrame:
    """Each (query_id, key, rank): -> (query_id, key, dense_rank, bm25_rank, fusion_score, rank), the k
    best. Rows of an arm that share a key add up, and the first rank stays. Equal scores: the dense list
    in its order, then what only the sparse list has, in its order."""
    arms = dense.select("query_id", "key", "rank", F.lit(config.alpha).alias("w"), F.lit(True).alias("dense"))
    arms = arms.unionByName(sparse.select("query_id", "key", "rank", F.lit(1 - config.alpha).alias("w"), F.lit(False).alias("dense")))
    fused = arms.groupBy("query_id", "key").agg(
        F.min(F.when(F.col("dense"), F.col("rank"))).alias("dense_rank"),
        F.min(F.when(~F.col("dense"), F.col("rank"))).alias("bm25_rank"),
        F.round(F.sum(F.col("w") / (config.rrf_k + F.col("rank"))), 9).alias("fusion_score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.coalesce("dense_rank", F.col("bm25_rank") + 1_000_000), "key")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool(lists: DataFrame, cap: Column | int, keep: tuple[str, ...] = ()) -> DataFrame:
    """lists (query_id, sub_idx, key, rank, fusion_score): -> (query_id, key, pool_rank, origins,
    pool_fusion_score, keep: of the first copy). Rank by rank over the sub-queries in turn; a key's first
    copy takes its place, later ones add their origin and score; keys that come after the cap are dropped."""
    at = F.struct("rank", "sub_idx")
    keys = lists.groupBy("query_id", "key").agg(F.min(at).alias("first"), F.array_sort(F.collect_set("sub_idx")).alias("origins"), F.round(F.sum("fusion_score"), 9).alias("pool_fusion_score"), *(F.min_by(c, at).alias(c) for c in keep))
    order = Window.partitionBy("query_id").orderBy("first.rank", "first.sub_idx", "key")
    return keys.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= cap).drop("first")


def prepend(lists: DataFrame, scoped: DataFrame, keys: tuple[str, ...] = ("query_id", "sub_idx")) -> DataFrame:
    """lists (keys, key, rank, fusion_score, dense_rank, bm25_rank), scoped (keys, key, place, fusion_score):
    the scoped rows that a list doesn't have yet go before it, each key once; scoped marks them."""
    first = scoped.groupBy(*keys, "key").agg(F.min("place").alias("place"), F.min_by("fusion_score", "place").alias("fusion_score"))
    fresh = first.join(lists.select(*keys, "key"), [*keys, "key"], "left_anti")
    fresh = fresh.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "key")))
    more = fresh.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("more"))
    after = lists.join(more, list(keys), "left").withColumn("rank", F.col("rank") + F.coalesce("more", F.lit(0)))
    none = F.lit(None).cast("int")
    columns = [*keys, "key", "rank", "fusion_score", "dense_rank", "bm25_rank"]
    return after.select(*columns, F.lit(False).alias("scoped")).unionByName(fresh.select(*keys, "key", "rank", "fusion_score", none.alias("dense_rank"), none.alias("bm25_rank"), F.lit(True).alias("scoped")))


def merge_hops(hops: DataFrame, cap: int = DEFAULTS.hop_chunks) -> DataFrame:
    """hops (query_id, hop, rank, key): the first copy of each key, by hop then rank, at most cap."""
    keys = hops.groupBy("query_id", "key").agg(F.min(F.struct("hop", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.hop", "at.rank", "key")
    merged = keys.withColumn("merged_rank", F.row_number().over(order)).where(F.col("merged_rank") <= cap)
    return merged.select("query_id", "key", F.col("at.hop").alias("hop"), F.col("at.rank").alias("rank"), "merged_rank")


def consensus(rows: DataFrame) -> DataFrame:
    """rows (query_id, dense_rank, bm25_rank, origins): the share on which both arms or two sub-queries
    agree."""
    agreed = (F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull()) | (F.size("origins") >= 2)
    return rows.groupBy("query_id").agg(F.round(F.avg(agreed.cast("int")), 6).alias("consensus"))
