"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.llm.common import materialise


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _stars(pairs: DataFrame) -> DataFrame:
    """For each (u, v), v and the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _tidy(a: str, b: str, stars: DataFrame) -> DataFrame:
    return stars.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): -> (node, component), one row for each node that has a link, component being the
    least node that is reachable. Each round is a written table; the least of a node's neighbours is
    found by partial aggregation and joined back, so a node of very many links is no bottleneck. The
    number of rounds grows with the logarithm of the number of nodes."""
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a node that has several lesser neighbours hands all but the least on to that one: what many nodes
    # say of the same centres is then said once
    least = links.groupBy(F.struct("b").alias("of")).agg(F.min("a").alias("m"))
    told = links.withColumn("of", F.struct("b")).join(least, "of")
    other = F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a"))
    links = materialise(told.select(F.least("m", other).alias("a"), F.greatest("m", other).alias("b")).distinct(), "handed-on")
    state = None
    while state != (now := _state(links)):
        state = now
        if not now[0]:
            break
        large = _stars(_both_ways(links)).where("v > u")
        large = _tidy("v", "m", large)
        small = _stars(large.select(F.col("b").alias("u"), F.col("a").alias("v")))
        centre = small.select("u", "m").distinct().withColumnRenamed("u", "v")
        links = materialise(_tidy("v", "m", small.select("v", "m").unionByName(centre)), "components")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
