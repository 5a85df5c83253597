"""Usage records: cost, totals, caches, mined questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.config import DEFAULTS
from quern.functions.text import normalise_question
from quern.operators.numbering import numbered


def cost(tokens: dict[str, Column], prices: dict[str, float], calls: Column | None = None, fee: float = 0.0, flat: float = 0.0) -> Column:
    """Tokens by role times the price of a million, a fee for each call and a flat one, to 6 places."""
    total = F.lit(flat)
    for role, n in tokens.items():
        total = total + F.coalesce(n, F.lit(0)) * prices[role] / 1e6
    if calls is not None:
        total = total + calls * fee
    return F.bround(total.cast("decimal(28,10)"), 6).cast("double")  # of a decimal, so that halves are halves


def ttl_cache(lookups: DataFrame, seconds: int = DEFAULTS.cache_seconds) -> DataFrame:
    """lookups (key, ts, seq): -> with hit. A miss stores the key for `seconds`; hits don't prolong it, so
    the next miss is the first lookup over `seconds` after the last one. That is a walk along one key's
    lookups, done in their order with a single stored time for each key."""
    kind = {c: lookups.schema[c].dataType.simpleString() for c in ("key", "seq")}
    rows = lookups.select("key", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition("key").sortWithinPartitions("key", "at", "seq")

    def walk(batches):
        import pyarrow as pa

        key, until = object(), 0
        for batch in batches:
            hits = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    key, until = k, -1
                hits.append(until >= at)
                if not hits[-1]:
                    until = at + seconds * 1_000_000
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.bool_())], ["key", "seq", "hit"])

    return rows.mapInArrow(walk, f"key {kind['key']}, seq {kind['seq']}, hit boolean")


def cache_stats(walked: DataFrame) -> DataFrame:
    return walked.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_distinct("key").alias("size"), F.round(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), 3).alias("hit_rate"))


def lru(lookups: list[tuple], most: int = DEFAULTS.cache_entries, seconds: int = DEFAULTS.cache_seconds) -> list[bool]:
    """(key, at) in order: hits of a cache of `most` entries, in which a hit renews an entry's place but not
    its time. Global by nature, so it is a simulation on one machine of a bounded trace."""
    held: dict = {}
    out = []
    for key, at in lookups:
        until = held.pop(key, None)
        hit = until is not None and until >= at
        held[key] = until if hit else at + seconds
        out.append(hit)
        if len(held) > most:
            del held[next(iter(held))]
    return out


def mined(questions: DataFrame, known: DataFrame, downs: DataFrame) -> DataFrame:
    """questions (question, ts, failed, seq, ...), known (question), downs (question): -> candidates for a
    golden set, grouped by normalised question, without known and empty ones: (candidate, key, n,
    first_seen, last_seen, down, failed, first: the fields of the first row), those that were voted down
    first, then failed ones, then frequent ones."""
    keys = lambda df: df.select(normalise_question(F.col("question")).alias("key")).distinct()
    keyed = questions.withColumn("key", normalise_question(F.col("question"))).where("key <> ''")
    new = keyed.join(keys(known), "key", "left_anti")
    first = F.min_by(F.struct(*questions.columns), F.struct("ts", "seq")).alias("first")
    of = new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("failed").alias("failed"), first)
    of = of.join(keys(downs).withColumn("down", F.lit(1)), "key", "left").withColumn("down", F.coalesce("down", F.lit(0)))
    placed = numbered(of, [F.desc("down"), F.desc("failed"), F.desc("n"), "last_seen", "key"], name="_place", written="candidates")
    return placed.withColumn("candidate", F.format_string("cand-%03d", F.col("_place") + 1)).drop("_place")


def rolling(events: DataFrame, ts: str, by: list[str], length: str, every: str) -> DataFrame:
    """Counts, errors and value by sliding windows; the same on a batch and on a stream."""
    return events.groupBy(F.window(ts, length, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))


def sessions(events: DataFrame, ts: str, by: str, idle: str) -> DataFrame:
    """Activity without a longer pause than idle; the same on a batch and on a stream."""
    return events.groupBy(F.session_window(ts, idle).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("last_seen"))
