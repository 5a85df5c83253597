"""What a service writes: replies, event streams, usage and feedback lines, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.config import DEFAULTS
from quern.functions.text import uuid5

USAGE, FEEDBACK = "query_usage ", "feedback_log "
VERDICTS = ("up", "down")


def status(message: Column, ready: Column, most: int = DEFAULTS.question_chars) -> Column:
    """503 before the service is ready, 400 for a blank message, 422 for one that is too long, else 200."""
    blank = F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)\s+", "") == ""
    return F.when(~ready, 503).when(blank, 400).when(F.length(message) > most, 422).otherwise(200)


def stats(meta: DataFrame) -> Column:
    """struct: the tokens (those of the controller aren't counted), cost, latency and model of a turn."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    tokens_in = n("input_tokens") + n("rewrite_input_tokens")
    tokens_out = n("output_tokens") + n("reasoning_tokens") + n("rewrite_output_tokens")
    return F.struct(tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), (tokens_in + tokens_out).alias("total_tokens"), F.coalesce("est_cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("total_s", F.lit(0.0)).alias("latency_s"), F.coalesce("model", F.lit("")).alias("model"))


def replies(meta: DataFrame) -> DataFrame:
    """meta (session_id, answer, and what stats() reads): (reply, session_id, stats)."""
    return meta.select(F.col("answer").alias("reply"), "session_id", stats(meta).alias("stats"))


def usage_lines(meta: DataFrame) -> DataFrame:
    """(value): a log line of a turn without its answer and documents; nulls stay."""
    columns = [c for c in meta.columns if c not in ("answer", "docs")]
    return meta.select(F.concat(F.lit(USAGE), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("value"))


def feedback_lines(requests: DataFrame) -> DataFrame:
    """requests (ts, session_id, verdict, question, answer_excerpt): (status, value): 422 and no line unless the
    verdict is known; texts are cut."""
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c)
    record = F.struct(F.col("ts").cast("string").alias("ts"), cut("session_id", 36), "verdict", cut("question", 500), cut("answer_excerpt", 1000))
    fine = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    return requests.select(F.when(fine, 200).otherwise(422).alias("status"), F.when(fine, F.concat(F.lit(FEEDBACK), F.to_json(record))).alias("value"))


def sse(event: Column, data: Column) -> Column:
    """A frame of server-sent events; data: JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def event_frames(items: DataFrame) -> DataFrame:
    """items (session_id, seq, kind: delta, done or error, payload: text or stats as JSON): -> (session_id, seq,
    frame): the session, then what came, up to the first error or end."""
    text = lambda name, c: F.to_json(F.struct(c.alias(name)))
    first = items.groupBy("session_id").agg((F.min("seq") - 1).alias("seq")).select("session_id", "seq", sse(F.lit("session"), text("session_id", F.col("session_id"))).alias("frame"))
    ended = F.coalesce(F.max((F.col("kind") != "delta").cast("int")).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    data = F.when(F.col("kind") == "delta", text("text", F.col("payload"))).when(F.col("kind") == "error", text("detail", F.col("payload"))).otherwise(F.concat(F.lit('{"stats":'), "payload", F.lit("}")))
    rest = items.withColumn("ended", ended).where("ended = 0").select("session_id", "seq", sse(F.col("kind"), data).alias("frame"))
    return first.unionByName(rest)


def reduced(items: DataFrame) -> DataFrame:
    """items (session_id, seq, kind, payload): -> (session_id, done, answer): the last end's payload, or else
    the deltas as one text."""
    told = F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "payload"))))
    done = F.max_by(F.when(F.col("kind") == "done", F.col("payload")), F.when(F.col("kind") == "done", F.col("seq")))
    of = items.groupBy("session_id").agg(done.alias("done"), told.alias("t"))
    return of.select("session_id", "done", F.when(F.col("done").isNull(), F.array_join(F.transform("t", lambda x: x["payload"]), "")).alias("answer"))


def with_session(requests: DataFrame, request_id: str = "request_id") -> DataFrame:
    """requests (session_id): those without one get an id by their own."""
    made = uuid5(F.concat(F.lit("session:"), F.col(request_id).cast("string")))
    return requests.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), made))


def active(requests: DataFrame, now: Column, idle: str = DEFAULTS.session_idle) -> DataFrame:
    """requests (session_id, ts): the sessions whose last request by `now` isn't older than idle."""
    last = requests.where(F.col("ts") <= now).groupBy("session_id").agg(F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("requests"))
    return last.where(F.col("last_access") >= now - F.expr(f"interval {idle}"))


def metrics(turns: DataFrame, now: Column, most: int = 2000) -> DataFrame:
    """turns (ts, error, timeout, latency_s, cost_usd, input_tokens, output_tokens): one row of totals, and of the
    hour before `now` among the last `most` turns; of turns of one time those that come first in the other columns."""
    ties = ("error", "timeout", "latency_s", "cost_usd", "input_tokens", "output_tokens")
    recent = turns.select("ts", *ties).orderBy(F.desc("ts"), *ties).limit(most).where(F.col("ts") >= now - F.expr("interval 1 hour"))
    totals = turns.agg(F.count(F.lit(1)).alias("queries"), F.count_if("error").alias("errors"), F.count_if("timeout").alias("timeouts"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    at = lambda q: F.round(F.get(F.col("l"), F.bround(q * (F.size("l") - 1)).cast("int")), 3)
    hour = recent.agg(F.count(F.lit(1)).alias("hour_queries"), F.count_if("error").alias("hour_errors"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("hour_cost_usd"), F.array_sort(F.collect_list("latency_s")).alias("l"))
    return totals.crossJoin(hour.withColumn("hour_p50", at(0.5)).withColumn("hour_p95", at(0.95)).drop("l"))
