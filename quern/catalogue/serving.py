"""Usage, caches, sessions and windows, in batch form; quern.streaming has the same on streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.catalogue.registry import query
from quern.config import DEFAULTS
from quern.functions import documents, prompts, text as tx
from quern.operators import reuse, serving, usage
from quern.sources import ingest

PRICES = {"input": 0.25, "output": 1.5}


@query("""WITH e AS (SELECT event_id, (CAST(json_extract(props, '$.k') AS BIGINT) * 250000 + round(value * 100)::BIGINT * 1500 + 11000000)::BIGINT AS c FROM events)
SELECT event_id, (c // 10000 + CASE WHEN c % 10000 > 5000 OR (c % 10000 = 5000 AND (c // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 1e6 AS cost FROM e""")
def usage_cost(table, spark):
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").select("event_id", usage.cost({"input": k * 100, "output": F.col("value") * 10}, PRICES, F.lit(1), 0.001, 0.0001).alias("cost"))


@query("""SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS input_tokens, count(*) AS queries, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id""")
def usage_totals(table, spark):
    k = F.get_json_object("props", "$.k").cast("long")
    return table("events").groupBy("user_id").agg(F.sum(k).alias("input_tokens"), F.count(F.lit(1)).alias("queries"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT event_id, count(*) OVER w AS n, count(*) FILTER (event_type = 'error') OVER w AS errors, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def usage_rolling_hour(table, spark):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table("events").select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.count_if(F.col("event_type") == "error").over(w).alias("errors"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("""SELECT hour AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 30 MINUTE, date_trunc('hour', ts) - INTERVAL 30 MINUTE]) AS hour FROM events) WHERE ts >= hour AND ts < hour + INTERVAL 1 HOUR GROUP BY ALL""")
def usage_sliding(table, spark):
    found = usage.rolling(table("events"), "ts", ["event_type"], "1 hour", "30 minutes")
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions_30min(table, spark):
    return usage.sessions(table("events"), "ts", "user_id", DEFAULTS.session_idle).select("user_id", "started", "last_seen", "n")


def lookups(table):
    return table("events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("seq"), "ts")


#: A recursive walk along each key's lookups: n-th misses by key.
CACHE_SQL = """WITH RECURSIVE l AS (SELECT user_id || ':' || event_type AS key, event_id AS seq, epoch_us(ts) AS t FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS i FROM l),
w AS (SELECT key, seq, i, t + 86400000000 AS until, false AS hit FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.seq, o.i, CASE WHEN w.until >= o.t THEN w.until ELSE o.t + 86400000000 END, w.until >= o.t FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
"""


@query(CACHE_SQL + "SELECT key, seq, hit FROM w")
def cache_simulation(table, spark):
    return usage.ttl_cache(lookups(table))


@query(CACHE_SQL + "SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT key) AS size, round(count(*) FILTER (hit) / count(*), 3) AS hit_rate FROM w")
def cache_stats(table, spark):
    return usage.cache_stats(usage.ttl_cache(lookups(table)))


#: Entries of the cache that forgets: fewer than there are keys on any of the data sets.
ENTRIES = 100


@query(f"""WITH RECURSIVE l AS (SELECT user_id || ':' || event_type AS key, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS n FROM events),
p AS (SELECT *, lag(n) OVER (PARTITION BY key ORDER BY n) AS p, row_number() OVER (PARTITION BY key ORDER BY n) AS i FROM l),
d AS (SELECT a.n, count(DISTINCT b.key) AS distance FROM p a JOIN l b ON b.n > a.p AND b.n < a.n GROUP BY a.n),
o AS (SELECT p.*, p IS NOT NULL AND coalesce(distance, 0) < {ENTRIES} AS there FROM p LEFT JOIN d USING (n)),
w AS (SELECT key, seq, i, t + 86400000000 AS until, false AS hit FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.seq, o.i, CASE WHEN o.there AND w.until >= o.t THEN w.until ELSE o.t + 86400000000 END, o.there AND w.until >= o.t FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
SELECT key, seq, hit FROM w""")
def cache_lru(table, spark):
    return reuse.lru_cache(lookups(table), ENTRIES)


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN turn = 6 THEN 503 WHEN regexp_replace(coalesce(t, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') = '' THEN 400 WHEN length(t) > 2000 THEN 422 ELSE 200 END AS status
FROM (SELECT turn, CASE WHEN turn % 4 = 1 THEN ' ' || chr(10) WHEN turn % 4 = 2 THEN repeat(text, 40) ELSE text END AS t FROM conversations WHERE role = 'user')) GROUP BY status""")
def request_validation(table, spark):
    t = F.when(F.col("turn") % 4 == 1, " \n").when(F.col("turn") % 4 == 2, F.repeat("text", 40)).otherwise(F.col("text"))
    return table("conversations").where("role = 'user'").groupBy(serving.status(t, F.col("turn") != 6).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def turns(table):
    """A turn of a service for each event."""
    e = F.col("event_id")
    return table("events").select(
        e, F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("an \"answer\" to "), "event_type").alias("answer"), (e % 900).alias("input_tokens"), F.when(e % 3 > 0, e % 90).alias("rewrite_input_tokens"),
        (e % 70).alias("output_tokens"), F.when(e % 2 > 0, e % 20).alias("reasoning_tokens"), (e % 7).alias("rewrite_output_tokens"), F.when(e % 5 > 0, (e % 8) / 8).alias("est_cost_usd"), F.round("value", 2).alias("total_s"),
        F.when(e % 4 > 0, "model").alias("model"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("error"), (e % 50 == 0).alias("timeout"))


@query("""SELECT event_id, 'an "answer" to ' || event_type AS reply, user_id::VARCHAR AS session_id, event_id % 900 + CASE WHEN event_id % 3 > 0 THEN event_id % 90 ELSE 0 END AS input_tokens,
  event_id % 70 + CASE WHEN event_id % 2 > 0 THEN event_id % 20 ELSE 0 END + event_id % 7 AS output_tokens, event_id % 900 + CASE WHEN event_id % 3 > 0 THEN event_id % 90 ELSE 0 END + event_id % 70 + CASE WHEN event_id % 2 > 0 THEN event_id % 20 ELSE 0 END + event_id % 7 AS total_tokens,
  CASE WHEN event_id % 5 > 0 THEN (event_id % 8) / 8 ELSE 0 END AS cost_usd, coalesce(round(value, 2), 0) AS latency_s, CASE WHEN event_id % 4 > 0 THEN 'model' ELSE '' END AS model FROM events""")
def chat_replies(table, spark):
    rows = turns(table)
    return rows.select("event_id", F.col("answer").alias("reply"), "session_id", serving.stats(rows).alias("s")).select("event_id", "reply", "session_id", "s.*")


@query("""SELECT 'query_usage {"event_id":' || event_id || ',"session_id":"' || user_id || '","input_tokens":' || event_id % 900 || ',"rewrite_input_tokens":' || CASE WHEN event_id % 3 > 0 THEN (event_id % 90)::VARCHAR ELSE 'null' END || '}' AS value FROM events""")
def usage_lines(table, spark):
    return serving.usage_lines(turns(table).select("event_id", "session_id", "answer", "input_tokens", "rewrite_input_tokens"))


@query("""SELECT CASE WHEN v IN ('up', 'down') THEN 200 ELSE 422 END AS status, CASE WHEN v IN ('up', 'down') THEN 'feedback_log {"ts":"t","session_id":"' || left(repeat(event_id || '-', 9), 36) || '","verdict":"' || v || '","question":"' || left(repeat(event_type || ' ', 120), 500) || '","answer_excerpt":""}' END AS value
FROM (SELECT *, (list_value('up', 'down', 'left', NULL))[(event_id % 4 + 1)::BIGINT] AS v FROM events)""")
def feedback_lines(table, spark):
    e = F.col("event_id")
    verdict = F.when(e % 4 == 0, "up").when(e % 4 == 1, "down").when(e % 4 == 2, "left")
    return serving.feedback_lines(table("events").select(F.lit("t").alias("ts"), F.repeat(F.concat(e.cast("string"), F.lit("-")), 9).alias("session_id"), verdict.alias("verdict"), F.repeat(F.concat("event_type", F.lit(" ")), 120).alias("question"), F.lit(None).cast("string").alias("answer_excerpt")))


#: Each user's events are what a stream of a session brings: errors end it, and every fifteenth event is its end.
ITEMS_SQL = """i AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 15 = 0 THEN 'done' ELSE 'delta' END AS kind, CASE WHEN event_id % 15 = 0 AND event_type <> 'error' THEN '{"n":' || event_id || '}' ELSE event_type || ' ' END AS payload FROM events)"""


def items(table):
    e, end = F.col("event_id"), (F.col("event_id") % 15 == 0) & (F.col("event_type") != "error")
    kind = F.when(F.col("event_type") == "error", "error").when(end, "done").otherwise("delta")
    payload = F.when(end, F.concat(F.lit('{"n":'), e.cast("string"), F.lit("}"))).otherwise(F.concat("event_type", F.lit(" ")))
    return table("events").select(F.col("user_id").cast("string").alias("session_id"), e.alias("seq"), kind.alias("kind"), payload.alias("payload"))


@query(f"""WITH {ITEMS_SQL}, e AS (SELECT *, coalesce(max((kind <> 'delta')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM i)
SELECT session_id, min(seq) - 1 AS seq, 'event: session' || chr(10) || 'data: {{"session_id":"' || session_id || '"}}' || chr(10) || chr(10) AS frame FROM i GROUP BY session_id
UNION ALL SELECT session_id, seq, 'event: ' || kind || chr(10) || 'data: ' || CASE kind WHEN 'delta' THEN '{{"text":"' || payload || '"}}' WHEN 'error' THEN '{{"detail":"' || payload || '"}}' ELSE '{{"stats":' || payload || '}}' END || chr(10) || chr(10) FROM e WHERE ended = 0""")
def event_frames(table, spark):
    return serving.event_frames(items(table))


@query(f"""WITH {ITEMS_SQL} SELECT session_id, arg_max(payload, seq) FILTER (kind = 'done') AS done, CASE WHEN count(*) FILTER (kind = 'done') = 0 THEN coalesce(string_agg(payload, '' ORDER BY seq) FILTER (kind = 'delta'), '') END AS answer FROM i GROUP BY session_id""")
def stream_reduced(table, spark):
    return serving.reduced(items(table))


@query("""SELECT user_id::VARCHAR AS session_id, max(ts) AS last_access, count(*) AS requests FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-14 12:00:00'""")
def active_sessions(table, spark):
    return serving.active(turns(table), F.lit("2024-01-15 12:00:00").cast("timestamp"), "24 hours")


@query("""WITH t AS (SELECT *, event_type = 'error' AS error, round(value, 2) AS latency, CASE WHEN event_id % 5 > 0 THEN (event_id % 8) / 8 END AS cost FROM events),
r AS (SELECT * FROM (SELECT * FROM t ORDER BY ts DESC LIMIT 2000) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
l AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS pos, count(*) OVER () AS n FROM r WHERE latency IS NOT NULL)
SELECT (SELECT count(*) FROM t) AS queries, (SELECT count(*) FROM t WHERE error) AS errors, (SELECT count(*) FROM t WHERE event_id % 50 = 0) AS timeouts, (SELECT sum(event_id % 900)::BIGINT FROM t) AS input_tokens, (SELECT sum(event_id % 70)::BIGINT FROM t) AS output_tokens, (SELECT round(sum(cost), 4) FROM t) AS cost_usd,
  (SELECT count(*) FROM r) AS hour_queries, (SELECT count(*) FROM r WHERE error) AS hour_errors, (SELECT round(coalesce(sum(cost), 0), 4) FROM r) AS hour_cost_usd,
  (SELECT round(max(latency), 3) FROM l WHERE pos = round_even(0.5 * (n - 1), 0)) AS hour_p50, (SELECT round(max(latency), 3) FROM l WHERE pos = round_even(0.95 * (n - 1), 0)) AS hour_p95""")
def service_metrics(table, spark):
    rows = turns(table).withColumns({"latency_s": F.col("total_s"), "cost_usd": F.col("est_cost_usd")})
    now = rows.agg(F.max("ts")).first()[0]
    return serving.metrics(rows, F.lit(now))


@query("SELECT event_id, event_type FROM (SELECT * FROM events WHERE contains(event_id::VARCHAR, '3') AND event_type = 'click' ORDER BY event_id LIMIT 20)")
def golden_filter(table, spark):
    rows = table("events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("category"), F.col("event_id").alias("seq"), "event_id", "event_type")
    return ingest.picked(rows, "3", "click", 20).select("event_id", "event_type")


@query("SELECT page_id, contains(url, 'http') AND NOT contains(url, '/fr/') AND NOT contains(url, '1') AS kept FROM pages")
def url_filter(table, spark):
    return table("pages").select("page_id", ingest.kept_urls(F.col("url"), "http", ("/fr/", "1")).alias("kept"))


@query("SELECT o_orderkey, 'https://x.org/outlines/' || year(o_orderdate) || '30' || o_custkey AS url FROM orders")
def outline_urls(table, spark):
    return table("orders").select("o_orderkey", documents.outline_url(F.lit("https://x.org/"), F.concat(F.year("o_orderdate").cast("string"), F.lit("30")), F.col("o_custkey").cast("string")).alias("url"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'one ' || conv_id || ' two' ELSE 'x' END AS text FROM conversations""")
def message_text(table, spark):
    told = F.concat(F.lit('["one ", {"type": "text", "text": "'), F.col("conv_id").cast("string"), F.lit('"}, " two", {"type": "image"}]'))
    content = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, told).otherwise('[{"text": "x"}]')
    return table("conversations").select("conv_id", "turn", tx.message_of_json(content).alias("text"))


@query("""SELECT conv_id, turn, 'Which codes does the answer say that {question} teaches, and which that they only approve? Reply as JSON:' || chr(10) || '{"taught": ["..."], "reviewed": ["..."]}' || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(text, '') AS prompt FROM conversations""")
def prompt_render(table, spark):
    return table("conversations").select("conv_id", "turn", prompts.render(prompts.ROLES, person="{question}", answer=F.col("text")).alias("prompt"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 40")
def ui_messages(table, spark):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table("conversations").withColumn("back", back).where("back <= 40").select("conv_id", "turn", "role")
