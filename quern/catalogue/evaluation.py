"""Scoring, aggregates, comparisons, relational forms of the lookups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern import models
from quern.catalogue.registry import query
from quern.functions import text as tx
from quern.catalogue.context import HITS_SQL, hits
from quern.config import DEFAULTS
from quern.operators import evaluate, lexical, runs, usage

#: A passage's first sentence is a fact; the answers are all documents of which a passage shares the
#: first word: equi-joined, so that no pair without a common word is made.
FACTS_SQL = "SELECT item_id, trim(string_split(text, '.')[1], ' ') AS fact, lower(string_split(text, ' ')[1]) AS w FROM benchmark WHERE NOT regexp_matches(string_split(text, '.')[1], '[^a-zA-Z0-9, ]')"


@query(f"""WITH f AS ({FACTS_SQL}), d AS (SELECT doc_id, lower(replace(text, ',', '')) AS t, lower(string_split(text, ' ')[1]) AS w FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]|[0-9]-'))
SELECT item_id, doc_id, regexp_matches(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '(^|[^a-z0-9])' || lower(replace(fact, ',', '')) || '([^a-z0-9]|$)') AS hit FROM f JOIN d USING (w)""")
def fact_match(table, spark):
    first = F.split("text", "[.]")[0]
    word = F.lower(F.split("text", " ")[0]).alias("w")
    facts = table("benchmark").where(~first.rlike("[^a-zA-Z0-9, ]")).select("item_id", F.trim(first).alias("fact"), word)
    docs = table("documents").where(~F.col("text").rlike(r"[^\x00-\x7F]|[0-9]-")).select("doc_id", "text", word)
    return docs.join(facts, "w").select("item_id", "doc_id", tx.fact_in(F.col("fact"), F.col("text")).alias("hit"))


@query()
def fact_search(table, spark):
    """The first sentence of every passage in all documents; DuckDB's expressions have no look-around, and
    its lower() isn't Spark's, so there is no SQL."""
    return evaluate.fact_hits(table("benchmark").select("item_id", F.split("text", "[.]")[0].alias("fact")), table("documents").select("doc_id", "text"))


#: A case for each event: facts, addresses and forbidden words by its type and id, an answer that has some of them.
ANSWER_SQL = "'The fee is 6,000; see ' || event_type || ' on July 2nd. Sources: https://x.org/' || event_type || '/. and https://x.org/' || (event_id % 5) || ', https://X.org/a'"


def cases(table):
    """Dealt to all cores: a row is some bytes and much work, and a large table may be a file of few parts."""
    events = table("events").select("event_id", "event_type")
    events = events.repartition(4 * events.sparkSession.sparkContext.defaultParallelism)
    e, k = F.col("event_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    answer = F.concat(F.lit("The fee is 6,000; see "), k, F.lit(" on July 2nd. Sources: https://x.org/"), k, F.lit("/. and https://x.org/"), text(e % 5), F.lit(", https://X.org/a"))
    url = lambda c: F.concat(F.lit("https://x.org/"), c)
    none = F.array().cast("array<array<string>>")
    expected = F.when(e % 7 == 0, none).otherwise(F.array(F.array(url(text(e % 3)), url(text(e % 4))), F.array(url(F.lit("A/")))))
    facts = F.when(e % 5 == 0, none).otherwise(F.array(F.array(F.lit("6000"), F.lit("free")), F.array(F.lit("july 2")), F.array(F.lit("view")), F.array(text(e % 9))))
    forbidden = F.when(e % 2 == 0, none).otherwise(F.array(F.array(F.lit("click"), F.lit("no fee")), F.array(F.lit("600"))))
    retrieved = F.array(url(text(e % 4)), F.lit(" https://x.org/A/ "), F.lit(None).cast("string"), url(text(e % 4)), F.concat(url(k), F.lit("/")))
    return events.select("event_id", answer.alias("answer"), retrieved.alias("retrieved"), expected.alias("expected"), facts.alias("facts"), forbidden.alias("forbidden"))


SCORED_SQL = f"""c AS (SELECT event_id, event_type AS k, {ANSWER_SQL} AS answer, event_id % 3 AS e3, event_id % 4 AS e4, event_id % 5 AS e5, event_id % 7 AS e7, event_id % 9 AS e9, event_id % 2 AS odd FROM events),
h AS (SELECT *, (e3 = e4 OR FALSE) AS same, CASE WHEN e7 = 0 THEN NULL ELSE e3 = e4 OR e4 = e4 END AS u1, CASE WHEN e7 = 0 THEN NULL ELSE TRUE END AS u2,
  CASE WHEN e5 = 0 THEN NULL ELSE k = 'view' END AS f3, CASE WHEN e5 = 0 THEN NULL ELSE e9 = 2 OR e9 = e5 END AS f4, CASE WHEN odd = 0 THEN NULL ELSE k = 'click' END AS b1 FROM c)"""


@query(f"""WITH {SCORED_SQL}
SELECT event_id, CASE WHEN e7 = 0 THEN NULL ELSE 1.0::DOUBLE END AS url_hit_fraction, CASE WHEN e7 = 0 THEN NULL ELSE TRUE END AS url_full_hit, '' AS urls_missed,
  (2 + f3::INT + f4::INT) / 4 AS fact_recall, concat_ws('|', CASE WHEN NOT f3 THEN 'view' END, CASE WHEN NOT f4 THEN e9::VARCHAR END) AS facts_missed,
  1 - (b1::INT + 0) / 2 AS avoidance, CASE WHEN b1 THEN 'click' ELSE '' END AS forbidden_present, 3 AS n_cited, round((CASE WHEN e5 = e4 THEN 1 ELSE 0 END) / 3, 6) AS citation_precision,
  'https://x.org/' || e4 || '|https://x.org/a|https://x.org/' || k AS retrieved_urls FROM h""")
def score_cases(table, spark):
    rows = cases(table).select("event_id", runs.scores(*(F.col(c) for c in ("answer", "retrieved", "expected", "facts", "forbidden"))).alias("s")).select("event_id", "s.*")
    joined = {c: F.array_join(c, "|") for c in ("urls_missed", "facts_missed", "forbidden_present", "retrieved_urls")}
    return rows.withColumns(joined | {"citation_precision": F.round("citation_precision", 6), "n_cited": F.col("n_cited").cast("long")})


#: A run: a case for each event, with all that its metrics need.
RUN_SQL = """r AS (SELECT event_id AS id, event_type AS category, CASE WHEN event_id % 17 = 0 THEN 'E: 429 quota' WHEN event_id % 19 = 0 THEN 'KeyError' END AS error,
  CASE WHEN event_id % 5 > 0 THEN (event_id % 4) / 3 END AS url_hit_fraction, CASE WHEN event_id % 5 > 0 THEN event_id % 4 = 3 END AS url_full_hit, CASE WHEN event_id % 3 > 0 THEN (event_id % 5) / 4 END AS fact_recall,
  CASE WHEN event_id % 2 > 0 THEN (event_id % 3) / 2 END AS avoidance, event_id % 6 = 0 AS has_forbidden, event_id % 4 AS n_cited, CASE WHEN event_id % 4 > 0 THEN (event_id % 7) / 6 END AS citation_precision,
  CASE WHEN event_id % 8 > 0 THEN user_id * 10 + event_id % 100 END AS input_tokens, event_id % 50 AS output_tokens, event_id % 11 AS rewrite_input_tokens, round(value, 2) AS total_s, event_id % 13 AS cost,
  CASE WHEN event_id % 23 = 0 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason, CASE WHEN event_id % 10 < 7 THEN (list_value('retrieve', 'direct', 'refuse'))[(event_id % 3 + 1)::BIGINT] END AS route, event_id % 3 AS graph_hops,
  CASE WHEN event_id % 4 > 0 THEN (list_value('retrieve', 'direct'))[(event_id % 2 + 1)::BIGINT] END AS expected_route, event_id % 9 = 0 AS rerank_skipped FROM events)"""


def run_cases(table):
    e = F.col("event_id")
    pick = lambda *found: F.element_at(F.array(*map(F.lit, found)), (e % len(found) + 1).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    return table("events").select(
        e.alias("id"), F.col("event_type").alias("category"), F.when(e % 17 == 0, "E: 429 quota").when(e % 19 == 0, "KeyError").alias("error"),
        F.when(e % 5 > 0, (e % 4) / 3).alias("url_hit_fraction"), F.when(e % 5 > 0, e % 4 == 3).alias("url_full_hit"), F.when(e % 3 > 0, (e % 5) / 4).alias("fact_recall"),
        F.when(e % 2 > 0, (e % 3) / 2).alias("avoidance"), F.when(e % 6 == 0, F.array(F.lit("x"))).otherwise(F.array()).alias("forbidden_present"), (e % 4).alias("n_cited"), F.when(e % 4 > 0, (e % 7) / 6).alias("citation_precision"),
        F.when(e % 8 > 0, F.col("user_id") * 10 + e % 100).alias("input_tokens"), (e % 50).alias("output_tokens"), (e % 11).alias("rewrite_input_tokens"), F.round("value", 2).alias("total_s"), (e % 13).alias("est_cost_usd"),
        F.when(e % 23 == 0, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"), F.when(e % 10 < 7, pick("retrieve", "direct", "refuse")).alias("route"), (e % 3).alias("graph_hops"),
        runs.route_ok(F.when(e % 4 > 0, pick("retrieve", "direct")), F.when(e % 10 < 7, pick("retrieve", "direct", "refuse"))).alias("route_ok"), (e % 9 == 0).alias("rerank_skipped"),
        null("boolean").alias("rewrite_skipped"), (e % 29 == 0).alias("decompose_fallback"), (e % 6).alias("n_rerank_calls"), (e % 12).alias("n_context_docs"), (e % 31).alias("reasoning_tokens"), null("long").alias("cache_read_tokens"),
        F.when(e % 3 == 0, (e % 8) / 7).alias("judge_faithfulness"), F.when(e % 3 == 0, (e % 10) / 9).alias("judge_completeness"), F.when(e % 21 == 0, F.array(F.lit("c"))).alias("judge_unsupported_claims"), F.when(e % 37 == 0, "bad").alias("judge_error"),
        (e % 2 + 1).alias("graph_calls"), (e % 400).alias("graph_input_tokens"), (e % 40).alias("graph_output_tokens"))


METRICS_SQL = f"""WITH {RUN_SQL}, s AS (SELECT * FROM (SELECT *, category AS cat FROM r UNION ALL SELECT *, NULL FROM r)),
m AS (SELECT cat, count(*) AS n_cases, count(error) AS n_errors, avg(url_hit_fraction) FILTER (error IS NULL) AS url_hit_rate, avg(fact_recall) FILTER (error IS NULL) AS fact_recall, avg(avoidance) FILTER (error IS NULL) AS avoidance,
  avg(citation_precision) FILTER (error IS NULL) AS citation_precision, avg(input_tokens) FILTER (error IS NULL) AS input_tokens_mean, avg(output_tokens) FILTER (error IS NULL) AS output_tokens_mean,
  avg(id % 31) FILTER (error IS NULL) AS reasoning_tokens_mean, NULL::DOUBLE AS cache_read_tokens_mean, avg(cost) FILTER (error IS NULL) AS est_cost_usd_mean,
  avg(CASE WHEN id % 3 = 0 THEN (id % 8) / 7 END) FILTER (error IS NULL) AS judge_faithfulness_mean, avg(CASE WHEN id % 3 = 0 THEN (id % 10) / 9 END) FILTER (error IS NULL) AS judge_completeness_mean,
  avg(id % 12) FILTER (error IS NULL) AS n_context_docs_mean, avg(id % 6) FILTER (error IS NULL) AS rerank_calls_mean, avg(id % 2 + 1) FILTER (error IS NULL) AS graph_calls_mean,
  avg(id % 400) FILTER (error IS NULL) AS graph_input_tokens_mean, avg(id % 40) FILTER (error IS NULL) AS graph_output_tokens_mean, avg(url_full_hit::INT) FILTER (error IS NULL) AS url_full_hit_rate,
  count(*) FILTER (error IS NULL AND has_forbidden) AS n_cases_with_forbidden, count(*) FILTER (error IS NULL AND n_cited = 0) AS n_answers_without_citation,
  avg(coalesce(input_tokens, 0) + rewrite_input_tokens) FILTER (error IS NULL) AS input_tokens_with_rewrite_mean, (sum(cost) FILTER (error IS NULL))::BIGINT AS est_cost_usd_total,
  count(*) FILTER (error IS NULL AND finish_reason = 'MAX_TOKENS') AS max_tokens_truncations, count(*) FILTER (error IS NULL AND id % 29 = 0) AS decompose_fallbacks,
  count(*) FILTER (error IS NULL AND id % 21 = 0) AS judge_flagged_cases, count(*) FILTER (error IS NULL AND id % 37 = 0) AS judge_errors,
  avg(rerank_skipped::INT) FILTER (error IS NULL) AS rerank_skip_rate, avg(0) FILTER (error IS NULL) AS rewrite_skip_rate, avg((graph_hops > 0)::INT) FILTER (error IS NULL AND route IS NOT NULL) AS hop_rate,
  avg(graph_hops) FILTER (error IS NULL AND route IS NOT NULL) AS graph_hops_mean, count(*) FILTER (error IS NULL AND route <> expected_route) AS route_mismatches,
  count(*) FILTER (error IS NULL AND route IS NOT NULL AND expected_route IS NOT NULL) AS n_cases_with_expected_route,
  'direct ' || count(*) FILTER (error IS NULL AND route = 'direct') || ', refuse ' || count(*) FILTER (error IS NULL AND route = 'refuse') || ', retrieve ' || count(*) FILTER (error IS NULL AND route = 'retrieve') AS route_counts FROM s GROUP BY cat),
t AS (SELECT cat, max(input_tokens) FILTER (pos = round_even(0.5 * (n - 1), 0)) AS input_tokens_p50 FROM (SELECT cat, input_tokens, row_number() OVER (PARTITION BY cat ORDER BY input_tokens) - 1 AS pos, count(*) OVER (PARTITION BY cat) AS n FROM s WHERE error IS NULL AND input_tokens IS NOT NULL) GROUP BY cat),
l AS (SELECT cat, max(total_s) FILTER (pos = round_even(0.5 * (n - 1), 0)) AS latency_p50_s, max(total_s) FILTER (pos = round_even(0.95 * (n - 1), 0)) AS latency_p95_s FROM (SELECT cat, total_s, row_number() OVER (PARTITION BY cat ORDER BY total_s) - 1 AS pos, count(*) OVER (PARTITION BY cat) AS n FROM s WHERE error IS NULL AND total_s IS NOT NULL) GROUP BY cat),
j AS (SELECT m.*, input_tokens_p50, latency_p50_s, latency_p95_s FROM m LEFT JOIN t ON m.cat IS NOT DISTINCT FROM t.cat LEFT JOIN l ON m.cat IS NOT DISTINCT FROM l.cat)"""
DOUBLES = ("url_hit_rate", "fact_recall", "avoidance", "citation_precision", "input_tokens_mean", "output_tokens_mean", "reasoning_tokens_mean", "est_cost_usd_mean", "judge_faithfulness_mean", "judge_completeness_mean", "n_context_docs_mean", "rerank_calls_mean",
           "graph_calls_mean", "graph_input_tokens_mean", "graph_output_tokens_mean", "url_full_hit_rate", "input_tokens_with_rewrite_mean", "rerank_skip_rate", "rewrite_skip_rate", "hop_rate", "graph_hops_mean")
OTHERS = ("n_cases", "n_errors", "cache_read_tokens_mean", "n_cases_with_forbidden", "n_answers_without_citation", "est_cost_usd_total", "max_tokens_truncations", "decompose_fallbacks", "judge_flagged_cases", "judge_errors", "route_mismatches", "n_cases_with_expected_route",
          "route_counts", "input_tokens_p50", "latency_p50_s", "latency_p95_s")


@query(f"{METRICS_SQL} SELECT cat AS category, {', '.join(f'round({c}, 6) AS {c}' for c in DOUBLES)}, {', '.join(OTHERS)} FROM j")
def run_metrics(table, spark):
    """All metrics of a run, by category and over all."""
    found = runs.aggregate(run_cases(table))
    counts = F.array_join(F.transform(F.map_entries("route_counts"), lambda x: F.concat_ws(" ", x["key"], x["value"].cast("string"))), ", ")
    return found.withColumn("route_counts", counts).select("category", *(F.round(c, 6).alias(c) for c in DOUBLES), *OTHERS)


@query(f"WITH {RUN_SQL} SELECT category, route, count(*) AS n FROM r WHERE error IS NULL AND route IS NOT NULL GROUP BY ALL")
def route_counts(table, spark):
    return runs.route_counts(run_cases(table), "category")


@query(f"WITH {RUN_SQL} SELECT id, error, contains(error, '429') AS again, CASE WHEN contains(error, '429') THEN 20 * (id % 3 + 1) END AS wait FROM r WHERE error IS NOT NULL")
def retry_errors(table, spark):
    rows = run_cases(table).where("error is not null")
    again = runs.retryable(F.col("error"))
    return rows.select("id", "error", again.alias("again"), F.when(again, runs.retry_wait(F.col("id") % 3)).alias("wait"))


#: The scores of cases that were stored with other ones: every third case has no golden one, some have errors, cut answers or no addresses.
@query(f"""WITH {SCORED_SQL}, g AS (SELECT *, event_id % 3 <> 1 AS known, event_id % 8 = 0 AS bad, event_id % 6 = 0 AS cut, event_id % 10 = 3 AS unstored, (event_id % 5) / 4 AS old_f, 0.5 AS old_u FROM h),
n AS (SELECT *, known AND NOT bad AS again, CASE WHEN known AND NOT bad THEN (2 + f3::INT + f4::INT) / 4 ELSE old_f END AS new_f, CASE WHEN known AND NOT bad AND NOT unstored AND e7 > 0 THEN 1.0 ELSE old_u END AS new_u FROM g)
SELECT event_id AS id, 'missing' AS what, NULL::DOUBLE AS before, NULL::DOUBLE AS after FROM n WHERE NOT known
UNION ALL SELECT event_id, CASE WHEN cut THEN 'truncated' ELSE 'changed' END, old_f, new_f FROM n WHERE again AND abs(new_f - old_f) > 1e-9
UNION ALL SELECT event_id, 'mismatch', old_u, new_u FROM n WHERE again AND abs(new_u - old_u) > 1e-9""")
def rescore_changes(table, spark):
    e = F.col("event_id")
    rows = cases(table)
    answer = F.when(e % 6 == 0, F.rpad("answer", runs.EXCERPT, ".")).otherwise(F.col("answer"))
    stored = rows.select(
        e.alias("id"), F.lit("c").alias("category"), F.when(e % 8 == 0, "KeyError").alias("error"), answer.alias("answer_excerpt"), F.when(e % 10 != 3, F.col("retrieved")).alias("retrieved_urls"),
        ((e % 5) / 4).alias("fact_recall"), F.lit(0.5).alias("url_hit_fraction"), F.lit(None).cast("boolean").alias("url_full_hit"), F.lit(None).cast("double").alias("avoidance"), F.lit(None).cast("double").alias("citation_precision"), F.lit(0).alias("n_cited"),
        *(F.array().cast("array<string>").alias(c) for c in ("facts_missed", "urls_missed", "forbidden_present")))
    golden = rows.where("event_id % 3 <> 1").select(e.alias("id"), "expected", "facts", "forbidden")
    return runs.rescore_changes(runs.rescored(stored, golden)).drop("category")


#: What is said of a customer's orders: the parts of the even lines, and one that isn't theirs; the truth: those with a discount.
@query("""WITH l AS (SELECT o_custkey AS c, l_partkey % 40 AS p, l_linenumber % 2 = 0 AS said, l_discount > 0.05 AS told FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT c, list_sort(list(DISTINCT p) FILTER (said)) AS said, list_sort(list(DISTINCT p) FILTER (told)) AS truth FROM l GROUP BY c),
n AS (SELECT c, coalesce(said, []) AS said, coalesce(truth, []) AS truth FROM s),
h AS (SELECT c, len(list_intersect(said, truth)) AS hit, len(said) AS m, len(truth) AS t FROM n),
p AS (SELECT *, CASE WHEN t > 0 THEN hit / t END AS r, CASE WHEN m > 0 THEN hit / m WHEN t = 0 THEN 1 ELSE 0 END AS pr FROM h)
SELECT c AS id, hit AS correct, m - hit AS invented, t - hit AS missed, round(r, 6) AS recall, round(pr, 6) AS precision, round(CASE WHEN t = 0 THEN CASE WHEN m = 0 THEN 1 ELSE 0 END WHEN pr + r > 0 THEN 2 * pr * r / (pr + r) ELSE 0 END, 4) AS f1, m = hit AND t = hit AS exact FROM p""")
def people_scores(table, spark):
    lines = table("lineitem").join(table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id")), "l_orderkey")
    part = F.col("l_partkey") % 40
    sets = lines.groupBy("id").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, part)).alias("said"), F.collect_set(F.when(F.col("l_discount") > 0.05, part)).alias("truth"))
    found = runs.people_scores(F.col("said"), F.col("truth"))
    n = lambda c: F.size(found[c]).cast("long").alias(c)
    return sets.select("id", n("correct"), found["invented"].cast("long").alias("invented"), n("missed"), F.round(found["recall"], 6).alias("recall"), F.round(found["precision"], 6).alias("precision"), found["f1"].alias("f1"), found["exact"].alias("exact"))


@query("""WITH p AS (SELECT *, event_id % 4 = 0 AS naming, CASE WHEN event_id % 9 > 0 THEN (event_id % 6) / 5 END AS r, (event_id % 3) / 2 AS pr FROM events)
SELECT event_type AS label, count(*) FILTER (event_id % 13 <> 0) AS n, count(*) FILTER (event_id % 13 = 0) AS n_errors, round(avg(r) FILTER (event_id % 13 <> 0 AND NOT naming), 4) AS recall, round(avg(pr) FILTER (event_id % 13 <> 0 AND NOT naming), 4) AS precision,
  round(avg(pr) FILTER (event_id % 13 <> 0 AND NOT naming), 4) AS f1, round(avg(event_id % 2) FILTER (event_id % 13 <> 0 AND naming), 4) AS name_hit, count(*) FILTER (event_id % 13 <> 0 AND naming) AS n_name_cases,
  (sum(CASE WHEN event_id % 13 <> 0 AND naming THEN event_id % 3 ELSE 0 END))::BIGINT AS named_instead, (sum(CASE WHEN event_id % 13 <> 0 AND NOT naming THEN event_id % 5 ELSE 0 END))::BIGINT AS invented,
  count(*) FILTER (event_id % 13 <> 0 AND NOT naming AND event_id % 7 = 0) AS exact_sets, count(*) FILTER (event_id % 13 <> 0 AND NOT naming) AS n_teach_cases FROM p GROUP BY event_type""")
def people_aggregate(table, spark):
    e = F.col("event_id")
    naming = e % 4 == 0
    rows = table("events").select(
        F.col("event_type").alias("label"), F.when(e % 13 == 0, "x").alias("error"), F.when(~naming & (e % 9 > 0), (e % 6) / 5).alias("recall"), F.when(~naming, (e % 3) / 2).alias("precision"), F.when(~naming, (e % 3) / 2).alias("f1"),
        (e % 5).alias("invented"), (e % 7 == 0).alias("exact"), F.when(naming, e % 2).alias("name_hit"), (e % 3).alias("named_other"))
    return runs.people_aggregate(rows, "label")


@query("""SELECT doc_id, CASE WHEN strpos(lower(t), 'ann lee') = 0 THEN NULL WHEN k = 0 OR k = 1 OR k = 2 THEN 'instr' WHEN k = 3 OR k = 4 THEN 'sig' ELSE 'other' END AS role, strpos(lower(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g')), 'ann lee') > 0 AS hit FROM (
  SELECT doc_id, doc_id % 8 AS k, (list_value('### Instructor Details', 'Name | ', '### Instructor ' || chr(10), 'Program Head', 'I verify that it is so Dean', 'by', '', 'Ann' || chr(10) || 'Lee'))[(doc_id % 8 + 1)::BIGINT] || ' ' || CASE WHEN doc_id % 8 >= 6 THEN '' ELSE 'ANN Lee' END || ' ' || text AS t FROM documents)""")
def chunk_roles(table, spark):
    marks = F.array(*map(F.lit, ("### Instructor Details", "Name | ", "### Instructor \n", "Program Head", "I verify that it is so Dean", "by", "", "Ann\nLee")))
    t = F.concat_ws(" ", F.element_at(marks, (F.col("doc_id") % 8 + 1).cast("int")), F.when(F.col("doc_id") % 8 >= 6, "").otherwise("ANN Lee"), "text")
    return table("documents").select("doc_id", runs.chunk_role(t, F.lit("Ann Lee")).alias("role"), runs.name_hit(F.lit("ann  LEE"), t).alias("hit"))


@query(HITS_SQL + """, b AS (SELECT query_id, rank, '[Passage ' || rank || '] ' || lang || chr(10) || left(text, 1500) AS block FROM hits JOIN documents USING (doc_id)),
c AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM b)
SELECT query_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (so_far <= 4000), '(no passages retrieved)') AS context FROM c GROUP BY query_id""")
def judge_context(table, spark):
    rows = table("documents").join(lexical.bounded(hits(table)), "doc_id").select("query_id", "rank", F.col("lang").alias("label"), "text")
    return runs.judge_context(rows, DEFAULTS.judge_doc_chars, 4000)


AGGREGATE_SQL = "count(*) AS cases, round(avg(quality), 6) AS quality_mean, count(quality) AS quality_n, round(avg(toxic), 6) AS toxic_mean, count(toxic) AS toxic_n, count(*) FILTER (quality = 1 AND toxic = 0) AS full_hits"


def aggregates():
    return [F.count(F.lit(1)).alias("cases"), *evaluate.mean("quality"), *evaluate.mean("toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("full_hits")]


@query(f"SELECT {AGGREGATE_SQL} FROM labels")
def eval_aggregate(table, spark):
    return table("labels").agg(*aggregates())


@query(f"SELECT coalesce(lang, 'all') AS category, {AGGREGATE_SQL} FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def eval_by_category(table, spark):
    rows = table("labels").join(table("documents").select("doc_id", "lang"), "doc_id")
    return rows.rollup("lang").agg(*aggregates()).withColumn("category", F.coalesce("lang", F.lit("all"))).drop("lang")


@query("""SELECT event_type, max(value) FILTER (pos = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (pos = round_even(0.95 * (n - 1), 0)) AS p95
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def usage_percentiles(table, spark):
    return evaluate.exact_percentiles(table("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


RUNS_SQL = "a AS (SELECT user_id AS id, round(avg(value), 6) AS score, round(max(value), 6) AS best FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id AS id, round(avg(value), 6) AS score, round(max(value), 6) AS best FROM events WHERE event_id % 2 = 1 GROUP BY ALL)"


def halves(table):
    """The events of even and of odd ids are two runs, a user a case: the halves together are the table."""
    return [table("events").where(F.col("event_id") % 2 == i).groupBy(F.col("user_id").alias("id")).agg(F.round(F.avg("value"), 6).alias("score"), F.round(F.max("value"), 6).alias("best")) for i in (0, 1)]


@query(f"WITH {RUNS_SQL} SELECT id, 'score' AS metric, a.score AS before, b.score AS after FROM a JOIN b USING (id) WHERE b.score < a.score UNION ALL SELECT id, 'best', a.best, b.best FROM a JOIN b USING (id) WHERE b.best < a.best")
def run_compare(table, spark):
    return evaluate.compare(*halves(table), "id", ["score", "best"])


@query(f"WITH {RUNS_SQL} SELECT count(*) AS cases, count(*) FILTER (abs(a.score - b.score) > 1e-9) AS changed, count(*) FILTER (b.score IS NULL) AS missing, round(avg(a.score), 6) AS mean_before, round(avg(b.score), 6) AS mean_after FROM a LEFT JOIN b USING (id)")
def rescore_delta(table, spark):
    return evaluate.rescore(*halves(table), "id")


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def set_intersect(table, spark):
    return table("labels").where("quality = 1").select("doc_id").intersect(table("labels").where("toxic = 0").select("doc_id"))


# relational forms of the lookups


@query("SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(table, spark):
    return table("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"), F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_resume(table, spark):
    return table("orders").select("o_orderkey", "o_totalprice").join(table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_scope(table, spark):
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@query("SELECT n_nationkey, n_name, r_name AS collection FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def collection_join(table, spark):
    return table("nation").join(table("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("collection"))


@query("SELECT coalesce(lang, 'total') AS category, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def category_counts(table, spark):
    return table("documents").rollup("lang").count().select(F.coalesce("lang", F.lit("total")).alias("category"), F.col("count").alias("n"))


# questions


KEY_SQL = "trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


@query(f"""SELECT key, count(*) AS n, min(conv_id * 1000 + turn) AS first_seen, max(conv_id * 1000 + turn) AS last_seen FROM (SELECT *, {KEY_SQL} AS key FROM conversations WHERE role = 'user') WHERE key <> '' GROUP BY key""")
def question_dedupe(table, spark):
    at = F.col("conv_id") * 1000 + F.col("turn")
    asked = table("conversations").where("role = 'user'").select(tx.normalise_question(F.col("text")).alias("key"), at.alias("at"))
    return asked.where("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


@query(f"""SELECT {KEY_SQL} AS key FROM conversations WHERE role = 'user' EXCEPT SELECT {KEY_SQL} FROM benchmark EXCEPT SELECT ''""")
def known_question_except(table, spark):
    key = tx.normalise_question(F.col("text")).alias("key")
    return table("conversations").where("role = 'user'").select(key).distinct().join(table("benchmark").select(key), "key", "left_anti").where("key <> ''")


@query("""WITH q AS (SELECT *, event_type || ' ' || user_id AS key FROM events WHERE event_type <> 'view'), f AS (SELECT key, arg_min(event_id, (ts, event_id)) AS first_id FROM q GROUP BY key),
m AS (SELECT key, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max((event_type = 'error')::INT) AS failed, max(CASE WHEN user_id % 7 = 0 AND event_type = 'click' THEN 1 ELSE 0 END) AS down FROM q GROUP BY key)
SELECT key, n, failed, down, first_id, 'cand-' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') AS candidate FROM (SELECT *, row_number() OVER (ORDER BY down DESC, failed DESC, n DESC, last_seen, key) AS i FROM m) JOIN f USING (key)""")
def mined_candidates(table, spark):
    question = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    asked = table("events").select(question.alias("question"), "ts", (F.col("event_type") == "error").cast("int").alias("failed"), F.col("event_id").alias("seq"))
    known = asked.where("question like 'view %'").select("question")
    downs = table("events").where("user_id % 7 = 0 and event_type = 'click'").select(F.upper(question).alias("question"))
    found = usage.mined(asked, known, downs)
    return found.select("key", "n", "failed", "down", F.col("first.seq").alias("first_id"), "candidate")


@query("""SELECT event_id, event_type FROM (SELECT * FROM events WHERE event_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 500) WHERE event_type = 'click'""")
def trace_scan(table, spark):
    traces = table("events").select("event_id", "event_type", F.col("event_type").alias("name"), (F.col("event_id") % 2 == 0).alias("is_root"), F.col("ts").cast("timestamp").alias("start_time"))
    return runs.trace_scan(traces, F.lit("2024-01-10").cast("timestamp"), 500, "click").select("event_id", "event_type")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 2")
def per_source_topk(table, spark):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table("documents").select("source", "doc_id", rank.alias("rank")).where("rank <= 2")


#: Replies of a rewriter to each passage: fine ones, with and without parts, and three kinds that can't be used.
@query("""WITH r AS (SELECT item_id, text AS q, item_id % 6 AS k, string_split(text, '.')[1] AS head FROM benchmark)
SELECT item_id, CASE WHEN k IN (0, 1) THEN trim(head) ELSE q END AS standalone,
  CASE WHEN k = 0 THEN trim(head) || '|' || 'two' WHEN k = 1 THEN trim(head) WHEN k = 2 THEN q ELSE q END AS parts, k >= 3 AS fallback FROM r""")
def rewrite_reply(table, spark):
    k, head = F.col("item_id") % 6, F.split("text", "[.]")[0]
    fine = F.to_json(F.struct(F.concat(F.lit(" "), head).alias("standalone_question"), F.when(k == 0, F.array(head, F.lit(""), F.lit(" two "))).otherwise(F.array().cast("array<string>")).alias("sub_queries")))
    reply = F.when(k < 2, fine).when(k == 2, "{}").when(k == 3, "sorry").when(k == 4, F.substring(fine, 1, 20))
    rows = table("benchmark").select("item_id", models.rewritten(F.col("text"), reply).alias("r"))
    return rows.select("item_id", "r.standalone", F.array_join("r.sub_queries", "|").alias("parts"), "r.fallback")


@query("""WITH e AS (SELECT event_id, ['429 quota', 'ResourceExhausted: x', '429 RESOURCE_EXHAUSTED', 'DeadlineExceeded: slow', 'Aborted', 'ValueError: 400', NULL][event_id % 7 + 1] AS e FROM events)
SELECT event_id, coalesce(regexp_matches(e, '429|ResourceExhausted'), false) AS run, coalesce(regexp_matches(e, 'RESOURCE_EXHAUSTED|429'), false) AS embedder,
  coalesce(regexp_matches(e, 'DeadlineExceeded|ServiceUnavailable|InternalServerError|GatewayTimeout|Aborted'), false) AS reranker FROM e""")
def retryable_errors(table, spark):
    errors = F.array(*map(F.lit, ("429 quota", "ResourceExhausted: x", "429 RESOURCE_EXHAUSTED", "DeadlineExceeded: slow", "Aborted", "ValueError: 400", None)))
    error = F.get(errors, (F.col("event_id") % 7).cast("int"))
    return table("events").select("event_id", *(runs.retryable(error, by).alias(by) for by in runs.RETRYABLE))
