"""Evaluation runs: scores of cases, aggregates over a run, runs scored anew or compared, runs about people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.functions.text import cited_urls, normalise_answer, normalise_url, once
from quern.operators.evaluate import exact_percentiles, groups_found, share, urls_found

#: A stored answer is cut to so many characters, a mined one to fewer.
EXCERPT, MINED_EXCERPT = 1500, 400
#: Errors that are tried again, by what raised them. A run waits for its quota and so does an
#: embedder; a reranker tries again what a server or a deadline broke off, and never a quota.
RETRYABLE = {"run": "429|ResourceExhausted", "embedder": "RESOURCE_EXHAUSTED|429", "reranker": "DeadlineExceeded|ServiceUnavailable|InternalServerError|GatewayTimeout|Aborted"}
#: What scoring owns of a case; all else is measured and carried along.
SCORED = ("fact_recall", "facts_missed", "avoidance", "forbidden_present", "url_hit_fraction", "url_full_hit", "urls_missed", "n_cited", "citation_precision")


def retryable(error: Column, by: str = "run") -> Column:
    """Is it an error after which a run, an embedder or a reranker tries again?"""
    return F.coalesce(error.rlike(RETRYABLE[by]), F.lit(False))


def retry_wait(attempt: Column, seconds: int = 20) -> Column:
    return seconds * (attempt + 1)


def distinct_urls(urls: Column) -> Column:
    """Normalised, without empty ones, each where it comes first."""
    return F.array_distinct(F.filter(F.transform(urls, normalise_url), lambda u: u != ""))


def _missed(groups: Column, hits: Column, wanted: bool = False) -> Column:
    """The first alternative of the groups that hit (or didn't)."""
    return F.transform(F.filter(F.arrays_zip(groups.alias("g"), hits.alias("h")), lambda x: x["h"] == F.lit(wanted)), lambda x: x["g"][0])


def scores(answer: Column, retrieved: Column, expected: Column, facts: Column, forbidden: Column) -> Column:
    """A struct of what a case scores; the last three arguments are groups of alternatives. retrieved: addresses
    of the answer's context, in their order. Make it a column and take its fields from there: hits and addresses are
    made once for a row."""
    empty = F.array().cast("array<array<string>>")
    expected, facts, forbidden = (F.coalesce(g, empty) for g in (expected, facts, forbidden))
    have = distinct_urls(F.coalesce(retrieved, F.array().cast("array<string>")))
    text = F.coalesce(answer, F.lit(""))
    read = F.struct(have.alias("have"), cited_urls(text).alias("cited"), normalise_answer(text).alias("text"))
    found = once(read, lambda x: F.struct(x["have"].alias("have"), x["cited"].alias("cited"), urls_found(expected, x["have"]).alias("urls"), groups_found(facts, x["text"]).alias("facts"), groups_found(forbidden, x["text"]).alias("bad")))
    return once(found, lambda x: F.struct(
        x["have"].alias("retrieved_urls"),
        share(x["urls"]).alias("url_hit_fraction"),
        F.when(F.size(x["urls"]) > 0, F.forall(x["urls"], lambda h: h)).alias("url_full_hit"),
        _missed(expected, x["urls"]).alias("urls_missed"),
        share(x["facts"]).alias("fact_recall"),
        _missed(facts, x["facts"]).alias("facts_missed"),
        (1 - share(x["bad"])).alias("avoidance"),
        _missed(forbidden, x["bad"], True).alias("forbidden_present"),
        F.size(x["cited"]).alias("n_cited"),
        share(F.transform(x["cited"], lambda u: F.array_contains(x["have"], u))).alias("citation_precision")))


def route_ok(expected: Column, actual: Column) -> Column:
    """Null unless both are known."""
    return F.nullif(expected, F.lit("")) == F.nullif(actual, F.lit(""))


def rescored(cases: DataFrame, golden: DataFrame) -> DataFrame:
    """cases (id, category, error, answer_excerpt, retrieved_urls, and their scores), golden (id, expected, facts,
    forbidden): cases with their scores made anew from what was stored, and known, truncated, old_facts,
    old_urls. A case without a golden one or with an error keeps its scores; what hangs on addresses is
    made anew only where they were stored."""
    both = cases.join(golden.withColumn("known", F.lit(True)).select("id", "known", "expected", "facts", "forbidden"), "id", "left")
    both = both.withColumn("_new", scores(F.col("answer_excerpt"), F.col("retrieved_urls"), F.col("expected"), F.col("facts"), F.col("forbidden")))
    again = F.col("known") & F.col("error").isNull()
    stored = F.col("retrieved_urls").isNotNull()
    by_url = {"url_hit_fraction", "url_full_hit", "urls_missed"}
    asks = lambda c: again & stored & (F.size("expected") > 0) if c in by_url else again & stored if c in ("n_cited", "citation_precision") else again & (F.size("forbidden") > 0) if c in ("avoidance", "forbidden_present") else again
    kept = [c for c in cases.columns if c not in SCORED]
    return both.select(*kept, F.coalesce("known", F.lit(False)).alias("known"), (F.length(F.coalesce("answer_excerpt", F.lit(""))) >= EXCERPT).alias("truncated"), F.col("fact_recall").alias("old_facts"), F.col("url_hit_fraction").alias("old_urls"), *(F.when(asks(c), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in SCORED))


def rescore_changes(rescored_: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(id, category, what, before, after) of scores that changed: "changed" facts, "truncated" ones (of an
    answer that was cut), "mismatch" of addresses, and "missing" cases without a golden one."""
    moved = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance
    fine = F.col("known") & F.col("error").isNull()
    row = lambda what, a, b: F.struct(what.alias("what"), F.col(a).alias("before"), F.col(b).alias("after"))
    none = F.struct(F.lit("missing").alias("what"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))
    found = F.filter(F.array(
        F.when(~F.col("known"), none), F.when(fine & moved("old_facts", "fact_recall"), row(F.when(F.col("truncated"), "truncated").otherwise("changed"), "old_facts", "fact_recall")),
        F.when(fine & moved("old_urls", "url_hit_fraction"), row(F.lit("mismatch"), "old_urls", "url_hit_fraction"))), lambda x: x.isNotNull())
    return rescored_.select("id", "category", F.explode(found).alias("x")).select("id", "category", "x.*")


#: Means over the scored cases, by the column that is averaged.
MEANS = {
    "url_hit_rate": "url_hit_fraction", "fact_recall": "fact_recall", "avoidance": "avoidance", "citation_precision": "citation_precision",
    "input_tokens_mean": "input_tokens", "output_tokens_mean": "output_tokens", "reasoning_tokens_mean": "reasoning_tokens", "cache_read_tokens_mean": "cache_read_tokens",
    "est_cost_usd_mean": "est_cost_usd", "judge_faithfulness_mean": "judge_faithfulness", "judge_completeness_mean": "judge_completeness",
    "n_context_docs_mean": "n_context_docs", "rerank_calls_mean": "n_rerank_calls", "graph_calls_mean": "graph_calls",
    "graph_input_tokens_mean": "graph_input_tokens", "graph_output_tokens_mean": "graph_output_tokens",
}


def metrics() -> list[Column]:
    """All metrics of a run but percentiles and counts by route; cases with an error count as such only."""
    fine = F.col("error").isNull()
    of = lambda c: F.when(fine, c)
    flag = lambda c: F.avg(of(F.coalesce(c, F.lit(False)).cast("int")))
    some = lambda c: F.count_if(fine & F.coalesce(c, F.lit(False)))
    routed = F.col("route").isNotNull() & (F.col("route") != "")
    return [
        F.count(F.lit(1)).alias("n_cases"), F.count_if(~fine).alias("n_errors"),
        *(F.avg(of(F.col(c))).alias(name) for name, c in MEANS.items()),
        F.avg(of(F.col("url_full_hit").cast("int"))).alias("url_full_hit_rate"),
        some(F.size("forbidden_present") > 0).alias("n_cases_with_forbidden"), some(F.col("n_cited") == 0).alias("n_answers_without_citation"),
        F.avg(of(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("rewrite_input_tokens", F.lit(0)))).alias("input_tokens_with_rewrite_mean"),
        F.sum(of(F.col("est_cost_usd"))).alias("est_cost_usd_total"),
        some(F.col("finish_reason") == "MAX_TOKENS").alias("max_tokens_truncations"), some(F.col("decompose_fallback")).alias("decompose_fallbacks"),
        some(F.size("judge_unsupported_claims") > 0).alias("judge_flagged_cases"), some(F.col("judge_error").isNotNull()).alias("judge_errors"),
        flag(F.col("rerank_skipped")).alias("rerank_skip_rate"), flag(F.col("rewrite_skipped")).alias("rewrite_skip_rate"),
        F.avg(F.when(fine & routed, (F.coalesce("graph_hops", F.lit(0)) > 0).cast("int"))).alias("hop_rate"), F.avg(F.when(fine & routed, F.col("graph_hops"))).alias("graph_hops_mean"),
        some(~F.col("route_ok")).alias("route_mismatches"), some(F.col("route_ok").isNotNull()).alias("n_cases_with_expected_route"),
    ]


def route_counts(cases: DataFrame, *by: str) -> DataFrame:
    """(by, route, n): how many scored cases took each route."""
    return cases.where(F.col("error").isNull() & (F.col("route") != "")).groupBy(*by, "route").agg(F.count(F.lit(1)).alias("n"))


def aggregate(cases: DataFrame) -> DataFrame:
    """cases: -> a row for each category and one for all (category null): metrics(), percentiles of tokens
    and latency, route_counts as a map. No group is gathered: percentiles come from a sort."""
    both = cases.withColumn("category", F.explode(F.array(F.col("category"), F.lit(None).cast("string"))))
    both = both.withColumn("category", F.struct("category"))  # joins null to null
    fine = both.where("error is null")
    out = both.groupBy("category").agg(*metrics())
    out = out.join(exact_percentiles(fine, ["category"], "input_tokens", {"input_tokens_p50": 0.5}), "category", "left")
    out = out.join(exact_percentiles(fine, ["category"], "total_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95}), "category", "left")
    routes = route_counts(both, "category").groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "n")))).alias("route_counts"))
    out = out.join(routes, "category", "left")
    return out.select(F.col("category.category").alias("category"), *(c for c in out.columns if c != "category"))


def compared(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Two rows of aggregate(): (metric, a, b, delta)."""
    wide = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in names))).alias("x")).select("x.*")
    return wide(a, "a").join(wide(b, "b"), "metric", "full").select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def write_run(cases: DataFrame, label: str, golden_set: str, config: dict, path: str) -> None:
    """A run as three JSON tables below path: run (label, golden_set, config), cases, aggregate."""
    spark: SparkSession = cases.sparkSession
    snapshot = {k: str(v) for k, v in config.items()}
    spark.range(1).select(F.lit(label).alias("label"), F.lit(golden_set).alias("golden_set"), F.current_timestamp().alias("timestamp"), F.create_map(*(F.lit(x) for kv in snapshot.items() for x in kv)).alias("config_snapshot")).write.json(f"{path}/run")
    cases.write.json(f"{path}/cases")
    aggregate(cases).write.json(f"{path}/aggregate")


def read_run(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/cases")


# people


def name_hit(name: Column, answer: Column) -> Column:
    plain = lambda t: F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))
    return F.contains(plain(answer), plain(name))


def chunk_role(text: Column, person: Column) -> Column:
    """What a chunk says of a person: instr, sig (approves), other; null if it doesn't name them."""
    instructs = text.rlike("### Instructor Details") | text.rlike(r"(?m)^Name \| ") | text.rlike(r"### Instructor\s*\n")
    signs = text.rlike("I verify that .*?(?:Program Head|Associate Dean|Faculty|Dean)") | text.contains("Program Head")
    return F.when(F.contains(F.lower(text), F.lower(person)), F.when(instructs, "instr").when(signs, "sig").otherwise("other"))


def people_scores(said: Column, truth: Column) -> dict[str, Column]:
    """Of what an answer says that a person teaches. Without a truth, recall is null and F1 is 1 if nothing
    is said."""
    said, truth = F.array_sort(F.array_distinct(said)), F.array_sort(F.array_distinct(truth))
    hit, c, t = F.size(F.array_intersect(said, truth)), F.size(said), F.size(truth)
    recall = F.when(t > 0, hit / t)
    precision = F.when(c > 0, hit / c).when(t == 0, 1.0).otherwise(0.0)
    both = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {
        "correct": F.array_intersect(said, truth), "missed": F.array_except(truth, said), "wrong": F.array_except(said, truth), "recall": recall, "precision": precision,
        "invented": F.size(F.array_except(said, truth)), "f1": F.round(F.when(t == 0, (c == 0).cast("double")).otherwise(both), 4), "exact": said == truth,
    }


def people_aggregate(cases: DataFrame, *by: str) -> DataFrame:
    """cases (error, recall, precision, f1, invented, exact, name_hit, named_other): a row for each of by.
    Cases of teaching have an f1, those of names a name_hit."""
    fine = F.col("error").isNull()
    teach, names = fine & F.col("f1").isNotNull(), fine & F.col("name_hit").isNotNull()
    mean = lambda c, w: F.round(F.avg(F.when(w, F.col(c))), 4).alias(c)
    return cases.groupBy(*by).agg(
        F.count_if(fine).alias("n"), F.count_if(~fine).alias("n_errors"), mean("recall", teach), mean("precision", teach), mean("f1", teach), mean("name_hit", names),
        F.count_if(names).alias("n_name_cases"), F.sum(F.when(names, F.col("named_other")).otherwise(0)).alias("named_instead"), F.sum(F.when(teach, F.col("invented")).otherwise(0)).alias("invented"),
        F.count_if(teach & F.col("exact")).alias("exact_sets"), F.count_if(teach).alias("n_teach_cases"))


# traces


def trace_scan(runs: DataFrame, since: Column, most: int, name: str) -> DataFrame:
    """runs (name, is_root, start_time, ...): of the last `most` root runs from since on, those of a name."""
    return runs.where(F.col("is_root") & (F.col("start_time") >= since)).orderBy(F.desc("start_time"), *(c for c in runs.columns if c.endswith("_id"))).limit(most).where(F.col("name") == name)


def excerpt(answer: Column, most: int = MINED_EXCERPT) -> Column:
    return F.substring(F.coalesce(answer, F.lit("")), 1, most)


def judge_context(passages: DataFrame, each: int, total: int) -> DataFrame:
    """passages (query_id, rank, label, text): what a judge sees, whole passages cut to `each` characters up
    to `total` (what stands between them isn't counted): (query_id, context)."""
    block = F.concat(F.lit("[Passage "), F.col("rank").cast("string"), F.lit("] "), F.coalesce("label", F.lit("")), F.lit("\n"), F.substring("text", 1, each))
    so_far = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = passages.withColumn("block", block).withColumn("so_far", so_far)
    rows = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("so_far") <= total, F.struct("rank", "block")))).alias("b"))
    return rows.select("query_id", F.when(F.size("b") > 0, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).otherwise("(no passages retrieved)").alias("context"))
