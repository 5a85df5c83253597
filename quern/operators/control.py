"""Conversation memory and the bounded retrieve-or-answer loop over a batch of questions."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.config import DEFAULTS, Config
from quern.functions.text import codes, is_concrete
from quern.operators.fusion import merge_hops
from quern.sources.tables import materialise

log = logging.getLogger(__name__)

#: What stands for a history without messages.
NO_HISTORY = "No previous conversation."


def history(messages: DataFrame, turns: int) -> DataFrame:
    """messages (conv_id, turn, role, text): -> (conv_id, history, messages): the last turns, two messages
    each. At most 2 * turns rows of a conversation are gathered."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("back", back).where(F.col("back") <= 2 * turns)
    line = F.concat(F.when(F.col("role") == "user", "Student: ").otherwise("Assistant: "), F.col("text"))
    rows = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("history"), F.size("rows").cast("long").alias("messages"))


def history_or_none(history: Column) -> Column:
    return F.coalesce(F.nullif(history, F.lit("")), F.lit(NO_HISTORY))


ACTIONS = ("answer", "refuse", "retrieve")
MOST_QUERIES, REASON = 3, 200
#: What needs no search.
GREETINGS = r"(?iU)^\W*(hi|hello|hey|thanks|thank you|good (morning|afternoon|evening)|bye|what can you do)\b[^?]{0,30}[?!.]?\s*$"


def guarded(action: Column, passes: int, has_history: Column, missing: Column, queries: Column) -> Column:
    """A controller's decision after the guards: what is unknown becomes a retrieval at first and an
    answer later; a first answer from history alone becomes a retrieval; a later retrieval needs something
    concrete that is missing, and a query."""
    action = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    known = F.when(action.isin(*ACTIONS), action).otherwise("answer" if passes else "retrieve")
    if passes == 0:
        return F.when((known == "answer") & has_history, "retrieve").otherwise(known)
    return F.when((known == "retrieve") & ~(is_concrete(missing) & (F.size(queries) > 0)), "answer").otherwise(known)


def lexical_controller(state: DataFrame) -> DataFrame:
    """A stand-in for a model: state (query_id, text, history, evidence, hop): -> (query_id, action, reason,
    queries, missing). At first: blank questions are refused, greetings are answered, all others looked
    up. Later: the codes of a question that its evidence doesn't have are missing, and are what to look
    for; if it has them all, the answer is due."""
    named = F.array_distinct(codes(F.col("text")))
    lacking = F.filter(named, lambda c: ~F.contains(F.regexp_replace(F.upper(F.col("evidence")), r"[\s-]+", ""), F.replace(c, F.lit(" "), F.lit(""))))
    first = F.when(F.trim("text") == "", "refuse").when(F.col("text").rlike(GREETINGS), "answer").otherwise("retrieve")
    later = F.when(F.size(lacking) > 0, "retrieve").otherwise("answer")
    begun = F.col("hop") > 0
    none = F.array().cast("array<string>")
    return state.select("query_id", F.when(begun, later).otherwise(first).alias("action"), F.when(begun & (F.size(lacking) > 0), "codes without evidence").otherwise("").alias("reason"), F.when(begun, lacking).otherwise(none).alias("queries"), F.when(begun, lacking).otherwise(none).alias("missing"))


@dataclass
class Outcome:
    """routes (query_id, route, passes, hops, calls, chunks); held (query_id, key, hop, rank, merged_rank);
    trace (query_id, hop, action, reason, queries, missing, chunks_seen)."""

    routes: DataFrame
    held: DataFrame | None
    trace: DataFrame


def run(questions: DataFrame, decide: Callable[[DataFrame], DataFrame], retrieve: Callable[[DataFrame, int], DataFrame], evidence: Callable[[DataFrame], DataFrame], config: Config = DEFAULTS) -> Outcome:
    """questions (query_id, text, maybe history): all questions move together; each call of decide is one
    decision of those that still go on. decide: (query_id, text, history, evidence, hop) -> (query_id, action,
    reason, queries, missing); if it fails, the questions of that pass are looked up at first and answered
    later, never refused. retrieve: (query_id, text, queries), hop -> (query_id, key, rank). evidence: what
    is held -> (query_id, evidence). No question is looked up more than config.max_passes times. Each pass
    is a written table, read again by the next."""
    history = F.coalesce("history", F.lit("")) if "history" in questions.columns else F.lit("")
    active = questions.select("query_id", "text", history.alias("history"))
    held = trace = None
    none = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    for hop in range(config.max_passes + 1):
        seen = active.join(evidence(held), "query_id", "left") if held is not None else active.withColumn("evidence", F.lit(None).cast("string"))
        state = seen.select("query_id", "text", "history", F.coalesce("evidence", F.lit("(nothing retrieved yet)")).alias("evidence"), F.lit(hop).alias("hop"))
        try:
            said = materialise(decide(state).select("query_id", "action", "reason", "queries", "missing"), f"decisions-{hop}")
        except Exception as error:  # a controller that is out of order must not stop answers
            log.warning("controller failed at hop %d: %s", hop, error)
            said = state.select("query_id", F.lit("answer" if hop else "retrieve").alias("action"), F.lit("controller error").alias("reason"), none.alias("queries"), none.alias("missing"))
        both = active.join(said, "query_id", "left").withColumn("queries", F.slice(clean(F.col("queries")), 1, MOST_QUERIES)).withColumn("missing", clean(F.col("missing")))
        both = both.withColumn("action", guarded(F.col("action"), hop, F.col("history") != "", F.col("missing"), F.col("queries")))
        seen_n = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_seen")) if held is not None else questions.select("query_id", F.lit(0).cast("long").alias("chunks_seen"))
        step = both.join(seen_n, "query_id", "left").select("query_id", F.lit(hop).alias("hop"), "action", F.substring(F.coalesce("reason", F.lit("")), 1, REASON).alias("reason"), F.when(F.col("action") == "retrieve", F.col("queries")).otherwise(none).alias("queries"), "missing", F.coalesce("chunks_seen", F.lit(0)).alias("chunks_seen"), "text", "history")
        step = materialise(step, f"step-{hop}")
        trace = step.drop("text", "history") if trace is None else trace.unionByName(step.drop("text", "history"))
        going = step.where("action = 'retrieve'")
        if hop == config.max_passes or not going.limit(1).count():
            break
        found = retrieve(going.select("query_id", "text", "queries"), hop).select("query_id", F.lit(hop).alias("hop"), "rank", "key")
        if held is not None:  # what is held comes first, and all of it stays
            found = held.select("query_id", "hop", "rank", "key").unionByName(found)
        held = materialise(merge_hops(found, config.hop_chunks), f"held-{hop}")
        active = going.select("query_id", "text", "history")
    counts = trace.groupBy("query_id").agg(F.count_if((F.col("action") == "retrieve") & (F.col("hop") < config.max_passes)).alias("passes"), F.count(F.lit(1)).alias("calls"), F.max_by("action", "hop").alias("last"))
    route = F.when(F.col("passes") > 0, "retrieve").when(F.col("last") == "refuse", "refuse").otherwise("direct")
    routes = counts.select("query_id", route.alias("route"), "passes", F.greatest(F.col("passes") - 1, F.lit(0)).alias("hops"), "calls")
    n = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks")) if held is not None else questions.select("query_id", F.lit(0).cast("long").alias("chunks"))
    return Outcome(routes.join(n, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))), held, trace)


def hop_stats(passes: DataFrame) -> DataFrame:
    """passes (query_id, hop, n_candidates, n_scoped, n_rerank_calls, fanin_swaps, rerank_skipped,
    pool_consensus): sums over a question's passes, and flags of its last one."""
    sums = [F.sum(c).alias(c) for c in ("n_candidates", "n_scoped", "n_rerank_calls", "fanin_swaps")]
    return passes.groupBy("query_id").agg(*sums, *(F.max_by(c, "hop").alias(c) for c in ("rerank_skipped", "pool_consensus")), F.count(F.lit(1)).alias("passes"))


def fixed_answer(question: Column, answers: dict[str, str]) -> Column:
    """The answer that is kept for a question, by its upper-case form; null if there is none."""
    known = F.create_map(*(F.lit(x) for k, v in answers.items() for x in (k.upper(), v))) if answers else F.lit(None).cast("map<string,string>")
    return F.element_at(known, F.upper(F.regexp_replace(question, r"(?U)^\s+|\s+$", "")))
