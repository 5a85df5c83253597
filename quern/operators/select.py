"""Choosing the final list from a pool: thresholds, coverage of sub-queries, retention of sources.

Groups are one question's pool, whose size is capped before, so a group fits in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.config import DEFAULTS, Config
from quern.functions.text import codes, name_runs


def score_threshold(ranked: DataFrame, least: float, min_kept: int = DEFAULTS.min_kept) -> DataFrame:
    """ranked (query_id, score, rank): rows of at least that score, or the first min_kept if fewer than
    that many reach it; all rows if least is 0 or any score of the question is null."""
    w = Window.partitionBy("query_id")
    good, unscored = F.count_if(F.col("score") >= least).over(w), F.count_if(F.col("score").isNull()).over(w)
    keep = (F.lit(least) == 0) | (F.col("_unscored") > 0) | F.when(F.col("_good") >= min_kept, F.col("score") >= least).otherwise(F.col("rank") <= min_kept)
    return ranked.withColumn("_good", good).withColumn("_unscored", unscored).where(keep).drop("_good", "_unscored")


def _quota(rows: list[dict], top_k: int, least: int, subs: int | None = None, by: str = "score") -> list[dict]:
    """subs: how many of the origins are sub-queries that have a quota (all, if not given)."""
    chosen, rest = rows[:top_k], rows[top_k:]
    for sub in sorted({s for r in rows for s in r["origins"] if subs is None or s < subs}):
        have = sum(sub in r["origins"] for r in chosen)
        for candidate in [r for r in rest if sub in r["origins"]][: max(0, least - have)]:
            cover: dict[int, int] = {}
            for r in chosen:
                for s in r["origins"]:
                    cover[s] = cover.get(s, 0) + 1
            spare = next((i for i in range(len(chosen) - 1, -1, -1) if all(cover[s] > least for s in chosen[i]["origins"])), None)
            if spare is not None:
                del chosen[spare]
            chosen.append(candidate)
            rest.remove(candidate)
    return sorted(chosen, key=lambda r: -r[by])


def coverage_quota(pool: DataFrame, top_k: int = DEFAULTS.top_k, least: int = DEFAULTS.min_per_subquery) -> DataFrame:
    """pool (query_id, key, pool_rank, origins, score): the top_k by score, then for each sub-query with
    fewer than `least` of them its best others, each in the place of the last row whose every origin has
    some to spare (or added, if there is none): (query_id, key, score, final_rank)."""

    def pick(pdf):
        rows = pdf.sort_values(["score", "pool_rank"], ascending=[False, True]).to_dict("records")
        rows = [{**r, "origins": list(r["origins"])} for r in rows]
        return _frame(pdf, _quota(rows, top_k, least))

    return pool.select("query_id", "key", "pool_rank", "origins", "score").groupBy("query_id").applyInPandas(pick, "query_id long, key long, score double, final_rank int")


def _frame(pdf, rows):
    import pandas as pd

    out = pd.DataFrame(rows, columns=list(pdf.columns))
    out["final_rank"] = range(1, len(out) + 1)
    return out[["query_id", "key", "score", "final_rank"]]


def fan_in_key(question: Column, site: tuple[str, ...] = ()) -> Column:
    """What several sources may mention: the first code, else the longest capitalised run of two words or
    more that aren't noise (the first, if several are as long); null if there is neither."""
    runs = F.transform(F.filter(name_runs(question, site), lambda w: F.size(w) >= 2), lambda w: F.array_join(w, " "))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.coalesce(F.get(codes(question), F.lit(0)), F.nullif(longest, F.lit("")))


def _fan_in(rows: list[dict], top_k: int, sources: int) -> tuple[list[dict], int]:
    """The chosen rows and the number of swaps. A source that is held already, whether by a row that
    mentions the key or not, gets no other row."""
    chosen, rest = rows[:top_k], rows[top_k:]
    held, swaps = {r["source"] for r in chosen}, 0
    found = len({r["source"] for r in chosen if r["mentions"]})
    for candidate in [r for r in rest if r["mentions"]]:
        if found >= sources:
            break
        if candidate["source"] in held:
            continue
        idle = [i for i in range(len(chosen) - 1, -1, -1) if not chosen[i]["mentions"]]
        if not idle:
            break
        many = [i for i in idle if sum(r["source"] == chosen[i]["source"] for r in chosen) > 1]
        out = (many or idle)[0]
        held.discard(chosen[out]["source"])
        del chosen[out]
        chosen.append(candidate)
        held.add(candidate["source"])
        found, swaps = found + 1, swaps + 1
        chosen.sort(key=lambda r: -r["score"])
    return chosen, swaps


def fan_in(pool: DataFrame, top_k: int = DEFAULTS.top_k, sources: int = DEFAULTS.fan_in_sources) -> DataFrame:
    """pool (query_id, key, pool_rank, score, source, mentions): the top_k by score, in which rows without
    the question's key give way, the lowest first and those of sources with several rows before others,
    to rows that mention it, until so many sources do: (query_id, key, score, final_rank)."""

    def pick(pdf):
        rows = pdf.sort_values(["score", "pool_rank"], ascending=[False, True]).to_dict("records")
        return _frame(pdf, _fan_in(rows, top_k, sources)[0])

    return pool.groupBy("query_id").applyInPandas(pick, "query_id long, key long, score double, final_rank int")


def choose(rows: list[dict], config: Config = DEFAULTS) -> tuple[list[dict], dict]:
    """The final list of one question and what became of it. rows, in the pool's order: {score of a
    reranker or None, sub_scores by sub-query, fusion, both_arms, origins, source, mentions, n_subs,
    rewrite_skipped}. One sub-query: its whole list, reranked unless both arms agree enough on its head.
    Several: first by fusion if they agree enough, else by score with the quota and retention of sources;
    or each sub-query's best in turn; or, without scores, as they stand."""
    info = {"rerank_skipped": False, "pool_consensus": None, "fanin_swaps": 0, "n_rerank_calls": 0}
    if not rows:
        return rows, info
    k, least, subs = config.top_k, config.min_per_subquery, rows[0]["n_subs"]
    share = lambda some, more: round(sum(bool(r["both_arms"] or (more and len(r["origins"]) > 1)) for r in some) / len(some), 3)
    ranked = sorted(rows, key=lambda r: -(r["score"] or 0.0))
    if config.rerank_mode == "none":
        return (rows if subs == 1 else rows[:k]), info
    if subs == 1:
        if config.consensus_skip > 0 and not rows[0]["rewrite_skipped"]:
            info["pool_consensus"] = share(rows[:k], False)
            if info["pool_consensus"] >= config.consensus_skip:
                return rows[:k], info | {"rerank_skipped": True}
        info["n_rerank_calls"] = 1
        return (rows if any(r["score"] is None for r in rows) else ranked)[:k], info
    if config.rerank_mode == "per_subquery":
        each, chosen = max(least, -(-k // subs)), {}
        for sub in range(subs):
            own = sorted((r for r in rows if sub in r["origins"]), key=lambda r: -r["sub_scores"][sub])[:each]
            for r in own:
                chosen.setdefault(r["key"], r | {"score": r["sub_scores"][sub]})
        return sorted(chosen.values(), key=lambda r: -r["score"])[: max(k, least * subs)], info | {"n_rerank_calls": subs}
    if config.consensus_skip > 0:
        head = _quota(sorted(rows, key=lambda r: -r["fusion"]), k, least, subs, "fusion")
        info["pool_consensus"] = share(head, True)
        if info["pool_consensus"] >= config.consensus_skip:
            return head, info | {"rerank_skipped": True}
    info["n_rerank_calls"] = 1
    if any(r["score"] is None for r in rows):
        return rows[:k], info
    chosen = _quota(ranked, k, least, subs)
    if config.fan_in and rows[0]["mentions"] is not None:
        held = {r["key"] for r in chosen}
        rest = [r for r in ranked if r["key"] not in held]
        chosen, info["fanin_swaps"] = _fan_in([*chosen, *rest], len(chosen), config.fan_in_sources)
    return chosen, info


CHOSEN = "query_id long, key long, score double, final_rank int, rerank_skipped boolean, pool_consensus double, fanin_swaps int, n_rerank_calls int, n_candidates int, n_scoped int"


def final(pool: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """choose() of each question's pool (query_id, key, pool_rank, scoped, and what choose() reads): CHOSEN."""

    def pick(pdf):
        import pandas as pd

        rows = [{k: (None if isinstance(v, float) and v != v else v) for k, v in r.items()} for r in pdf.sort_values("pool_rank").to_dict("records")]
        rows = [r | {"origins": list(r["origins"]), "sub_scores": list(r["sub_scores"]) if r["sub_scores"] is not None else None} for r in rows]
        chosen, info = choose(rows, config)
        out = pd.DataFrame([{"query_id": r["query_id"], "key": r["key"], "score": r["score"], "final_rank": i, **info, "n_candidates": len(rows), "n_scoped": sum(r["scoped"] for r in rows)} for i, r in enumerate(chosen, 1)])
        return out.astype({"score": "float64", "pool_consensus": "float64"})

    columns = ["query_id", "key", "pool_rank", "scoped", "score", "sub_scores", "fusion", "both_arms", "origins", "source", "mentions", "n_subs", "rewrite_skipped"]
    return pool.select(*columns).groupBy("query_id").applyInPandas(pick, CHOSEN)
