"""The retrieval plan, its choices, and the controller's loop, against walks in plain Python."""

import random
from dataclasses import replace

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.config import DEFAULTS
from quern.operators import control, fusion, select
from quern.plans import retrieval


def pool(rng, n, subs, scored=True):
    rows = []
    for i in range(n):
        origins = sorted(rng.sample(range(subs), rng.randint(1, subs)))
        rows.append({"key": i, "score": rng.randint(0, 30) / 10 if scored else None, "sub_scores": [rng.randint(0, 30) / 10 for _ in range(subs)], "fusion": rng.randint(0, 30) / 10, "both_arms": rng.random() < 0.5, "origins": origins, "source": f"s{rng.randrange(4)}", "mentions": rng.random() < 0.3, "n_subs": subs, "rewrite_skipped": False})
    return rows


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 45), st.integers(1, 4))
def test_choices(seed, n, subs):
    rows = pool(random.Random(seed), n, subs)
    keys = lambda found: [r["key"] for r in found]
    by_score = sorted(rows, key=lambda r: -r["score"])
    none, info = select.choose(rows, replace(DEFAULTS, rerank_mode="none"))
    assert keys(none) == keys(rows if subs == 1 else rows[:10]) and info["n_rerank_calls"] == 0
    some, info = select.choose(rows)
    assert len(set(keys(some))) == len(some) and [r["score"] for r in some] == sorted((r["score"] for r in some), reverse=True)
    if subs == 1:
        assert keys(some) == keys(by_score[:10])
        head = round(sum(r["both_arms"] for r in rows[:10]) / max(len(rows[:10]), 1), 3)
        skipped, info = select.choose(rows, replace(DEFAULTS, consensus_skip=0.5))
        assert not rows or (info["rerank_skipped"] == (head >= 0.5) and info["pool_consensus"] == head)
        assert keys(skipped) == (keys(rows[:10]) if rows and head >= 0.5 else keys(by_score[:10]))
        asked, info = select.choose([r | {"rewrite_skipped": True} for r in rows], replace(DEFAULTS, consensus_skip=0.01))
        assert keys(asked) == keys(by_score[:10]) and not info["rerank_skipped"]
        return
    for sub in range(subs):  # each has its two, if it has them at all
        own = [r for r in rows if sub in r["origins"]]
        assert sum(sub in r["origins"] for r in some) >= min(2, len(own))
    best, info = select.choose(rows, replace(DEFAULTS, rerank_mode="per_subquery"))
    each, first = max(2, -(-10 // subs)), {}
    for sub in range(subs):
        for r in sorted((r for r in rows if sub in r["origins"]), key=lambda r: -r["sub_scores"][sub])[:each]:
            first.setdefault(r["key"], r["sub_scores"][sub])
    assert [r["score"] for r in best] == sorted(first.values(), reverse=True)[: max(10, 2 * subs)]
    broken, _ = select.choose(pool(random.Random(seed), n, subs, scored=False))
    assert keys(broken) == list(range(min(n, 10)))
    fanned, info = select.choose(rows, replace(DEFAULTS, fan_in=True))
    assert len(fanned) == len(some)
    held = lambda found: {r["source"] for r in found if r["mentions"]}
    assert held(some) <= held(fanned) and (info["fanin_swaps"] == 0 or len(held(fanned)) > len(held(some)))


def test_scoped_rows_go_first_and_once(spark):
    lists = spark.createDataFrame([(1, 0, k, i + 1, 0.1, i + 1, None) for i, k in enumerate((7, 8, 9))] + [(1, 1, 7, 1, 0.2, None, 1)], "query_id long, sub_idx int, key long, rank int, fusion_score double, dense_rank int, bm25_rank int")
    scoped = spark.createDataFrame([(1, 0, 5, 2, 0.3), (1, 0, 8, 1, 0.3), (1, 0, 6, 3, 0.3), (1, 0, 5, 4, 0.1)], "query_id long, sub_idx int, key long, place int, fusion_score double")
    got = fusion.prepend(lists, scoped).orderBy("sub_idx", "rank").collect()
    assert [(r["sub_idx"], r["key"], r["rank"], r["scoped"]) for r in got] == [(0, 5, 1, True), (0, 6, 2, True), (0, 7, 3, False), (0, 8, 4, False), (0, 9, 5, False), (1, 7, 1, False)]


# the loop


def script(rng, n):
    """What a controller says of each question at each hop: action, queries, missing."""
    of = {}
    for q in range(n):
        for hop in range(5):
            of[q, hop] = (rng.choice(["answer", "refuse", "retrieve", "retrieve", " Retrieve ", "search", None]), rng.choice([[], ["a"], ["a", "b", "", "c", "d"], None]), rng.choice([[], ["more info"], ["COMP 1510"], ["the rest", "entry year"], None]))
    return of


def walk(of, q, history, most, found, cap):
    """One question by hand: route, passes, calls, held."""
    from tests.test_conversation_rows import concrete

    passes, calls, held, action = 0, 0, [], None
    for hop in range(most + 1):
        action, queries, missing = of[q, hop]
        calls += 1
        action = (action or "").strip().lower()
        if action not in control.ACTIONS:
            action = "answer" if hop else "retrieve"
        queries = [x for x in queries or [] if x][:3]
        if hop == 0 and action == "answer" and history:
            action = "retrieve"
        if hop and action == "retrieve" and not (any(concrete(m) for m in missing or []) and queries):
            action = "answer"
        if action != "retrieve" or hop == most:
            break
        passes += 1
        held += [k for k in found(q, hop) if k not in held]
        held = held[:cap]
    return ("retrieve" if passes else "refuse" if action == "refuse" else "direct"), passes, max(passes - 1, 0), calls, held


@pytest.mark.parametrize("seed", [1, 2])
def test_loop_against_a_walk_of_each_question(spark, seed):
    n = 40
    of = script(random.Random(seed), n)
    said = spark.createDataFrame([(q, hop, a, "r" * 300, qs, ms) for (q, hop), (a, qs, ms) in of.items()], "query_id long, hop int, action string, reason string, queries array<string>, missing array<string>")
    found = lambda q, hop: [(q * 7 + hop * 3 + i) % 11 for i in range(6)]
    hits = spark.createDataFrame([(q, hop, i + 1, k) for q in range(n) for hop in range(4) for i, k in enumerate(found(q, hop))], "query_id long, hop int, rank int, key long")
    asked = spark.createDataFrame([(q, f"question {q}", "Student: hi" if q % 2 else None) for q in range(n)], "query_id long, text string, history string")
    config = replace(DEFAULTS, hop_chunks=9)
    out = control.run(asked, lambda state: state.join(said, ["query_id", "hop"]), lambda going, hop: going.join(hits.where(F.col("hop") == hop), "query_id"), lambda held: held.groupBy("query_id").agg(F.count(F.lit(1)).cast("string").alias("evidence")), config)
    got = {r["query_id"]: r for r in out.routes.collect()}
    held = {}
    for r in out.held.orderBy("merged_rank").collect():
        held.setdefault(r["query_id"], []).append(r["key"])
    for q in range(n):
        route, passes, hops, calls, keys = walk(of, q, q % 2, config.max_passes, found, 9)
        assert tuple(got[q])[1:] == (route, passes, hops, calls, len(keys)), q
        assert held.get(q, []) == keys
    assert all(len(r["reason"]) <= 200 and len(r["queries"]) <= 3 for r in out.trace.collect())


def test_loop_without_a_controller(spark):
    """A controller that fails: looked up once, then answered; nothing is refused."""

    def broken(state):
        raise RuntimeError("out of order")

    asked = spark.createDataFrame([(1, "a"), (2, "")], "query_id long, text string")
    out = control.run(asked, broken, lambda going, hop: going.select("query_id", F.lit(5).cast("long").alias("key"), F.lit(1).alias("rank")), lambda held: held.select("query_id", F.lit("x").alias("evidence")))
    assert {tuple(r) for r in out.routes.collect()} == {(1, "retrieve", 1, 0, 2, 1), (2, "retrieve", 1, 0, 2, 1)}


# the plan


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    words = ["river", "stone", "cloud", "engine", "paper", "garden", "music", "salt", "window", "iron"]
    rows = []
    for i in range(24):
        body = " ".join(rng.choices(words, k=400))
        kind = ("course_outline", "course", "program", "general")[i % 4]
        name = (f"ACIT_{1000 + i}_202430.txt", f"intro_acit_{1000 + i}.txt", "p.txt", "g.txt")[i % 4]
        text = f"### Instructor Details\nName | Ann Lee Smith | x\n{body}" if i % 8 == 0 else body
        rows.append((f"s{i:02d}", text, f"Diploma in Civil {words[i % 10]}", f"https://x.org/{i}", name, kind))
    return spark.createDataFrame(rows, "source string, text string, title string, url string, filename string, category string")


@pytest.fixture(scope="module")
def engine(sources):
    return retrieval.build(sources)


ASKED = [(1, "Which engine has salt in ACIT 1004?"), (2, "What does Ann Lee teach? And where is the paper garden?"), (3, "music window"), (4, "Is Civil cloud a diploma"), (5, "")]


def test_plan(spark, engine):
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    by = {}
    for r in retrieval.retrieve(engine, asked).orderBy("final_rank").collect():
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) >= {1, 2, 3, 4} and all(len(rows) <= 10 for rows in by.values())
    source = {r["doc_id"]: r["source"] for r in engine.chunks.collect()}
    assert by[1][0]["n_scoped"] > 0 and by[2][0]["n_scoped"] > 0 and by[4][0]["n_scoped"] > 0 and by[3][0]["n_scoped"] == 0
    subs = retrieval.sub_queries(engine, asked)
    lists = retrieval.lists(engine, subs).collect()
    heads = {(r["query_id"], r["sub_idx"]): source[r["key"]] for r in lists if r["rank"] == 1}
    assert heads[1, 0] == "s04" and heads[2, 0] in {"s00", "s08", "s16"}
    widths = {}
    for r in lists:
        if not r["scoped"]:
            widths.setdefault((r["query_id"], r["n_subs"]), set()).add((r["sub_idx"], r["key"]))
    assert all(len([1 for s, _ in found if s == 0]) <= (25 if n == 1 else 15) for (_, n), found in widths.items())
    keys = [(r["query_id"], r["sub_idx"], r["key"]) for r in lists]
    assert len(set(keys)) == len(keys)
    answers = {r["query_id"]: r for r in retrieval.answer(engine, asked).collect()}
    assert answers[1]["context"].startswith("\n\nDocument 1: [URL: https://x.org/") and "Filename: ACIT_1004_202430.txt" in answers[1]["context"]


@pytest.mark.parametrize("change", [{"rerank_mode": "none"}, {"rerank_mode": "per_subquery"}, {"consensus_skip": 0.01}, {"fan_in": True}])
def test_plan_in_other_modes(spark, engine, change):
    other = replace(engine, config=replace(DEFAULTS, **change))
    found = retrieval.retrieve(other, spark.createDataFrame(ASKED, "query_id long, text string")).collect()
    assert {r["query_id"] for r in found} >= {1, 2, 3, 4}
    if "consensus_skip" in change:
        assert any(r["rerank_skipped"] for r in found) and not any(r["n_rerank_calls"] for r in found if r["rerank_skipped"])


def test_plan_with_an_arm_of_its_own_and_a_reranker_that_fails(spark, engine):
    models = replace(engine.models, extra=lambda q: F.concat(q, F.lit(" iron iron")), rerank=lambda q, t, x: F.lit(None).cast("double"))
    other = replace(engine, models=models)
    subs = retrieval.sub_queries(other, spark.createDataFrame(ASKED[:3], "query_id long, text string"))
    origins = {(r["query_id"], r["sub_idx"]) for r in retrieval.lists(other, subs).collect()}
    assert {(1, 1), (2, 2), (3, 1)} <= origins  # one more than the sub-queries
    found = retrieval.retrieve(other, spark.createDataFrame(ASKED[:3], "query_id long, text string")).collect()
    assert found and all(r["score"] is None for r in found)


def test_controlled_plan(spark, engine):
    asked = spark.createDataFrame([(1, "ACIT 1004 and ACIT 1008?"), (2, "Thanks!"), (3, " "), (4, "what of ZZZZ 9999")], "query_id long, text string")
    routes = {r["query_id"]: r for r in retrieval.controlled(engine, asked).routes.collect()}
    assert routes[2]["route"] == "direct" and routes[3]["route"] == "refuse" and routes[1]["route"] == "retrieve"
    assert routes[4]["passes"] == DEFAULTS.max_passes  # it is nowhere: the cap ends it


def test_tokeniser_and_missing_tables(spark, sources, tmp_path):
    engine = retrieval.build(sources.limit(3), tokenise=lambda t: [w[:3] for w in t.lower().split()], scoped=False)
    assert engine.words.stats.agg(F.max(F.length("term"))).first()[0] == 3
    retrieval.ready(spark, {"chunks": str(tmp_path)})
    with pytest.raises(FileNotFoundError):
        retrieval.ready(spark, {"chunks": f"{tmp_path}/none"})
