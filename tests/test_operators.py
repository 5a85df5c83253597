import random
from collections import Counter, OrderedDict
from glob import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import text as tx
from quern.operators import chunk, context, control, dense, entities, evaluate, fusion, lexical, numbering, reuse, select, usage
from quern.sources import ingest


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


# matching of facts

HITS = [
    ("June 3", "It is due on June 3rd, 2024."), ("level 2", "That is Level 2nd tier"), ("4 year", "a 4-year degree"), ("12 credits", "(12 credits)"),
    ("1,200", "costs 1200 dollars"), ("1200", "costs $1,200 now"), ("75%", "at least 75% is needed"), ("part-time", "Part–time study"), ("comp 1510", "see COMP 1510."), ("bby", "BBY校区"),
]
MISSES = [("3", "room 13"), ("13", "room 139"), ("1510", "COMP1510"), ("art", "start"), ("art", "arts"), ("June 3", "June 30"), ("510", "1510"), ("", "anything")]


@pytest.mark.parametrize("fact, answer, hit", [(*x, True) for x in HITS] + [(*x, False) for x in MISSES])
def test_fact_in(spark, fact, answer, hit):
    rows = spark.createDataFrame([(fact, answer)], "f string, a string")
    assert rows.select(tx.fact_in(F.col("f"), F.col("a"))).first()[0] is hit


def test_uuid5(spark):
    import uuid

    for name in ("a", "corpus:x.txt#12", "é"):
        assert one(spark, name).select(tx.uuid5(F.col("x"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize("question, simple", [("What is it?", True), ("What is a and what is b?", False), ("One? Two?", False), ("Fees vs costs", False), (" ".join(["w"] * 12), False), (" ".join(["w"] * 11), True)])
def test_simple_question(spark, question, simple):
    assert one(spark, question).select(tx.is_simple_question(F.col("x"))).first()[0] is simple


@pytest.mark.parametrize("missing, concrete", [(["more details"], False), (["COMP 1510"], True), (["ab"], False), (["tuition fee"], True), (["fee"], False), ([None], False), ([], False), (None, False), (["more info", "term 2"], True)])
def test_concrete(spark, missing, concrete):
    assert one(spark, missing, "array<string>").select(tx.is_concrete(F.col("x"))).first()[0] is concrete


def test_cited_urls_and_history(spark):
    answer = "See http://a.org/1.\n\n**Sources**:\n- [x](https://b.org/2), https://c.org/3."
    row = one(spark, answer).select(tx.cited_urls(F.col("x")), tx.history_view(F.col("x"), 1500), tx.history_view(F.col("x"), 5)).first()
    assert row[0] == ["https://b.org/2", "https://c.org/3"] and row[1] == "See http://a.org/1." and row[2] == "See h ..."


# chunks


PIECES = st.lists(st.sampled_from(["word ", "x", "\n", "\n\n", "Sentence one. ", "longer" * 9]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(20, 90), st.integers(0, 19))
def test_split_text(text, size, overlap):
    chunks = chunk.split_text(text, size, overlap)
    assert all(c and len(c) <= size and c == c.strip() and c in text for c in chunks)
    bare = lambda x: "".join(x.split())
    assert bare("".join(chunk.split_text(text, size, 0))) == bare(text)  # nothing but white space is left out
    assert len(bare("".join(chunks))) >= len(bare(text))


def test_merge_run():
    assert context.merge_run(["abc 0123456789", "0123456789 def"]) == "abc 0123456789 def"
    assert context.merge_run(["abc 012345678", "012345678 def"]) == "abc 012345678\n012345678 def"
    assert context.merge_run([]) == ""


@settings(deadline=None)
@given(st.integers(1, 4), st.integers(40, 3_000))
def test_context_stays_within_its_budget(n, limit):
    sources = [{"source": f"s{i}", "title": None, "url": None, "chosen": [2, 7], "near": {j: f"text {j} of {i} " * 9 for j in range(10)}, "loose": ["loose"]} for i in range(n)]
    text, stats = context.render_sources(sources, limit, 2)
    assert len(text) == stats["chars"] <= limit and 1 <= stats["sources"] <= n
    whole, _ = context.render_sources(sources, 10**6, 2)
    assert whole.startswith("\n\nDocument 1:\nFilename: N/A\nCategory: N/A\n\ntext 0 of 0") and whole.count("[...]") == n


def test_runs_and_neighbours(spark):
    chosen = spark.createDataFrame([(1, "a", 0), (1, "a", 3), (1, "a", 9)], "query_id long, source string, chunk_index int")
    sizes = spark.createDataFrame([("a", 10)], "source string, n int")
    near = context.neighbours(chosen, sizes, 2)
    assert sorted(r[2] for r in near.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert sorted((r["run_start"], r["run_end"], r["n"]) for r in context.runs(near).collect()) == [(0, 5, 6), (7, 9, 3)]


# search and fusion


def test_scoped_search_keeps_unscored_documents_and_takes_turns(spark):
    docs = spark.createDataFrame([(1, "a", "cat dog"), (2, "a", "cat"), (3, "b", "bird"), (4, "b", "cat cat fish"), (5, "c", "cat")], "doc_id long, source string, text string")
    queries = spark.createDataFrame([(1, "cat")], "query_id long, text string")
    scopes = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, source string")
    got = lexical.scoped(lexical.build(docs, F.col("text")), queries, scopes, F.col("text"), 2).orderBy("scoped_rank").collect()
    assert [r["source"] for r in got] == ["a", "b", "a", "b"]
    assert {r["doc_id"]: r["score"] for r in got}[3] == 0.0 and len(got) == 4


def test_query_multiplicity_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat dog", "dog bird", "fish owl", "owl bee", "ant fox"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat"), (2, "cat cat")], "query_id long, text string")
    s = {r["query_id"]: r["score"] for r in lexical.scores(docs, queries, F.col("text"), F.col("text")).collect()}
    assert s[2] == pytest.approx(2 * s[1], abs=1e-5) and s[1] > 0


def test_nearest_and_mmr(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200, [0.0] * 8), (201, [1.0] * 8), (202, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = vectors.where("vec_id in (0, 7, 201)").withColumnRenamed("vec_id", "query_id")
    found = dense.nearest(vectors, queries, 12)
    m = np.array([r[1] for r in rows], "f4").astype("f8")
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in (0, 7, 201):
        want = sorted(((-round(float(x), 6), i) for i, x in enumerate(m @ m[q])))[:12]
        got = [(-r["score"], r["vec_id"]) for r in found.where(F.col("query_id") == q).orderBy("rank").collect()]
        assert [i for _, i in got] == [i for _, i in want]
    plain = dense.mmr(found, vectors, 12, Config(mmr_lambda=1.0))
    assert {(r["query_id"], r["vec_id"], r["dense_rank"]) for r in plain.collect()} == {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()}
    varied = [r["vec_id"] for r in dense.mmr(found, vectors, 12, Config(mmr_lambda=0.5)).where("query_id = 201").orderBy("dense_rank").collect()]
    assert varied[0] == 201 and varied[1] != 202  # the twin is no news
    assert dense.nearest(vectors.limit(0), queries, 3).count() == 0 and dense.nearest(vectors, queries.limit(0), 3).count() == 0


def test_fusion_is_symmetric_in_equal_weights(spark):
    rng = random.Random(1)
    arm = lambda: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(rng.sample(range(40), 20))], "query_id long, key long, rank int")
    a, b, even = arm(), arm(), Config(alpha=0.5)
    score = lambda x, y: {r["key"]: r["fusion_score"] for r in fusion.fuse(x, y, 99, even).collect()}
    assert score(a, b) == score(b, a)


def test_pool_takes_turns(spark):
    rows = [(1, 0, "a", 1, 0.5), (1, 0, "b", 2, 0.4), (1, 1, "b", 1, 0.5), (1, 1, "c", 2, 0.4), (1, 1, "d", 3, 0.3)]
    got = fusion.pool(spark.createDataFrame(rows, "query_id long, sub_idx int, key string, rank int, fusion_score double"), 3).orderBy("pool_rank").collect()
    assert [(r["key"], r["origins"], r["pool_fusion_score"]) for r in got] == [("a", [0], 0.5), ("b", [0, 1], 0.9), ("c", [1], 0.4)]


# selection


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 3), min_size=1), st.integers(0, 50)), min_size=1, max_size=40))
def test_quota_covers_each_sub_query(drawn):
    rows = sorted(({"key": i, "origins": sorted(o), "score": s} for i, (o, s) in enumerate(drawn)), key=lambda r: -r["score"])
    chosen = select._quota(list(rows), 10, 2)
    assert [r["score"] for r in chosen] == sorted((r["score"] for r in chosen), reverse=True)
    assert len({r["key"] for r in chosen}) == len(chosen) >= min(10, len(rows))
    for sub in range(4):
        have, there = (sum(sub in r["origins"] for r in x) for x in (chosen, rows))
        assert have >= min(2, there)


def test_fan_in_brings_sources_that_mention_the_key():
    rows = [{"key": i, "source": "s0", "mentions": False, "score": 100 - i} for i in range(10)]
    rows += [{"key": 20 + i, "source": f"m{i % 4}", "mentions": True, "score": 50 - i} for i in range(8)]
    chosen, swaps = select._fan_in(list(rows), 10, 6)
    assert swaps == 4
    assert len(chosen) == 10 and {r["source"] for r in chosen if r["mentions"]} == {"m0", "m1", "m2", "m3"}
    assert select._fan_in(rows[:10], 10, 6) == (rows[:10], 0)


def test_threshold(spark):
    rows = spark.createDataFrame([(1, float(10 - i), i + 1) for i in range(6)] + [(2, None, 1), (2, 5.0, 2)], "query_id long, score double, rank int")
    kept = lambda t: sorted((r["query_id"], r["rank"]) for r in select.score_threshold(rows, t).collect())
    assert len(kept(0.0)) == 8
    assert kept(7.0) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
    assert kept(10.0) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_names(spark):
    people = spark.createDataFrame([(n.lower(), n, f"s{i}", i) for i, n in enumerate(("Ann Lee", "Ann Lee Smith", "Sean O'Brien", "Bo Alards-Tomalin"))], "key string, name string, source string, seq long")
    index = entities.Entities(spark.createDataFrame([("AATE 1GAP", "s9", 9)], "key string, source string, seq long"), spark.createDataFrame([("civil science", ["civil", "science"], "s8", 8)], "label string, words array<string>, source string, seq long"), people)
    questions = ["Does Ann Lee Smith Jones teach?", "Where is Ann Lee now", "What Does Sean O'Brien say of aate 1gap, top 1000", "Who is Bo Alards-Tomalin", "the science of a civil war, Ann", "AATE-1GAP, Ann Lee, Sean O'Brien and civil science"]
    found = entities.detect(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"), index).orderBy("query_id", "entity_rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["label"])
    assert got == {0: ["Ann Lee Smith"], 1: ["Ann Lee"], 2: ["AATE 1GAP", "Sean O'Brien"], 3: ["Bo Alards-Tomalin"], 4: ["civil science"], 5: ["AATE 1GAP", "Ann Lee", "Sean O'Brien"]}
    people = spark.createDataFrame([("Ann Lee Smith",), ("Bo Lee Smith",), ("Ann Lee Fox",), ("Bo Smith",)], "name string")
    assert {tuple(r) for r in entities.aliases(people).collect()} == {("ann smith", "Ann Lee Smith"), ("ann fox", "Ann Lee Fox"), ("bo lee", "Bo Lee Smith")}


def test_person_index(spark):
    texts = [("a", 0, "x\n### Instructor\nAnn Lee\n"), ("b", 1, "### Instructor Details\nName | ANN LEE | x\n### Instructor\nann lee"), ("c", 2, "### Instructor Details \nName |  Bo De Vries \n"), ("d", 3, "Program Head Ann Lee"), ("e", 4, "### Instructor\nInstructor to provide")]
    rows = spark.createDataFrame(texts, "source string, seq int, text string")
    got = sorted(tuple(r) for r in entities.person_index(rows, F.col("text")).collect())
    assert got == [("ann lee", "Ann Lee", "a", 0), ("ann lee", "Ann Lee", "b", 1), ("bo de vries", "Bo De Vries", "c", 2)]


# control and evaluation


def test_guards(spark):
    rows = spark.createDataFrame([("answer", True, None, []), ("bogus", False, None, []), ("retrieve", False, ["more info"], ["q"]), ("retrieve", False, ["COMP 1510"], ["q"]), ("retrieve", False, ["COMP 1510"], [])], "a string, h boolean, m array<string>, q array<string>")
    go = lambda n: [r[0] for r in rows.select(control.guarded(F.col("a"), n, F.col("h"), F.col("m"), F.col("q"))).collect()]
    assert go(0) == ["retrieve"] * 5
    assert go(1) == ["answer", "answer", "answer", "retrieve", "answer"]


def test_history_equals_slicing(spark):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for c, n in ((1, 3), (2, 30)) for i in range(n)]
    got = {r["conv_id"]: r["history"] for r in control.history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 2).collect()}
    assert got[2] == "Student: m26\nAssistant: m27\nStudent: m28\nAssistant: m29" and got[1].endswith("Student: m2")


@pytest.mark.parametrize("values, q, want", [([3.0, 1.0, 2.0], 0.5, 2.0), ([1.0, 2.0], 0.5, 1.0), ([1.0, 2.0, 3.0, 4.0], 0.5, 3.0), ([None, 7.0], 0.95, 7.0), ([], 0.5, None)])
def test_percentile(spark, values, q, want):
    assert one(spark, values, "array<double>").select(evaluate.percentile(F.col("x"), q)).first()[0] == want
    rows = spark.createDataFrame([("g", v) for v in values] or [("h", None)], "g string, v double")
    got = [r["p"] for r in evaluate.exact_percentiles(rows, ["g"], "v", {"p": q}).collect()]
    assert got == ([want] if want is not None else [])


def test_set_scores_and_groups(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "c array<string>, t array<string>")
    got = row.select(*evaluate.set_scores(F.col("c"), F.col("t")).values()).collect()
    assert tuple(got[0]) == (0.5, 0.5, 0.5) and tuple(got[1]) == (1.0, 1.0, 1.0)
    assert one(spark, '["a", ["b", "c"]]').select(evaluate.groups(F.col("x"))).first()[0] == [["a"], ["b", "c"]]


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 30)), max_size=80), st.integers(1, 4))
def test_lru(drawn, most):
    at, trace = 0, []
    for key, gap in drawn:
        at += gap
        trace.append((key, at))
    held, want = OrderedDict(), []
    for key, t in trace:
        hit = key in held and held[key] >= t
        want.append(hit)
        if hit:
            held.move_to_end(key)
        else:
            held.pop(key, None)
            held[key] = t + 50
            if len(held) > most:
                held.popitem(last=False)
    assert usage.lru(trace, most, 50) == want


@given(st.lists(st.integers(0, 40), max_size=300))
def test_smaller_before(values):
    assert reuse.smaller_before(np.array(values, "i8")).tolist() == [sum(x < v for x in values[:i]) for i, v in enumerate(values)]


@pytest.mark.parametrize("span", [7, 100, 1 << 18])
def test_lru_of_a_whole_trace(spark, span):
    """The walk of one machine, for blocks of any size; a third of the lookups are of one key, some of none."""
    rng = np.random.default_rng(span)
    at = np.cumsum(rng.integers(0, 40, 900)) * 1_000_000
    keys = [None if k == 3 else "hot" if k < 20 else f"k{k}" for k in rng.integers(0, 60, 900)]
    trace = spark.createDataFrame([(k, int(i), int(t)) for i, (k, t) in enumerate(zip(keys, at))], "key string, seq long, at long")
    lookups = trace.select("key", "seq", F.timestamp_micros("at").alias("ts")).repartition(5)
    for most, seconds in ((5, 300), (20, 2_000), (1_000, 50)):
        got = {r["seq"]: r["hit"] for r in reuse.lru_cache(lookups, most, seconds, span).collect()}
        assert [got[i] for i in range(900)] == usage.lru(list(zip(keys, (at // 1_000_000).tolist())), most, seconds)
    assert reuse.lru_cache(lookups.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_percentiles_by_refinement(spark, most):
    """A hot group, groups of one value, ties, huge and tiny values, nulls: ranks as by sorting."""
    rng = np.random.default_rng(2)
    values = [("hot", float(v)) for v in np.round(rng.lognormal(0, 3, 600), 3)] + [("tie", 5.0)] * 50 + [("tie", 6.0)] * 3 + [("wide", v) for v in (-1e308, 1e308, 0.0, 5e-324, 1.0, -2.0, 3.0)] + [("one", 7.0), ("none", None), (None, 2.0), (None, None), ("nan", float("nan")), ("nan", 4.0)]
    rows = spark.createDataFrame(values, "g string, v double").repartition(4)
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in evaluate.exact_percentiles(rows, ["g"], "v", qs, most).collect()}
    want = {}
    for g in {g for g, _ in values}:
        own = sorted(v for h, v in values if h == g and v is not None and v == v)
        if own:
            want[g] = tuple(own[round(q * (len(own) - 1))] for q in qs.values())
    assert got == want
    assert evaluate.exact_percentiles(rows.limit(0), ["g"], "v", qs).count() == 0
    assert tuple(evaluate.exact_percentiles(rows.where("g = 'tie'"), [], "v", qs, most).first()) == (5.0, 5.0, 5.0, 6.0)


def test_containment_meets_only_the_rarest_word(spark):
    rng = random.Random(1)
    common = ["technology", "applied", "science"]
    programs = [(f"p{i}", [*rng.sample(common, 2), f"w{i % 40}"][: 1 + i % 3], i) for i in range(60)] + [("none", [], 99), ("twice", ["x", "x"], 100)]
    questions = [(i, " ".join([*rng.sample(common, 2), *(f"w{rng.randrange(40)}" for _ in range(3))])) for i in range(80)] + [(900, None), (901, ""), (902, "x technology")]
    p = spark.createDataFrame(programs, "label string, words array<string>, seq long")
    q = spark.createDataFrame(questions, "query_id long, question string")
    got = {(r["query_id"], r["label"]) for r in entities.contained(q, p).collect()}
    want = {(i, label) for i, t in questions for label, words, _ in programs if words and set(words) <= set((t or "").split())}
    assert got == want
    shared = sum(bool(set(words) & set((t or "").split())) for _, t in questions for _, words, _ in programs)
    df = Counter(w for _, words, _ in programs for w in set(words))
    rarest = [min(set(words), key=lambda w: (df[w], w)) for _, words, _ in programs if words]
    met = sum(w in (t or "").split() for _, t in questions for w in rarest)
    assert entities.candidates(q, p).count() == met < shared


# sources


def test_page_text():
    html = "<title>x</title><nav>no</nav><p>before</p><h1>Head</h1><script>var t='</p>'</script><p>a <b>bold<br> c<p>next &amp; last</p><ul><li>one<li>two <i>x</i></ul><dl><dt>t<dd>d</dl><table><tr><td>1</td><td></td><td>2</td></tr></table>bare<div class='sidebar big'><p>ad</p></div>"
    assert ingest.page_text(html).split("\n") == ["## Head", "a bold c", "next & last", "- one", "- two x", "t: d", "1 | 2"]
    assert ingest.page_text(None) == ingest.page_text("") == ""


def test_corpus(spark, tmp_path):
    (tmp_path / "course").mkdir()
    (tmp_path / "course" / "a.txt").write_text("URL: x\n\nbo\0dy\n")
    (tmp_path / "top.txt").write_text("text")
    (tmp_path / "blank.txt").write_text(" ")
    (tmp_path / "other.md").write_text("text")
    got = {r["filename"]: (r["category"], r["text"]) for r in ingest.corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("course", "URL: x\n\nbody\n"), "top.txt": ("general", "text")}


def test_worklist_skips_failures(spark):
    good = '{"success": true, "data": {"courses": {"1": {"code": "AB", "subject": "s", "courses": {"10": [{"crn": "%s", "name": "n"}], "11": []}}}}}'
    rows = [("202410", good % 1), ("202430", good % 2), ("202510", '{"success": false}'), ("202520", "broken")]
    got = ingest.worklist(spark.createDataFrame(rows, "term string, json string")).collect()
    assert [tuple(r) for r in got] == [("AB 10", "202430", "2", "n")]


def test_feedback_and_frames(spark):
    lines = ['x feedback_log {"ts": "1", "session_id": "s", "verdict": "down", "question": "q"}', "x feedback_log {broken", "none", 'feedback_log {"verdict": "up"}']
    assert [r["session_id"] for r in ingest.feedback(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == ["s"]
    got = one(spark, "event: delta\ndata: [1]\n\n: ping\n\nevent: done\r\ndata: {\r\ndata: }\r\n\r\ndata: {cut\n\ndata: 1\n\nevent").select(ingest.frames(F.col("x"))).first()[0]
    assert [tuple(f) for f in got] == [("delta", "[1]"), ("done", "{\n}"), ("message", "1")]


def test_an_answer_is_normalised_once_for_all_its_facts(spark):
    """A lambda makes what stands in it anew for each element."""
    df = spark.createDataFrame([([["June 3", "x"], ["art"]], "Due on June  3rd. Start")], "facts array<array<string>>, answer string")
    found = df.select(evaluate.facts_found(F.col("facts"), F.col("answer")).alias("f"))
    assert found.first()["f"] == [True, False]
    made = found._jdf.queryExecution().analyzed().expressions().toString()
    assert "answer#" in made and "answer#" not in made.split("lambdafunction", 1)[1]


def test_title_with_unclosed_references(spark):
    page = "<title>t</title><h1>a &amp;&amp;&amp b &lt;c&gt; &copy x &nosuch; &#33; R&D &quot</h1>"
    assert ingest.title_of(ingest.without_unclosed(page)) == "a &&&amp b <c> &copy x &nosuch; ! R&D &quot"
    assert ingest.title_of(page) == 'a &&& b <c> \xa9 x &nosuch; ! R&D "'
    rows = spark.createDataFrame([(0, page), (1, None)], "i int, html string").select("i", ingest.page_title(F.col("html"), unclosed=False).alias("t"), ingest.page_title(F.col("html")).alias("u")).collect()
    assert {r["i"]: (r["t"], r["u"]) for r in rows} == {0: ("a &&&amp b <c> &copy x &nosuch; ! R&D &quot", 'a &&& b <c> \xa9 x &nosuch; ! R&D "'), 1: ("Untitled", "Untitled")}


def test_title_of_a_page():
    page = "<head><title>A &amp; B | site</title></head><body><header><h1>No</h1></header><nav><h1>Nor</h1></nav><div class='sidebar'><h1>x</h1></div><main><h1>Yes &amp; <b>no</b></h1></main></body>"
    assert ingest.title_of(page) == "Yes & no"
    assert ingest.title_of(page.replace("main", "aside")) == "A & B"
    assert ingest.title_of("<p>x</p>") == "Untitled" and ingest.title_of(None) == "Untitled" and ingest.title_of("<h1></h1><title>t</title>") == ""


def test_main_part_of_a_page():
    page = "<body><div id='site-header'><h1>No</h1></div><p>out</p><article><h2>Art</h2><p>a</p></article><div id='main-content'><h1>Main <small>x</small></h1>bare<p>one</p><p class='breadcrumbs'>no</p><dl><dt>k</dt><dd>v</dd></dl></div></body>"
    assert ingest.page_text(page).split("\n") == ["## Main x", "one", "k: v"]
    assert ingest.page_text(page.replace("main-content", "other")).split("\n") == ["## Art", "a"]
    assert ingest.page_text("<main><p>only</p>").split("\n") == ["only"]
    assert ingest.page_text("<h3>T</h3><p>a\xa0 \xa0b<p>x<span>y</span>z</p>").split("\n") == ["### T", "a b", "x y z"]


def test_fetch(spark):
    calls = []

    def get(url):
        calls.append(url)
        if "gone" in url:
            return 404, ""
        if "flaky" in url and calls.count(url) < 3:
            raise OSError("no answer")
        if "down" in url:
            return 500, ""
        return 200, f"body of {url}"

    waits = []
    got = [ingest.fetch(get, u, pause=waits.append) for u in ("a", "gone", "flaky", "down")]
    assert [(r["body"], r["status"], r["tries"], r["error"]) for r in got] == [("body of a", 200, 1, None), (None, 404, 1, None), ("body of flaky", 200, 3, None), (None, None, 3, "HTTP 500")]
    assert waits == [2, 4, 2, 4]
    urls = spark.createDataFrame([(f"u{i}",) for i in range(7)], "url string")
    rows = ingest.fetch_all(urls, lambda u: (404, "") if u == "u3" else (200, u), pause=lambda s: None).collect()
    assert {r["url"]: r["body"] for r in rows} == {f"u{i}": None if i == 3 else f"u{i}" for i in range(7)}
    counts, errors = ingest.crawl_report(spark.createDataFrame([("a",), ("a",), ("b",)], "category string"), spark.createDataFrame([("u", None), ("v", "HTTP 500")], "url string, error string"))
    assert {tuple(r) for r in counts.collect()} == {("a", 2), ("b", 1), (None, 3)} and [r[0] for r in errors.collect()] == ["v\tHTTP 500"]


def test_golden_and_people_files(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "mp-1", "question": "q", "key_facts": [["a", "b"], "c"]}\n{"id": "mp-2", "category": "x", "question": "r"}\n{"id": "fu-1", "category": "x", "question": "s"}\n')
    ids = lambda **k: [r["id"] for r in ingest.golden(spark, str(tmp_path / "g.jsonl"), **k).collect()]
    assert ids() == ["mp-1", "mp-2", "fu-1"] and ids(only="mp-") == ["mp-1", "mp-2"] and ids(category="x", limit=1) == ["mp-2"]
    (tmp_path / "p.jsonl").write_text('{"id": "a", "person": "Ann Lee", "teaches": ["AB 1000"]}\n{"id": "b", "type": "name_lookup", "expect_name": "Bo"}\n')
    assert [(r["id"], r["type"]) for r in ingest.people(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "p.jsonl")).collect()] == [("a", "teaches"), ("b", "name_lookup")] * 2
    path = str(tmp_path / "w")
    ingest.write_worklist(spark.createDataFrame([("AB 10", "202430", "2", "n")], "course string, term string, crn string, name string"), path)
    assert [tuple(r) for r in ingest.read_worklist(spark, path).collect()] == [("AB 10", "202430", "2", "n")]


def test_prompts_and_settings(spark):
    from quern.config import DEFAULTS, from_env
    from quern.functions import prompts

    row = one(spark, "{answer} and {site}")
    got = row.select(prompts.render(prompts.JUDGE, question=F.col("x"), context="c", answer=F.lit(None).cast("string"))).first()[0]
    assert "{answer} and {site}" in got and got.endswith("Answer:\n")
    with pytest.raises(KeyError):
        prompts.render(prompts.DIRECT, question=F.col("x"))
    assert from_env({}) == DEFAULTS
    made = from_env({"QUERN_TOP_K": "7", "QUERN_FAN_IN": "On", "QUERN_ALPHA": "none", "QUERN_SITE_WORDS": "a, b", "QUERN_RERANK_MODE": "none"})
    assert (made.top_k, made.fan_in, made.alpha, made.site_words, made.rerank_mode) == (7, True, DEFAULTS.alpha, ("a", "b"), DEFAULTS.rerank_mode)


def test_written_runs(spark, tmp_path):
    from quern import catalogue
    from quern.operators import runs

    cases = evaluation.run_cases(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")).limit(50)
    runs.write_run(cases, "one", "golden.jsonl", {"top_k": 10}, str(tmp_path / "run"))
    again = runs.read_run(spark, str(tmp_path / "run"), cases.schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, cases.collect()))
    total = [runs.aggregate(x).where("category is null") for x in (cases, cases.where("id % 2 = 0"))]
    got = {r["metric"]: (r["a"], r["b"], r["delta"]) for r in runs.compared(*total, ["n_cases", "fact_recall"]).collect()}
    assert got["n_cases"][0] == 50 and got["n_cases"][2] == got["n_cases"][1] - 50


def test_vectors_without_a_cosine_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [3.0, 3.0]), (7, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in dense.nearest(vectors, queries, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (1, 6, 0.707107), (1, 4, 0.0)]
    assert dense.nearest(vectors.limit(0), queries, 5).count() == 0 and dense.nearest(vectors, queries.limit(0), 5).count() == 0


def test_search_is_the_top_of_all_scores(spark, monkeypatch):
    """Bit for bit, with ties, negative weights, texts without terms; for shards of any size and queries that
    go out in groups."""
    docs = [(i, t) for i, t in enumerate(["a b", "a b", "a", "", None, "c a a", "b " * 40, "a d", "zz"] * 3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a"), (2, "b b zz"), (3, "none"), (4, ""), (5, "a b c d"), (None, "zz d")], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.where("query_id is not null").select("query_id", "rank", "doc_id", "score").collect()))
    index = lexical.build(docs, F.col("text"))
    want = rows(lexical.top(lexical.score(index, queries, F.col("text")), 4))
    for shard_docs in (1, 2, 4096):
        small = lexical.build(docs, F.col("text"), shard_docs=shard_docs)
        assert rows(lexical.search(small, queries, F.col("text"), 4)) == want and len(want) == 12
    assert lexical.search(index, queries, F.col("text"), 4).where("query_id is null").count() == 4
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    assert rows(lexical.search(index, queries, F.col("text"), 4)) == want
    assert lexical.search(index, queries.limit(0), F.col("text"), 4).count() == 0
    assert lexical.search(lexical.build(docs.limit(0), F.col("text")), queries, F.col("text"), 4).count() == 0


def test_a_reader_decodes_one_shard_at_a_time(spark):
    """Whatever a file holds, each shard is a row group of its own, which bounds what a task has at once."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), "id").alias("text")).coalesce(1)
    index = lexical.build(docs, F.col("text"), shard_docs=4)
    files = [pq.ParquetFile(f).metadata for f in glob(f"{index.path.removeprefix('file:')}/shards/all/*.parquet")]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(rows) >= 15 and set(rows) == {1} and len(rows) > len(files)


def test_tasks_get_one_shard_and_some_texts_at_once(spark, monkeypatch):
    """What Python is handed is bounded in rows while an index is built, compacted and searched; then the setting is as before."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = lambda df, own: df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)] * len(b) if own else [len(b)], "int64")], ["n"]) for b in batches), "n long")
    docs = sizes(spark.range(1000).coalesce(1), True).select(F.monotonically_increasing_id().alias("doc_id"), F.col("n").cast("string").alias("text"))
    index = lexical.build(docs, F.col("text"), shard_docs=100)
    assert {int(r["term"]) for r in index.stats.collect()} <= set(range(lexical.TEXTS + 1))
    terms = spark.createDataFrame([(1, "256")], "query_id long, term string")
    found = lexical._in_groups(index, terms, lambda rows, _: sizes(index.shards.coalesce(1), False))
    assert [r["n"] for r in found.collect()] == [1] * index.shards.count() and index.shards.count() >= 10
    asked = []
    monkeypatch.setattr(lexical, "materialise", lambda df, name, own=lexical.materialise: asked.append(name) or own(df, name))
    hits = lexical.search(index, terms.withColumnRenamed("term", "text"), F.col("text"), 4)
    assert hits.count() == hits.count() == 4 and asked.count("lexical-hits") == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_rows_are_numbered_some_at_once(spark, monkeypatch):
    """Rows may carry texts; places go on over batches."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(numbering, "materialise", lambda df, name, own=numbering.materialise: seen.append(spark.conf.get(key)) or own(df, name))
    monkeypatch.setattr(numbering, "ROWS", 7)
    found = numbering.numbered(spark.range(100).select("id", (F.col("id") % 2).alias("g")), ["id"], ("g",))
    assert sorted((r["g"], r["n"]) for r in found.collect()) == [(g, n) for g in (0, 1) for n in range(50)]
    assert seen == ["7"] and spark.conf.get(key) != "7"


def test_scopes_of_a_label_are_dealt_to_parts(spark):
    """Many questions that name an entity of many sources: as a plain join gives, in parts of bounded size."""
    detected = spark.createDataFrame([(q, r, 0, "hot" if r else f"c{q % 3}") for q in range(60) for r in (0, 1)] + [(99, 0, 1, "none")], "query_id long, entity_rank int, kind int, label string")
    of = spark.createDataFrame([(0, "hot", f"s{i}", 5) for i in range(40)] + [(0, f"c{i}", "one", 5) for i in range(3)] + [(2, "hot", "x", 5)], "kind int, label string, source string, k int")
    columns = ["query_id", "entity_rank", "label", "source", "k"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    want = rows(detected.join(of, ["kind", "label"]))
    for pairs in (1, 50, 100, 1 << 20):
        assert rows(entities._met(detected, of, pairs)) == want and len(want) == 60 * 41
    sizes = [r["count"] for r in entities._met(detected, of, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1200  # a plain join has all 2,400 pairs of one label in one task


def test_pruned_search_scores_few_documents(spark, small):
    """Documents that can't reach the k-th score are not scored, and the result has the same bits."""
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "source", "text")
    queries = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = lexical.build(docs.coalesce(1), F.col("text"), shard_docs=64)
    every = lexical.score(index, queries, F.col("text"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))
    assert rows(lexical.search(index, queries, F.col("text"), 10)) == rows(lexical.top(every, 10))
    scored = lexical.work(index, queries, F.col("text"), 10).agg(F.sum("scored")).first()[0]
    print("scored", scored, "of", every.count())
    assert 0 < scored < 0.7 * every.count()


def test_segments_give_what_a_rebuilt_index_gives(spark, small, tmp_path):
    """After every batch, after a batch that is run again and after compaction."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text")
    queries = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(20)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))
    index = lexical.open_index(spark, str(tmp_path / "bm25"), shard_docs=40)
    assert lexical.search(index, queries, F.col("text"), 5).count() == 0
    so_far = docs.limit(0)
    for n in range(3):
        part = docs.where(F.col("doc_id") % 3 == n)
        index.append(part, F.col("text"), f"batch-{n}")
        index.append(part, F.col("text"), f"batch-{n}")
        so_far = so_far.unionByName(part)
        whole = lexical.build(so_far, F.col("text"))
        assert rows(lexical.search(index, queries, F.col("text"), 5)) == rows(lexical.search(whole, queries, F.col("text"), 5))
        assert sorted(map(tuple, index.stats.collect())) == sorted(map(tuple, whole.stats.collect()))
    index = lexical.open_index(spark, str(tmp_path / "bm25"))
    index.compact("all")
    assert index.segments() == ["all"]
    assert rows(lexical.search(index, queries, F.col("text"), 5)) == rows(lexical.search(whole, queries, F.col("text"), 5))
    scopes = spark.createDataFrame([(r["query_id"], s) for r in queries.collect() for s in ("src1", "src2")], "query_id long, source string")
    both = [lexical.scoped(i, queries, scopes, F.col("text"), 3).select("query_id", "scoped_rank", "source", "doc_id", "score") for i in (index, whole)]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect())) != []


def test_a_case_is_scored_once_and_anywhere(spark, tmp_path):
    """Each hit is looked for once a row, however many scores hang on it, and a table of one part goes to all cores."""
    from quern import catalogue

    spark.range(50).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    scored = catalogue.QUERIES["score_cases"](spark, str(tmp_path))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<![a-z0-9])") == 2  # the facts' and the forbidden ones'
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert scored.count() == 50


def test_ordinals_of_documents_carry_no_text(spark, small, monkeypatch):
    """Neighbours, runs and ids of chunks need places only; a digest of the evidence needs none."""
    from quern import catalogue

    written = []
    monkeypatch.setattr(numbering, "materialise", lambda df, name, own=numbering.materialise: written.append(df.columns) or own(df, name))
    for name in ("neighbor_expand", "ordinal_runs", "chunk_ids"):
        assert catalogue.QUERIES[name](spark, small).count()
    assert len(written) == 3 and not any("page_content" in columns for columns in written)
    assert catalogue.QUERIES["evidence_digest"](spark, small).count() and len(written) == 3


def small_table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.mark.parametrize("name", ["first_ordinals", "context_render", "context_render_whole"])
def test_chunks_are_numbered_without_texts(spark, monkeypatch, name):
    from quern.catalogue import context as queries
    from quern.operators import chunk

    seen, real = [], chunk.with_ordinal
    monkeypatch.setattr(chunk, "with_ordinal", lambda rows, *a: seen.append(rows.columns) or real(rows, *a))
    monkeypatch.setattr(queries, "hits", lambda table: spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 1)], "query_id long, doc_id long, rank int"))
    assert getattr(queries, name)(small_table(spark), spark).count() >= 2
    assert seen == [["doc_id", "source", "digest"]]


def test_render_looks_neighbours_texts_up(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", i // 2, f"text {i // 6} of {i % 2}") for i in range(20)], "doc_id long, source string, chunk_index int, page_content string")
    chosen = spark.createDataFrame([(1, 1, "s0", "text 1 of 0"), (1, 2, "s1", "text 0 of 1"), (1, 3, "s1", "nowhere"), (2, 1, "s0", "text 3 of 0")], "query_id long, rank int, source string, page_content string")
    digests = rows.select("doc_id", "source", "chunk_index", F.md5("page_content").alias("digest"))
    got = context.render(chosen, digests, texts=rows.select("doc_id", "source", "page_content")).orderBy("query_id").collect()
    assert got == context.render(chosen, rows).orderBy("query_id").collect() and got[0]["misses"] == 1


def test_evidence_reads_documents_once(spark, monkeypatch):
    """Heads, fields and totals come from what was written once, not from a pass over all documents each."""
    from types import SimpleNamespace

    from quern.catalogue import context as queries

    monkeypatch.setattr(queries.lexical, "build", lambda *a: None)
    monkeypatch.setattr(queries.control, "run", lambda asked, decide, search, evidence: SimpleNamespace(routes=evidence))
    held = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 1)], "query_id long, key long, merged_rank int")
    found = queries.controller_loop(small_table(spark), spark)(held)
    assert found.count() == 2 and not any("documents.parquet" in f for f in found.inputFiles())


def test_fanin_leaves_texts_where_they_are(spark, monkeypatch):
    from quern.catalogue import retrieval as queries

    rows = spark.createDataFrame([(1, 0, 3, 1, 5.0, 0.1), (1, 1, 4, 1, 4.0, 0.2), (2, 0, 3, 2, 3.0, 0.3)], "query_id long, sub_idx int, key long, rank int, score double, fusion_score double")
    monkeypatch.setattr(queries, "lists", lambda table: rows)
    monkeypatch.setattr(queries.select, "fan_in", lambda rows: rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries.fanin_retain(small_table(spark), spark)
        assert found.count() == 3 and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
