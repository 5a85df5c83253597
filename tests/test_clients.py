"""Services with faults: retries, waits, hedges and orders are counted; runs that are killed go on."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern import models
from quern.models.clients import EMBEDDER, RERANKER, Client, Policy, called, reranked
from quern.plans.evaluation import drive, write_candidates


class Faulty:
    """Raises the errors it is given, one a call, then replies; counts its calls."""

    def __init__(self, *errors, slow=0.0):
        self.errors, self.calls, self.slow, self.lock = list(errors), 0, slow, threading.Lock()

    def __call__(self, request):
        with self.lock:
            n, self.calls = self.calls, self.calls + 1
        if n == 0 and self.slow:
            time.sleep(self.slow)
        if n < len(self.errors) and self.errors[n] is not None:
            raise self.errors[n]
        return f"{request} {n}"


class ServiceUnavailable(Exception):
    pass


def test_quota_is_waited_for_and_other_errors_are_not():
    slept = []
    service = Faulty(*[RuntimeError("429 RESOURCE_EXHAUSTED")] * 3)
    assert Client(service, EMBEDDER, sleep=slept.append, draw=lambda: 1.0)("x") == "x 3" and slept == [2.5, 10.0, 25.0]
    service, slept = Faulty(*[RuntimeError("429")] * 9), []
    with pytest.raises(RuntimeError):
        Client(service, EMBEDDER, sleep=slept.append, draw=lambda: 0.0)("x")
    assert service.calls == 5 and slept == [2, 8, 20, 40]
    service = Faulty(ValueError("400 bad request"))
    with pytest.raises(ValueError):
        Client(service, EMBEDDER, sleep=slept.append)("x")
    assert service.calls == 1
    quick = Policy(RERANKER.retry, RERANKER.waits)
    service = Faulty(ServiceUnavailable("gone"))
    assert Client(service, quick)("x") == "x 1"
    service = Faulty(RuntimeError("429 quota"))
    with pytest.raises(RuntimeError):
        Client(service, quick)("x")
    assert service.calls == 1


def test_hedges():
    hedge = Policy("never", hedge_after=0.05)
    service = Faulty(slow=1.0)  # the twin answers
    began = time.time()
    assert Client(service, hedge)("x") == "x 1" and time.time() - began < 0.9 and service.calls == 2
    service = Faulty()  # in time: no twin
    assert Client(service, hedge)("x") == "x 0" and service.calls == 1
    service = Faulty(ValueError("first"))  # failed at once: the twin answers
    assert Client(service, hedge)("x") == "x 1"
    service = Faulty(ValueError("first"), ValueError("second"))
    with pytest.raises(ValueError):
        Client(service, hedge)("x")
    assert service.calls == 2


def test_called_keeps_order_and_goes_on(spark):
    def make():
        under_way, most, lock = [0], [0], threading.Lock()

        def service(n):
            with lock:
                under_way[0] += 1
                most[0] = max(most[0], under_way[0])
            time.sleep(0.002 * (n % 5))
            with lock:
                under_way[0] -= 1
            if n % 7 == 3:
                raise ValueError(f"no {n}")
            return f"{n} {most[0]}"

        return Client(service, Policy("never"))

    rows = spark.range(60).select("id", F.when(F.col("id") % 10 != 9, F.col("id")).alias("n")).coalesce(2)
    got = called(rows, F.col("n"), make, "string", at_once=3).collect()
    assert [r["id"] for r in got] == list(range(60))
    for r in got:
        if r["n"] is None:
            assert r["reply"] is None and r["error"] is None
        elif r["n"] % 7 == 3:
            assert r["reply"] is None and r["error"] == f"ValueError: no {r['n']}"
        else:
            n, most = map(int, r["reply"].split())
            assert n == r["n"] and most <= 3
    assert called(rows.limit(0), F.col("n"), make, "string").count() == 0


def test_reranked_falls_back_to_the_order_of_places(spark):
    def make():
        def service(request):
            if request["question"] == "bad":
                raise ValueError("down")
            return [float(len(r["text"])) for r in request["records"]][: 1 if request["question"] == "short" else None]

        return Client(service, Policy("never"))

    rows = spark.createDataFrame([(q, w, p, "t", "x" * (p * 3 % 5)) for q, w in enumerate(("good", "bad", "short")) for p in (2, 0, 1)], "query_id long, question string, place int, title string, text string")
    got = sorted((r["query_id"], r["place"], r["score"], r["error"]) for r in reranked(rows, make).collect())
    assert got == [(0, 0, 0.0, None), (0, 1, 3.0, None), (0, 2, 1.0, None), *((1, p, None, "ValueError: down") for p in range(3)), *((2, p, None, None) for p in range(3))]


REPLIES = {
    '{"standalone_question": " Who? ", "sub_queries": [" a ", "", "b", "c", "d", "e"]}': ("Who?", ["a", "b", "c", "d"], False),
    '{"standalone_question": "", "sub_queries": []}': ("q", ["q"], False), '{"standalone_question": "s"}': ("s", ["s"], False), "{}": ("q", ["q"], False),
    "not json": ("q", ["q"], True), '{"standalone_question": "cut': ("q", ["q"], True), "[1]": ("q", ["q"], True), "": ("q", ["q"], True),
}


def test_rewriting_falls_back_to_the_question(spark):
    rows = spark.createDataFrame([(k,) for k in (*REPLIES, None)], "reply string").withColumn("q", F.lit("q"))
    got = {r["reply"]: (r["r"]["standalone"], r["r"]["sub_queries"], r["r"]["fallback"]) for r in rows.withColumn("r", models.rewritten(F.col("q"), F.col("reply"))).collect()}
    assert got == {**REPLIES, None: ("q", ["q"], True)}


def test_a_killed_run_goes_on(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"question {i}") for i in range(24)], "case_id long, question string")
    blocks, waited = [], []

    def answer(open_, kill_at=None):
        blocks.append(sorted(r["case_id"] for r in open_.collect()))
        if kill_at is not None and len(blocks) == kill_at:
            raise KeyboardInterrupt
        attempt = len([b for b in blocks if b]) > 4
        error = F.when(F.col("case_id") % 8 == 1, "429 quota" if not attempt else None).when(F.col("case_id") == 10, "ValueError: no").when(F.col("case_id") == 11, "429 always")
        return open_.select("case_id", F.upper("question").alias("said"), error.alias("error"))

    with pytest.raises(KeyboardInterrupt):
        drive(cases, lambda df: answer(df, 3), str(tmp_path / "run"), {"k": 1}, blocks=4, pause=waited.append)
    with pytest.raises(ValueError):
        drive(cases, answer, str(tmp_path / "run"), {"k": 2}, blocks=4)
    before = list(blocks)
    out = drive(cases, answer, str(tmp_path / "run"), {"k": 1}, blocks=4, pause=waited.append)
    rows = {r["case_id"]: (r["status"], r["attempt"]) for r in out.collect()}
    assert blocks[3] == before[2] and not set(map(tuple, blocks[4:5])) & set(map(tuple, before[:2]))  # goes on with the block that was lost
    assert len(rows) == 24 and rows[10] == ("failed", 0) and rows[11] == ("given up", 2) and rows[2] == ("done", 0) and rows[9] == ("done", 1)
    assert waited == [20, 40]
    n = len(blocks)
    again = drive(cases, answer, str(tmp_path / "run"), {"k": 1}, blocks=4, pause=waited.append)
    assert {r["case_id"]: (r["status"], r["attempt"]) for r in again.collect()} == rows and len(blocks) == n
    write_candidates(spark.createDataFrame([("cand-002", "b"), ("cand-001", "a")], "candidate string, key string"), str(tmp_path / "c"))
    assert [json.loads(r["value"])["key"] for r in spark.read.text(str(tmp_path / "c")).orderBy("value").collect()] == ["a", "b"]
