import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm import queries, runs
from tests.llm.conftest import ROWS


def by_hand(words):
    """Every run, from its words: for each period the stretches of equal words, then the smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def row_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_hand(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def told(texts):
    return [[tuple(r) for r in found.tolist()] for found in runs.find(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=90), max_size=6))
def test_few_words(texts):
    assert told(texts) == [by_hand(t) for t in texts]


def test_planted_runs_and_batches():
    rng, texts = random.Random(4), []
    for i in range(300):
        t = [b"w%d" % rng.randrange(10 ** rng.randrange(1, 5)) for _ in range(rng.randrange(400))]
        for _ in range(rng.randrange(3)):
            period = [b"w%d" % rng.randrange(30) for _ in range(rng.randrange(1, 60))]
            at = rng.randrange(len(t) + 1)
            t[at:at] = (period * 9)[: rng.randrange(9 * len(period))]
        texts.append(t)
    want = [by_hand(t) for t in texts]
    assert told(texts) == want and sum(map(len, want)) > 100
    assert [w for t in texts[:50] for w in told([t])] == want[:50]


def test_masking_keeps_all_words_of_runs():
    rng = random.Random(5)
    for _ in range(200):
        t = [rng.randrange(1, 4) for _ in range(80)]
        kept = runs.surviving(np.array(t), np.full(len(t), len(t)))
        for s, length, _ in by_hand(t):
            assert kept[s : s + length].all()
    alone = np.arange(1, 101)
    assert not runs.surviving(alone, np.full(100, 100)).any()


def test_very_long_periodic_text():
    period = [b"v%d" % i for i in range(30_000)]
    assert told([period * 5 + [b"end"]]) == [[(0, 150_000, 30_000)]]
    assert told([[b"x"] * 200_000]) == [[(0, 200_000, 1)]]


def test_odd_rows(odd, none):
    got = odd.select("doc_id", "text", runs.periodic(F.col("text")).alias("p")).select("doc_id", "text", "p.*").collect()
    assert len(got) == len(ROWS)
    for r in got:
        words = (r["text"] or "").encode().split()
        want = [(0, len(words), 5)] if words[:1] == [b"lorem"] and words[-1] != b"end" else None
        found = [tuple(x) for x in r["runs"]]
        assert r["words"] == len(words)
        assert found == (want if want else [(0, len(words) - 1, 5)] if len(words) > 999 else by_hand(words))
        if len(words) > 999:
            assert r["collapsed"] == "lorem ipsum dolor sit amet" + " end" * (words[-1] == b"end")
    assert none.select(runs.periodic(F.col("text")).alias("p")).count() == 0
    null_id = odd.limit(0).select("doc_id").unionByName(odd.where("doc_id is null").select("doc_id")).select(runs.periodic(F.lit("a b"), F.col("doc_id")).alias("p"))
    assert {r["p"]["collapsed"] for r in null_id.collect()} == {"a b"}


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, small).collect()}
    want = {r["doc_id"]: row_by_hand(r["doc_id"], r["text"]) for r in rows}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 10
    assert queries.op11_periodic_runs(spark, small).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
