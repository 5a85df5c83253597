import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, suffix_dedup
from tests.llm.conftest import ROWS

L = 50


def by_hand(rows):
    """For each row (doc_id, text): its maximal removed spans, by a dictionary of all strings of 50 bytes."""
    big, least = float("inf"), {}
    rows = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for s in {t[k : k + L] for k in range(len(t) - L + 1)}:
            least[s] = min(i, least.get(s, big))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - L + 1):
            if least[t[k : k + L]] < i:
                gone[k + 1 : k + L + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def same(docs, rows, **more):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.annotate(docs, **more).collect())
    want = []
    for (i, t), spans in zip(rows, by_hand(rows)):
        b, at, kept = (t or "").encode(), 0, b""
        for s, e in spans:
            kept, at = kept + b[at:s], e
        want.append((i is None, i or 0, len(b), spans, kept + b[at:]))
    assert got == sorted(want)
    return sum(len(s[3]) for s in want)


def corpus(seed, n=120, letters="ab é"):
    """Texts of passages that are shared, edited, cut short, doubled; texts of 0 to some hundred bytes; copies."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters + "cdefgh") for _ in range(k))
    shared, rows = [word(rng.randrange(30, 400)) for _ in range(12)], []
    for i in range(n):
        t = "".join(rng.choice((word(rng.randrange(60)), rng.choice(shared), rng.choice(shared)[rng.randrange(30) :], rng.choice(letters) * rng.randrange(120))) for _ in range(rng.randrange(6)))
        if t and i % 3 == 0:
            k = rng.randrange(len(t))
            t = t[:k] + word(1) + t[k + 1 :]
        rows.append((i * 37 % 101 if i % 10 else i * 37 % 101 // 2, t))
    return rows + rows[:7] + [(None, rows[3][1]), (None, rows[5][1]), (500, shared[0][:49]), (501, shared[0]), (502, shared[0][:50]), (2, "\0" * 80), (3, "\0" * 79 + "x"), (4, "é" * 40)]


def test_odd_rows(spark, odd, none):
    rows = [(i, t) for i, t in ROWS if len(t or "") < 100_000]
    assert same(odd.where(F.coalesce(F.length("text"), F.lit(0)) < 100_000), rows) == 0
    got = {(r["doc_id"], r["n_bytes"]): r["spans"] for r in suffix_dedup.annotate(odd).collect()}
    long = 27 * 40_000
    assert got[5, long] == [] and [tuple(s) for s in got[6, long + 4]] == [(0, long)]  # rows that repeat an id lose nothing to each other
    assert suffix_dedup.annotate(none).count() == 0
    assert suffix_dedup.annotate(odd.where("length(text) < 20")).agg(F.sum(F.size("spans"))).first()[0] == 0


@pytest.mark.parametrize("seed, size, part", [(1, 1 << 22, 1 << 22), (2, 700, 1 << 22), (3, 1500, 500), (4, 200, 2000)])
def test_all_strings(spark, monkeypatch, seed, size, part):
    """Pieces and parts of any size give the spans that all pairs of strings give."""
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "SPLIT_STRINGS", 64 if seed < 3 else 9)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert same(docs, rows, size=size) > 50


def test_one_hot_passage(spark, monkeypatch):
    """A third of all documents share a passage, with other bytes around it."""
    monkeypatch.setattr(suffix_dedup, "PART", 2000)
    passage = "".join(random.Random(9).choice("abcdefgh ") for _ in range(300))
    rows = [(i, f"{i} head {passage if i % 3 == 0 else i * 7919} tail {i}") for i in range(600)]
    assert same(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, size=2000) == 199


def test_merged_order_is_that_of_the_prefixes():
    """Names from sorting, keys and merge: heads come in the order of their 50 bytes, equal ones as one."""
    rng = random.Random(6)
    text = "".join(rng.choice("ab") * rng.randrange(1, 25) for _ in range(700)).encode()
    data = np.frombuffer(text, "u1")
    at = np.arange(len(text) - L + 1)
    phase = (at % 3).astype("u1")
    window = lambda k: [text[i : i + k] for i in range(len(text) - k + 1)]
    rank = {s: n for n, s in enumerate(sorted(set(window(48))))}
    names = np.array([[rank[text[i + d : i + d + 48]] for d in suffix_dedup.OFFSETS[p]] for i, p in zip(at, phase)], "u8")
    edges = np.c_[data[at[:, None] + np.array([0, 1, 48, 49])], phase]
    row = {"names": [suffix_dedup._pack(np.arange(len(rank)))], "of": suffix_dedup._zip(names.astype("i4").ravel()), "edges": suffix_dedup._zip(np.ascontiguousarray(edges).view("V5").ravel()), "docs": suffix_dedup._zip(at.astype("i8"))}
    _, a, b, _ = suffix_dedup._keys(row)
    order, new = suffix_dedup.merged(phase, a, b)
    got = [text[i : i + L] for i in at[order]]
    assert got == sorted(window(L)) and new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_dedup(spark, small).collect()}
    want = {}
    for (i, t), spans in zip(rows, by_hand(rows)):
        b, gone = (t or "").encode(), sum(e - s for s, e in spans)
        edges = [0, *(x for s in spans for x in s), len(b)]
        want[i] = (len(b), gone, len(spans), hashlib.sha256(b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))).hexdigest())
    assert got == want and sum(w[2] for w in want.values()) > 20
