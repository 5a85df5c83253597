from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quern.llm import filter_audit, queries
from tests.llm.conftest import CLASHING, ROWS

WORDS = " ".join(f"w{i}" for i in range(250))


def fails(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in text for c in "#$%&*|")}


def by_hand(rows, labels):
    """rows (doc_id, text, lang): every row of the audit, by going through all documents in every order."""
    big = float("inf")
    first = {}
    for i, t, _ in rows:
        i = big if i is None else i
        first[t or ""] = min(first.get(t or "", big), i)
    out = Counter()
    for i, t, lang in rows:
        f = fails(t or "") | {"E": (big if i is None else i) > first[t or ""]}
        good, toxic = labels.get(i, (0, 0))
        for o in permutations("ABCDE"):
            there = True
            for step, letter in enumerate(o, 1):
                key = (lang or "", "".join(o), step)
                there_after = there and not f[letter]
                for name, n in {"kept": there_after, "removed": there and f[letter], "redundant": f[letter] and not there, "unique_fails": f[letter] and sum(f.values()) == 1, "good_lost": good == 1 and there and f[letter], "toxic_lost": toxic == 1 and there and f[letter]}.items():
                    out[key, name] += n
                out[key[0], letter] += there and f[letter]
                there = there_after
    return out


def same(got, rows, labels):
    want = by_hand(rows, labels)
    assert len(got) == len({lang or "" for _, _, lang in rows}) * 600
    for r in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[(r["part"], r["filter_order"], r["step"]), c], (r, c)
        assert r["shapley"] == want[r["part"], r["filter_order"][r["step"] - 1]]


def test_odd_rows(spark, odd, none):
    rows = [(i, t, None if (i or 0) % 3 == 0 else "x") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit("own").alias(c) for c in (*CLASHING, "part", "mask", "edge", "task") if c != "_KEY"))
    labels = {1: (1, 0), 2: (0, 1), 3: (1, 1), 5: (None, 1), 77: (1, 1)}
    told = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    same(filter_audit.audit(docs, told).collect(), rows, labels)
    assert filter_audit.audit(docs.limit(0), told).count() == 0
    got = filter_audit.audit(docs, told.limit(0))
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_copies_over_many_tasks_and_equal_fingerprints(spark):
    """A third of all rows is one text; every text has one of two fingerprints."""
    texts = [WORDS, WORDS + " end", "one # two", "x" * 30_000, None, ""]
    rows = [(i * 7 % 3_001, WORDS if i % 3 == 0 else texts[i % 7 % 6] if i % 5 else f"{WORDS} {i}", "en") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        weak = lambda c: F.length(c).cast("long") % 2
        for fingerprint in (weak, F.xxhash64):
            got = filter_audit.masks(docs, fingerprint=fingerprint)
            seen, want = got.where("mask >= 16").count(), len(rows) - len({t or "" for _, t, _ in rows})
            assert (got.count(), seen) == (len(rows), want)
            least = {}
            for i, t, _ in rows:
                least[t or ""] = min(i, least.get(t or "", i))
            assert {r["doc_id"] for r in got.where("mask < 16").collect()} == set(least.values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_own_mask_at_the_limits():
    mask = lambda t: filter_audit.own_mask(t.encode(), len(t))
    assert mask(" ".join(f"w{i}" for i in range(200))) == 0
    assert mask(" ".join(f"w{i}" for i in range(199))) == 1
    assert mask(" ".join(f"w{i % 100}" for i in range(200))) == 0
    assert mask(" ".join(f"w{i % 99}" for i in range(200))) == 2
    assert mask("é" * 97 + "ABC") == 1 and mask("é" * 96 + "ABCD") == 5
    assert mask("a|") == 9


def test_query(spark, small, duck):
    names = sorted(queries.op12_filter_audit(spark, small).columns)
    got = sorted(map(tuple, queries.op12_filter_audit(spark, small).select(*names).collect()))
    want = sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op12_filter_audit']})").fetchall())
    assert got == want and len(got) == 4 * 600
