import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from quern.llm import queries, simhash
from quern.llm.components import components
from tests.llm.conftest import LONG, ROWS


def by_hand(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, most=3):
    """The smallest index that each one reaches."""
    n = len(prints)
    of = list(range(n))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [root(i) for i in range(n)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint_of(text) & (1 << 64) - 1 == by_hand(text)


def test_fingerprint_of_a_long_text_is_that_of_its_parts(monkeypatch):
    whole = simhash.fingerprint_of(LONG[:60_000])
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint_of(LONG[:60_000]) == whole


def near(rng, n):
    """Clusters around centres, chains, and strangers."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(x)
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_links_have_the_components_of_all_pairs(spark):
    prints = near(random.Random(5), 700)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = {r["node"]: r["component"] for r in components(simhash.links(rows)).collect()}
    want = groups(prints)
    named = {}
    for p, g in zip(prints, want):
        named.setdefault(g, set()).add(found.get(signed(p), signed(p)))
    assert all(len(x) == 1 for x in named.values())
    assert len({next(iter(x)) for x in named.values()}) == len(named)


def test_long_lists_are_dealt_to_more_positions(spark):
    """Lists of over 3 prints are posted again, down to the last level."""
    rng = random.Random(3)
    base = 0x0123456789ABCDEF & ~0xFFFFFF
    prints = sorted({base | rng.getrandbits(24) for _ in range(40)} | {base ^ (1 << b) for b in range(24)} | {base} | set(near(rng, 150)))
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = {r["node"]: r["component"] for r in components(simhash.links(rows, long=3)).collect()}
    named = {}
    for p, g in zip(prints, groups(prints)):
        named.setdefault(g, set()).add(found.get(signed(p), signed(p)))
    assert all(len(x) == 1 for x in named.values()) and len({next(iter(x)) for x in named.values()}) == len(named)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 32), st.integers(3, 200))
def test_components_within_a_list(seed, n):
    prints = near(random.Random(seed), n)
    assert simhash.local_components(np.array(prints, "u8")).tolist() == groups(prints)


def test_guaranteed_minimum():
    """Every pair of at most 3 differing bits meets in a list of each level."""
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        first = [m for m in simhash.masks() if not m & flips]
        assert first
        for m in first:
            second = [x for x in simhash.finer(m) if not x & flips]
            assert second and all(any(not z & flips for z in simhash.finer(x)) for x in second)
    assert len(simhash.masks()) == 8 and {len(simhash.finer(m)) for m in simhash.masks()} == {10}
    last = {z for m in simhash.masks() for x in simhash.finer(m) for z in simhash.finer(x)}
    assert {z.bit_count() for z in last} == {52} and not any(map(simhash.finer, last))


def test_odd_rows(odd, none):
    got = simhash.annotate(odd).collect()
    assert len(got) == len(ROWS)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add((r["print"], r["component_id"]))
    assert of[2] == of[3] == of[8] == {(0, 2)}  # no words: fingerprint 0, linked
    assert of[4] == {(signed(by_hand("one two three four")), 1)}
    assert {c for _, c in of[5]} == {5}
    assert simhash.annotate(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert 4 not in ids and 3 not in ids and 1 in ids and 2 in ids
    assert simhash.deduplicate(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (2001, 2000), (2000, 2001)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[1000 + i] == 1000 for i in range(301)) and found[2001] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    prints = [by_hand(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{p:016x}", docs[g]["doc_id"]) for r, p, g in zip(docs, prints, groups(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, small).collect()} == want
