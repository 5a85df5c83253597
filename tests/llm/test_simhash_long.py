import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from quern.llm import simhash_long


def shingled(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def first_of_each(sets, least=0.8):
    """The smallest index that links of all similar pairs reach."""
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        of[b] = a
    return [root(i) for i in range(len(sets))], pairs


def planted(seed=3):
    """Originals, each with copies in which one to some words are changed, and strangers."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(90):
        words = [word() for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_copies_are_found(spark):
    texts = planted()
    of, pairs = first_of_each([shingled(t) for t in texts])
    assert len(pairs) > 100
    got = simhash_long.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    print("recall", sum(found[i] == found[j] for i, j in pairs), "of", len(pairs))
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(of[i] == of[c] for i, c in found.items())  # nothing else is linked


def test_sets_and_lists_that_are_too_large_for_a_task(spark):
    """Chains of copies of copies: dealt to parts of a few texts, the groups are the same."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(3):
        words = [word() for _ in range(150)]
        for _ in range(25):
            words = list(words)
            words[rng.randrange(150)] = word()
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in simhash_long.annotate(docs).collect()}
    of, _ = first_of_each([shingled(t) for t in texts])
    assert [whole[i] for i in range(len(texts))] == of
    dealt = {r["doc_id"]: r["component_id"] for r in simhash_long.annotate(docs, large=7).collect()}
    assert dealt == whole
    classes = docs.select(simhash_long.prints(docs["text"]).alias("k")).select("k.*").distinct()
    assert_cap_changes_nothing(classes)


def grouped(links):
    """The least node that links reach, by node."""
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {x: root(x) for x in list(of)}


def assert_cap_changes_nothing(classes):
    whole = grouped(simhash_long.candidates(classes).collect())
    assert len(whole) > 60
    for long in (2, 5, 16):
        assert grouped(simhash_long.candidates(classes, long=long).collect()) == whole


def test_templates(spark):
    """Pairs of a similarity of 0.8 or a little more, all on one template, which most of their text is: lists
    are long, no cap loses a link, and nine of ten pairs meet."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    template, texts, pairs = [word() for _ in range(120)], [], []
    while len(pairs) < 300:
        own = [word() for _ in range(80)]
        copy = list(own)
        for k in rng.sample(range(80), rng.randrange(2, 6)):
            copy[k] = word()
        two = [" ".join(template + x) for x in (own, copy)]
        sets = [shingled(t) for t in two]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.87:
            pairs.append((len(texts), len(texts) + 1))
            texts += two
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = docs.select("doc_id", simhash_long.prints(docs["text"]).alias("k")).select("doc_id", "k.*")
    node = {r["doc_id"]: r["node"] for r in classes.select("doc_id", "node").collect()}
    of = grouped(simhash_long.candidates(classes.select("node", "print")).collect())
    met = sum(of.get(node[i], i) == of.get(node[j], j) for i, j in pairs)
    assert met >= 0.9 * len(pairs)
    assert_cap_changes_nothing(classes.select("node", "print"))
    got = {r["doc_id"]: r["component_id"] for r in simhash_long.annotate(docs).collect()}
    found = sum(got[i] == got[j] for i, j in pairs)
    print("templates: met", met, "found", found, "of", len(pairs))
    assert found >= 0.9 * len(pairs)


def test_print_of_a_long_text_is_that_of_its_parts(monkeypatch):
    found = simhash_long.shingles(" ".join(f"w{i}" for i in range(900)))
    whole = simhash_long.print_of(found)
    monkeypatch.setattr(simhash_long, "AT_ONCE", 7)
    assert simhash_long.print_of(found) == whole and len(whole) == simhash_long.POSITIONS


def test_stage_takes_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    copy = [*words[:100], "other", *words[101:]]  # similarity 191 / 201
    apart = [x if i % 20 else "new" for i, x in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(x), 0) for i, x in enumerate((words, copy, apart))], "doc_id long, text string, n_chars int")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes and {r["doc_id"] for r in out.collect()} == {0, 2}


def test_similar_compares_all_pairs():
    sets = [np.unique(np.random.default_rng(i % 7).integers(0, 300, 100 + i)).astype("u8") for i in range(60)] + [np.zeros(0, "u8")]
    assert simhash_long.similar(sets).tolist() == first_of_each([set(s.tolist()) for s in sets])[0]


def test_odd_rows(odd, none):
    kept = simhash_long.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {3, 4, 8} & set(ids) and {1, 2, 9, 10} <= set(ids)
    assert simhash_long.deduplicate(none).count() == 0
