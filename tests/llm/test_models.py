import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm import langid, queries, toxicity
from tests.llm.conftest import ROWS


def speak(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n))


TONGUES = {"aa": "aeiklmn", "bb": "oursttx", "cc": "йцукен"}


def corpus(n=240):
    rng = random.Random(4)
    return [(i, speak(rng, TONGUES[lang], rng.randrange(4, 60)), lang) for i, lang in enumerate(rng.choices(list(TONGUES), k=n))]


def test_langid_learns_and_calibrates(spark, odd, none):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    told, model = langid.identify(docs, ~queries.held_out())
    rows = docs.where(queries.held_out()).select("lang", told.alias("p")).collect()
    assert rows and all(r["p"]["lang"] == r["lang"] and 0.5 < r["p"]["score"] <= 1 for r in rows)
    assert model.languages == sorted(TONGUES) and 0 < model.least <= 1
    got = odd.select("text", langid.predict(F.col("text"), model).alias("p")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["p"]["lang"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
        assert 0 <= r["p"]["score"] <= 1
    mixed = model.predict(speak(random.Random(1), "aeiklmn", 3) + " " + speak(random.Random(1), "oursttx", 3))
    assert mixed[1] < model.predict(speak(random.Random(1), "aeiklmn", 30))[1]
    assert none.select(langid.predict(F.col("text"), model)).count() == 0


def test_langid_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    told, model = langid.identify(docs, F.lit(True))
    assert docs.select(told.alias("p")).first()["p"]["lang"] == "und" and model.languages == []


def test_subwords_of_blocks_are_those_of_the_whole(monkeypatch):
    text = speak(random.Random(3), "abcdé", 400)
    whole = np.sort(np.concatenate(list(langid.subwords(text))))
    monkeypatch.setattr(langid, "AT_ONCE", 64)
    parts = np.sort(np.concatenate(list(langid.subwords(text))))
    assert (whole == parts).all()


def subwords_by_hand(text):
    """Within words and their edges: byte n-grams of 2 to 4."""
    plain = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    out = []
    for n in (2, 3, 4):
        data = (" " + " ".join(plain.split(" ")) + " ").encode()
        data = b" " + b" ".join(data.split()) + b" "
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 32 in gram[1:-1]:
                continue
            code = n
            for c in gram:
                code = (code * 0x01000193 ^ c) % (1 << 32)
            out.append((code * 0x9E3779B1) % (1 << 32) >> 16)
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc éß,.1\n\tЖ日"))
def test_subwords_by_hand(text):
    assert np.sort(np.concatenate(list(langid.subwords(text)))).tolist() == subwords_by_hand(text)


def test_langid_prediction_by_hand():
    """The mean of the subwords' embeddings through the softmax, with its temperature."""
    model = langid.train([(lang, text) for _, text, lang in corpus(120)])
    for _, text, _ in corpus(20):
        z = (np.mean([model.table[i] for i in subwords_by_hand(text)], 0, dtype="f8") + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        lang, score, rejected = model.predict(text)
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-6 and rejected == (score < model.least)


def test_langid_sample(spark, monkeypatch):
    """Repeated and null ids, one text that most rows have, very long texts, more languages than rows are wanted of."""
    rows = [(i, f"text {i}", "aa") for i in range(300)] + [(None, "same", "bb")] * 500 + [(7, "other", "bb"), (7, None, "bb")] + [(1000 + i, "word " * 9_000 + str(i), "cc") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs, F.lit(True))
    assert len(got) == 305 and [t for lang, t in got if lang == "bb"] == ["other", "same"]
    assert all(len(t) <= langid.MOST_CHARS + 10 for lang, t in got if lang == "cc") and sum(lang == "cc" for lang, _ in got) == 3
    monkeypatch.setattr(langid, "ROWS_EACH", 40)
    some = langid.training_rows(docs.repartition(7), F.lit(True))
    assert sum(lang == "aa" for lang, _ in some) == 40 and some == langid.training_rows(docs, F.lit(True))
    monkeypatch.setattr(langid, "ROWS_OF_ALL", 3)
    assert sorted(lang for lang, _ in langid.training_rows(docs, F.lit(True))) == ["aa", "bb", "cc"]


def test_langid_on_odd_rows(spark, odd, none):
    """Fitting on nulls, empty and very long texts, clashing names; on nothing."""
    docs = odd.withColumn("lang", F.when(F.col("doc_id") == 10, "jp").when(F.col("doc_id").isNotNull(), "xx"))
    told, model = langid.identify(docs, F.lit(True))
    assert model.languages == ["jp", "xx"]
    assert docs.select(told.alias("p")).count() == len(ROWS)
    told, model = langid.identify(none.withColumn("lang", F.lit("xx")), F.lit(True))
    assert model.languages == []


def test_langid_query(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op8_langid(spark, small).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = [docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held]
    assert sum(right) >= 0.9 * len(right)


def tame(rng, bad=0):
    words = [speak(rng, "etaoinshrdlu", 1) for _ in range(rng.randrange(20, 120))]
    for _ in range(bad):
        words.insert(rng.randrange(len(words)), rng.choice(["moron", "idiot"]) if rng.random() < 0.5 else "zugrim" + rng.choice(["ol", "ar", "ish"]))
    return " ".join(words)


def labelled(n=600):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.15
        rows.append((i, tame(rng, rng.randrange(2, 5) if bad else 0), (None if rng.random() < 0.3 else int(bad)), int(bad)))
    return rows


def test_toxicity_learns(spark, odd, none):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~queries.held_out())
    truth = {r[0]: r[3] for r in rows}
    got = docs.where(queries.held_out()).select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    toxic, clean = ([r["s"] for r in got if truth[r["doc_id"]] == y] for y in (1, 0))
    assert np.mean(np.array(toxic) >= 0.3) >= 0.85 and np.mean(np.array(clean) < 0.3) >= 0.98
    scores = odd.select(toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["s"] <= 1 for r in scores)
    assert none.select(toxicity.score(F.col("text"), model)).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you moron, you idiot"), (2, "a nice day")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert model.score("you moron") > model.score("a nice day")


def test_label_model_finds_accuracies_and_discounts_echoes():
    rng = np.random.default_rng(2)
    y = rng.random(4_000) < 0.2
    good = [np.where(y, rng.random(4_000) < 0.8, rng.random(4_000) < 0.02) for _ in range(3)]
    noise = rng.random(4_000) < 0.3
    v = np.stack([*good, noise, noise, noise, noise], 1).astype("f8")
    labels = np.where(rng.random(4_000) < 0.1, y.astype(int), -1)
    q = toxicity.label_model(v, labels, 0.2).posterior
    assert ((q > 0.5) == y).mean() > 0.9
    assert (q[(v[:, :3].sum(1) == 0) & noise & (labels < 0)] < 0.5).all()  # four echoes of one noisy voter
    assert (q[(v[:, :3].sum(1) >= 2)] > 0.5).mean() > 0.95


def test_label_model_estimates_the_labels_accuracy_and_moves_them():
    """Many toxic rows were labelled as clean: the labels' accuracy is found, and voters that agree overrule them."""
    rng = np.random.default_rng(5)
    y = rng.random(5_000) < 0.25
    v = np.stack([np.where(y, rng.random(5_000) < 0.6, rng.random(5_000) < 0.003) for _ in range(8)], 1).astype("f8")
    wrong = y & (rng.random(5_000) < 0.3)
    labels = np.where(y & ~wrong, 1, 0)
    found = toxicity.label_model(v, labels, labels.mean())
    assert abs(found.accuracy[0] - 0.7) < 0.08 and found.accuracy[1] > 0.98  # some rows with one stray vote count as toxic
    assert ((found.posterior > 0.5) == y)[wrong].mean() > 0.9 and ((found.posterior > 0.5) == y).mean() > 0.97
    assert np.abs(found.rates[0] - 0.6).max() < 0.05 and np.abs(found.rates[1] - 0.003).max() < 0.02
    right = toxicity.label_model(v, y.astype(int), 0.25)
    assert min(right.accuracy) > 0.92


BIG = "/root/testdata/sf0.1"


def test_posterior_agrees_with_labels_that_were_withheld(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{x}.parquet") for x in ("documents", "labels"))
    rows, _ = toxicity.training_rows(docs, labels, ~queries.held_out())
    truth = np.array([-1 if y is None else y for _, y in rows])
    bags = [toxicity.words(x) for x, _ in rows]
    ids = [np.array([f for w in sorted(bag) for f in toxicity.features(w)], "i8") for bag in bags]
    rng = np.random.default_rng(0)
    withheld = (rng.random(len(rows)) < 0.25) & (truth >= 0)
    known = np.where(withheld, -1, truth)
    fires, present = toxicity.votes([x for x, _ in rows], bags, ids, known, rng.integers(0, toxicity.FOLDS, len(rows)))
    said = toxicity.label_model(fires, known, (known == 1).sum() / (known >= 0).sum(), present).posterior > 0.5
    agree, recall = (said == (truth == 1))[withheld].mean(), said[withheld & (truth == 1)].mean()
    print("agreement on withheld labels", agree, "recall", recall)
    assert agree >= 0.95 and recall >= 0.7


def test_toxicity_query_on_rows_kept_out(spark):
    """Held-out precision and recall, the fold, and scores by hand from the model's weights."""
    docs, labels = (spark.read.parquet(f"{BIG}/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, BIG).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in truth.items() if got[i]["held_out"]]
    hits = sum(p and y for p, y in held)
    precision, recall = hits / sum(p for p, _ in held), hits / sum(y for _, y in held)
    print("held-out precision", precision, "recall", recall)
    assert precision >= 0.95 and recall >= 0.85
    model = toxicity.fit(docs, labels, ~queries.held_out())
    for r in docs.where("doc_id < 200").collect():
        margin = model.bias + sum(model.weights.get(f, 0.0) for w in {*re.findall(r"[^\W\d_]+", (r["text"] or "").lower())} for f in toxicity.features(w))
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-6


def test_toxicity_sample(spark, monkeypatch):
    """Repeated and null ids, one id with most rows, labels given twice, very long texts."""
    rows = [(i, f"text {i}") for i in range(200)] + [(500, "same")] * 400 + [(500, "other"), (None, "nobody's"), (None, None), (501, "word " * 9_000), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(4, 0), (3, 1), (500, 0), (501, 1), (502, 0), (None, 1)], "doc_id long, toxic int")
    got, share = toxicity.training_rows(docs, labels, F.lit(True))
    assert len(got) == 206 and {y: sum(y == x for _, x in got) for y in (0, 1, None)} == {0: 77, 1: 27, None: 102}
    assert ("other", 0) in got and ("nobody's", None) in got and (None, 0) in got and 0 < share < 1
    assert max(len(x or "") for x, _ in got) <= toxicity.MOST_CHARS + 10
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 20)
    some, _ = toxicity.training_rows(docs.repartition(5), labels, F.lit(True))
    assert sum(y == 0 for _, y in some) == 20 and some == toxicity.training_rows(docs, labels, F.lit(True))[0]


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    for docs in (odd, none):
        model = toxicity.fit(docs, labels, F.lit(True))
        assert all(0 <= model.score(r[1]) <= 1 for r in ROWS)


def test_toxicity_query(spark, small):
    got = queries.op10_toxicity(spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
