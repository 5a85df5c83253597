"""Facts in documents by an index against all pairs."""

import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.catalogue import QUERIES
from quern.operators import evaluate


def plain(text):
    text = re.sub("[‐‑–]", "-", (text or "").lower()).replace(",", "")
    return re.sub("[ \t\n\x0b\f\r]+", " ", re.sub("([0-9])-([a-z])", r"\1 \2", text)).strip(" ")


def by_hand(facts, docs):
    """All pairs, rows of docs counted."""
    found = []
    for item, fact in facts:
        needle = plain(fact)
        tail = "(st|nd|rd|th)?" if re.search("[0-9]$", needle) else ""
        at = re.compile(f"(?<![a-z0-9]){re.escape(needle)}{tail}(?![a-z0-9])")
        found += [(item, doc) for doc, text in docs if needle and at.search(plain(text))]
    return sorted(found, key=str)


def test_odd_pairs(spark):
    facts = [(1, "Größe zählt"), (2, "it opened on May 3"), (3, "日本語"), (4, "size 5-a, or so"), (5, "…"), (6, None), (7, " "), (8, "the cat"), (9, "nowhere to be found"), (9, "the cat")]
    docs = [
        (1, "inside: die GRÖSSE zählt nicht, größe  zählt"), (2, "It opened on May 3rd, 2001"), (2, "another row of two: the cat"), (3, "これは日本語です"), (4, "of size 5 a or so"), (5, "wait … what"),
        (6, "It opened on May 31"), (7, "concat the cats"), (None, "see the\tcat"), (8, None), (8, ""), (9, "The CAT’s “café”"), (10, "size 5‑a or so"), (11, "it opened on may 3th"),
    ]
    got = evaluate.fact_hits(spark.createDataFrame(facts, "item_id long, fact string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = by_hand(facts, docs)
    assert {item for item, _ in want} == {1, 2, 3, 4, 5, 8, 9} and (8, None) in want
    assert sorted(((r["item_id"], r["doc_id"]) for r in got.collect()), key=str) == want


def test_query(spark, small):
    passages, docs = (pq.read_table(f"{small}/{name}.parquet").to_pydict() for name in ("benchmark", "documents"))
    want = by_hand([(i, t.split(".")[0]) for i, t in zip(passages["item_id"], passages["text"])], list(zip(docs["doc_id"], docs["text"])))
    got = QUERIES["fact_search"](spark, small).collect()
    assert want and sorted(((r["item_id"], r["doc_id"]) for r in got), key=str) == want


def test_forms_of_keys_stand_for_the_keys_of_texts(spark):
    """What a text's runs give when they are looked up is what fact_keys() has of it."""
    words = ["3", "3rd", "3th", "rd", "x3nd", "nd", "$", "a3", "3rds", "13th"]
    keys = spark.createDataFrame([(w,) for w in words], "key string")
    forms = evaluate.key_forms(keys)
    for w in words:
        got = {r["key"] for r in forms.where(F.col("form") == w).collect()}
        assert got == set(spark.range(1).select(evaluate.fact_keys(F.lit(w)).alias("k")).first()["k"]) & set(words)
