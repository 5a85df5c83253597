import __spark_entry__
import corpus_pipeline
from quern.llm import quality, secret_scan
from quern.llm.exact_dedup import normalised  # noqa: F401  the stage's own rule
from tests.llm import test_exact_dedup, test_packing, test_quality, test_secret_scan, test_simhash_long

import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS


def clean(text):
    """Without secrets: merged spans give the kind of the first."""
    out, at = "", 0
    for start, _, end, kind in test_secret_scan.by_hand(text):
        if start >= at:
            out += text[at:start] + f"<{kind}>"
        at = max(at, end)
    return out + text[at:]


def by_hand(docs):
    zstd = zstandard.ZstdCompressor(level=quality.LEVEL)
    docs = {i: t for i, t in docs.items() if not test_quality.by_hand(t)[5] and quality.measure(t, zstd)[6]}
    first = {}
    for i in sorted(docs):
        first.setdefault(test_exact_dedup.plain(docs[i]), i)
    ids = sorted(first.values())
    of, _ = test_simhash_long.first_of_each([test_simhash_long.shingled(docs[i]) for i in ids])
    return {i: clean(docs[i]) for k, i in enumerate(ids) if of[k] == k}


def test_run(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {i: test_packing.whole(t) for i, t in by_hand(docs).items()}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in got} == set(want)
    test_packing.check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], 2048, {i: len(x) for i, x in want.items()})
    import zlib

    for r in got:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), small).count() == 0


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated ids, clashing names; with and without n_chars."""
    kept = {}
    for docs in (odd, odd.withColumn("n_chars", F.length("text"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            kept.setdefault(name, []).append(sorted((str(r["doc_id"]), r["text"] or "") for r in out.select("doc_id", "text").collect()))
    assert all(a == b for a, b in kept.values())
    assert len(kept["secret scans"][0]) == len(ROWS) and all("abcdef123456" not in t for _, t in kept["secret scans"][0])
    assert [i for i, t in kept["exact dedup"][0] if not t] == ["2"]  # of the texts that are null or empty
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, odd, "").collect()} == {i for i, _ in ROWS}


def test_secrets_are_gone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.secrets(spark, docs, small).collect()
    assert len(out) == docs.count() and all(r["n_chars"] == len(r["text"]) for r in out)
    assert not [r for r in out if test_secret_scan.by_hand(r["text"])]
    assert secret_scan.RULES


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert {"op1_secret_scan", "op5_exact_dedup", "op12_filter_audit"} <= set(__spark_entry__.oracle_sql()) <= set(names)
