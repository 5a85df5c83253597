"""What the pipeline writes is enough to train from."""

import corpus_pipeline
from tests.llm import test_packing


def test_packing_writes_the_tokens(spark, odd):
    docs = odd.where("doc_id in (1, 2, 7, 9, 10)")
    got = corpus_pipeline.packing(spark, docs, "").orderBy("doc_id", "start").collect()
    want = sorted(test_packing.whole(r["text"]).tobytes() for r in docs.collect())
    whole, sequences = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    # two rows have id 7, of different lengths
    assert sorted(b"".join(r["ids"] for r in rows) for rows in whole.values()) == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
