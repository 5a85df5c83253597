import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm import bpe, queries
from tests.llm.conftest import ROWS

PATH = queries.RANKS
own = bpe.Bpe.from_file(PATH)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "'LL", "123", "!!", "漢", "🙂", "\x1c", "\xa0", "<|endoftext|>", "\r\n", "Ab", " "])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(PARTS).map("".join)))
def test_encodes_as_the_library_and_decodes(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["x" * 60_000, "ab" * 30_000, " " * 5_000, "é" * 20_000])
def test_very_long_pre_tokens(text):
    assert own.decode(own.encode(text)) == text.encode()
    assert own.encode(text[:2_000]) == theirs.encode_ordinary(text[:2_000])


def test_queue_pops_by_rank_then_place():
    queue = bpe.RankQueue(50_000)
    for rank, at in [(300, 5), (2, 9), (300, 1), (49_999, 0), (2, 3)]:
        queue.push(rank, at)
    out = []
    while queue.top:
        out.append(queue.pop())
    assert out == [(2, [3, 9]), (300, [1, 5]), (49_999, [0])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1).map(str.encode), min_size=1), st.randoms())
def test_merges_lowest_rank_first_in_each_piece(pieces, rng):
    """With tokens in any order of ranks, so that a merge often makes a pair of lower rank."""
    tokens = sorted({p[i:j] for p in pieces for i in range(len(p)) for j in range(i + 2, min(len(p), i + 6) + 1)})
    rng.shuffle(tokens)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens[: len(tokens) // 2])}

    def by_hand(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in ranks else [piece]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    own = bpe.Bpe(ranks)
    assert [own.merge([p])[0] for p in pieces] == own.merge(pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.whole([p.decode() for p in pieces])] == [by_hand(p) for p in pieces]


def test_cache_is_bounded_and_right():
    small = bpe.Bpe(RANKS, most=20)
    for _ in range(3):
        texts = [" ".join(f"word{i} go{i % 5} {'x' * 60}" for i in range(j, j + 7)) for j in range(40)]
        for t in texts:
            assert small.encode(t) == theirs.encode_ordinary(t)
        assert max(map(len, (small.pieces.old, small.chunks.held.old))) <= 20 + 40
    assert small.encode_batch(["a b", "", "a  b", "\n"]) == [np.array(theirs.encode_ordinary(t), "<u4").tobytes() for t in ("a b", "", "a  b", "\n")]


def test_columns(odd, none):
    ids = odd.select("text", bpe.encode(F.col("text"), PATH).alias("ids"))
    got = ids.select("text", "ids", bpe.decode(F.col("ids"), PATH).alias("back")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["ids"] == (theirs.encode_ordinary(r["text"]) if r["text"] and len(r["text"]) < 1_000 else r["ids"])
        assert bytes(r["back"]) == (r["text"] or "").encode()
    assert none.select(bpe.encode(F.col("text"), PATH)).count() == 0


def test_query(spark, small):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
