import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quern.llm import packing, queries
from tests.llm.conftest import ROWS

tokenizer = Tokenizer.from_file(queries.TOKENIZER)


def whole(text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, capacity, lengths):
    """rows: (doc, start, length, sequence, offset)."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in rows:
        docs[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for doc, n in lengths.items():
        at = 0
        for start, length in sorted(docs[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 900), max_size=60), st.sampled_from([64, 256]))
def test_each_token_in_one_piece(lengths, capacity):
    packer = packing.Packer(capacity, 0)
    rows = [x for i, n in enumerate(lengths) for x in packer.add(i, np.arange(n, dtype="<u4"))] + list(packer.finish())
    check([(r[0], r[1], r[2], r[4], r[5]) for r in rows], capacity, dict(enumerate(lengths)))


@given(st.integers(0, 5_000))
def test_cuts_fill_their_class(length):
    cuts = packing.cuts(length, 2048)
    assert sum(n for _, n in cuts) == length
    assert all(k * n <= 2048 for k, n in cuts)
    assert len(cuts) <= length // 2048 + 4


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = rng.lognormal(6, 1.2, 3_000).astype(int)
    packer = packing.Packer(2048, 0)
    rows = [x for i, n in enumerate(lengths) for x in packer.add(i, np.zeros(n, "<u4"))] + list(packer.finish())
    padding = check([(r[0], r[1], r[2], r[4], r[5]) for r in rows], 2048, dict(enumerate(map(int, lengths))))
    assert padding < 0.01 * lengths.sum()


def test_odd_rows(odd, none):
    got = packing.pack(odd, queries.TOKENIZER).collect()
    assert sum(r["length"] for r in got) == sum(len(whole(t)) for _, t in ROWS)
    assert sum(r["doc_tokens"] == 1 for r in got) == 3  # null or empty: the closing id
    assert packing.pack(none, queries.TOKENIZER).count() == 0


def test_query(spark, small):
    texts = {r["doc_id"]: whole(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op7_packing(spark, small).collect()
    for r in got:
        ids = texts[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    padding = check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], 2048, {d: len(x) for d, x in texts.items()})
    assert padding < 0.02 * sum(map(len, texts.values()))


PARTS = st.lists(st.sampled_from([" ", "\n", "  ", "\t", "a", "the", "Don't", "é", "日本", "🙂", " ", "<|endoftext|>", "x1", ".", "\r\n", " "])).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=6))
def test_ids_are_the_tokenizers(texts):
    ids = packing.Ids(queries.TOKENIZER, 1, 50, False)
    for _ in range(2):  # new and remembered chunks
        assert [x.tolist() for x in ids(texts)] == [whole(t).tolist() for t in texts]


SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b", "a\n<|endoftext|>\nb c<|endoftext|>", " <|endoftext|><|endoftext|> x y <|endoftext|>z", "one two <|endoftext> |<|endoftext|>  ", "x <|endoftext|>\n y z"]


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "ab", "c ", " d", "<|", "|>"]), max_size=12).map("".join), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_are_the_librarys(texts):
    for plain in (False, True):
        other = Tokenizer.from_file(queries.TOKENIZER)
        other.encode_special_tokens = plain
        ids = packing.Ids(queries.TOKENIZER, 1, 100, plain)
        assert [x.tolist() for x in ids(texts + SPECIAL)] == [[*other.encode(t, add_special_tokens=False).ids, 1] for t in texts + SPECIAL]


def test_special_strings_in_texts(spark):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    for plain in (False, True):
        found = defaultdict(list)
        for r in packing.pack(docs, queries.TOKENIZER, plain=plain).collect():
            found[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        for i, t in enumerate(SPECIAL):
            ids = [x for _, part in sorted(found[i]) for x in part]
            assert (50256 in ids) != plain
            assert plain or ids == whole(t).tolist()
