from collections import Counter

import pytest
import xxhash

from quern.llm import queries, sharding
from tests.llm.conftest import ROWS

NAMES = [f"s{i}" for i in range(7)]


def by_hand(shards, size):
    """Whole preference lists, then turns."""
    lists = []
    for s in shards:
        offset, skip = xxhash.xxh64_intdigest(s, 0) % size, xxhash.xxh64_intdigest(s, 1) % (size - 1) + 1
        lists.append(iter([(offset + j * skip) % size for j in range(size)]))
    table = {}
    while len(table) < size:
        for i, wanted in enumerate(lists):
            if len(table) < size:
                table[next(slot for slot in wanted if slot not in table)] = i
    return [table[j] for j in range(size)]


def test_table():
    assert sharding.lookup_table(NAMES, 251) == by_hand(NAMES, 251)
    shares = Counter(sharding.lookup_table(NAMES, 10_007)).values()
    assert max(shares) - min(shares) <= 1


def test_few_keys_move():
    before, after = sharding.lookup_table(NAMES, 10_007), sharding.lookup_table(NAMES[:3] + NAMES[4:], 10_007)
    renumbered = [a if a < 3 else a + 1 for a in after]
    moved = sum(b != a for b, a in zip(before, renumbered) if b != 3)
    assert moved < 0.1 * 10_007


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)])
def test_bad_arguments(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_odd_rows(odd, none):
    got = sharding.assign(odd, NAMES, size=251)
    assert got.columns == [*odd.columns, "slot_", "shard_"]
    rows = got.collect()
    table = sharding.lookup_table(NAMES, 251)
    assert len(rows) == len(ROWS) and all(table[r["slot_"]] == r["shard_"] for r in rows)
    assert len({r["slot_"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.assign(none, NAMES).count() == 0


def test_write(spark, tmp_path):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    sharding.write(docs, str(tmp_path / "out"), NAMES, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, NAMES).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want


def test_query(spark, small):
    table = by_hand(queries.SHARDS, sharding.SIZE)
    assert len(queries.SHARDS) == 256 and set(table) == set(range(256))
    got = queries.op3_sharding(spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in got:
        h = xxhash.xxh64_intdigest(str(r["doc_id"]), 42)
        h = h - (1 << 64) if h >> 63 else h
        assert r["slot"] == h % sharding.SIZE and r["shard"] == table[r["slot"]]
