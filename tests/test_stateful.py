"""Streams whose state has timers and times to live: over restarts, micro-batch by micro-batch."""

import time

import pytest
from pyspark.sql import functions as F

from quern.sources import ingest
from quern.streaming import serving, stateful


@pytest.fixture(scope="module")
def rocks(spark):
    own = stateful.ready(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def run(rocks, tmp_path, batches, schema, stream_of):
    """Each batch is a run of the query by itself: a restart from its checkpoint between any two. What each gave."""
    folder, out = tmp_path / "in", []
    for n, batch in enumerate(batches):
        rocks.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = stream_of(serving.source(rocks, str(folder), rocks.read.parquet(str(folder)).schema, 100))
        serving.to_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
        rows = [tuple(r) for r in rocks.read.parquet(str(tmp_path / "out")).collect()]
        before = [r for b in out for r in b]
        for r in before:
            rows.remove(r)
        out.append(sorted(rows, key=repr))
    return out


def test_sessions_expire_and_give_way(rocks, tmp_path):
    at = lambda m: f"2024-01-01 {10 + m // 60:02}:{m % 60:02}:00"
    batches = [
        [("a", at(0)), ("b", at(5)), ("a", at(6))],
        [("c", at(8)), ("b", at(9))],  # over two sessions: b, quiet since 5, gives way, then a to b
        [("d", at(50))],  # b and c are quiet for over 30 minutes
        [("b", at(55)), ("d", at(56))],  # b begins anew
        [("z", at(200))],
        [("z", at(201))],
    ]
    stream = lambda df: stateful.held_sessions(df, most=2, shards=1, watermark="1 minute").select("session_id", "status", "requests")
    got = run(rocks, tmp_path, batches, "session_id string, ts string", stream)
    assert got[0] == [("a", "new", 2), ("b", "new", 1)]
    assert got[1] == [("a", "evicted", 2), ("b", "evicted", 1), ("b", "new", 1), ("c", "new", 1)]
    assert got[2] == [("b", "expired", 1), ("c", "expired", 1), ("d", "new", 1)]
    assert got[3] == [("b", "new", 1), ("d", "going on", 2)]
    assert sorted(got[4] + got[5]) == [("b", "expired", 1), ("d", "expired", 2), ("z", "going on", 2), ("z", "new", 1)]


def test_sessions_are_swept_by_the_watermark(rocks, tmp_path):
    """Shards that get no request any more are swept as well."""
    stream = lambda df: stateful.held_sessions(df, shards=64, watermark="1 minute").select("session_id", "status", "requests")
    got = run(rocks, tmp_path, [[(f"s{i}", "2024-01-01 10:00:00") for i in range(6)], [("late", "2024-01-01 12:00:00")], [("late", "2024-01-01 12:01:00")]], "session_id string, ts string", stream)
    assert sorted(got[0]) == [(f"s{i}", "new", 1) for i in range(6)]
    assert {r for r in got[1] + got[2] if r[1] == "expired"} == {(f"s{i}", "expired", 1) for i in range(6)}


def test_frames_wait_and_are_forgotten(rocks, tmp_path):
    batches = [[("s", 1, 'event: delta\ndata: {"a"'), ("t", 1, "data: 1\n\nda")], [("s", 2, ": 1}\n\ndata: [\ndata: 2]\n\ndata: {no\n\nevent: end\r\n"), ("s", 3, "data: 3\r\n\r\n")]]
    got = run(rocks, tmp_path, batches, "session_id string, seq long, text string", stateful.framed)
    assert got == [[("t", "message", "1")], [("s", "delta", '{"a": 1}'), ("s", "end", "3"), ("s", "message", "[\n2]")]]

    def short(df):
        time.sleep(2.5)
        return stateful.framed(df, 2)

    got = run(rocks, tmp_path / "short", [[("s", 1, "data: 1")], [("s", 2, "2\n\ndata: 3\n\n")]], "session_id string, seq long, text string", short)
    assert got == [[], [("s", "message", "3")]]  # "data: 1" was forgotten, "2" is no data


def test_stream_and_batch_frames_agree(rocks):
    texts = ['data: {"a": 1}\n\n', "event: x\ndata: 1\nevent: y\n\n", "data:\n\n", "data: NaN\n\n", "id: 3\n\n", "data: [1,\ndata: 2]\r\n\r\nleft", "", "\n\n", 'event:  z \ndata: "t"\n\n']
    rows = rocks.createDataFrame(list(enumerate(texts)), "i long, x string").select("i", ingest.frames(F.col("x")).alias("f")).collect()
    assert {r["i"]: [tuple(f) for f in r["f"]] for r in rows} == {i: stateful.frames_of(t)[0] for i, t in enumerate(texts)}


def test_memory_is_kept_and_forgotten(rocks, tmp_path):
    batches = [[(1, 0, "user", "q", "2024-01-01 10:00:00"), (1, 1, "assistant", "a", "2024-01-01 10:00:05"), (2, 0, "user", "x", "2024-01-01 10:01:00")], [(1, 2, "user", "r", "2024-01-01 10:10:00")], [(3, 0, "user", "y", "2024-01-01 12:00:00")], [(3, 1, "user", "z", "2024-01-01 12:01:00")], [(1, 3, "user", "again", "2024-01-01 12:02:00")]]
    stream = lambda df: stateful.memory(df, turns=1, watermark="1 minute")
    got = run(rocks, tmp_path, batches, "conv_id long, turn long, role string, text string, ts string", stream)
    assert got[0] == [(1, 1, "Student: q\nAssistant: a"), (2, 0, "Student: x")]
    assert got[1] == [(1, 2, "Assistant: a\nStudent: r")]
    assert {r for r in got[2] + got[3] if r[2] is None} == {(1, None, None), (2, None, None)}
    assert (1, 3, "Student: again") in got[4]
