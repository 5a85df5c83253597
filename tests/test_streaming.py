"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from quern.operators import chunk, control, usage
from quern.sources import tables
from quern.streaming import serving


@pytest.fixture
def folder(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(path)
    return path


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_sessions(spark, folder, tmp_path):
    batch = spark.read.parquet(folder)
    stream = serving.source(spark, folder, batch.schema, 100)
    query = serving.to_table(serving.sessions(stream).select("user_id", "started", "last_seen", "n"), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    want = rows(usage.sessions(batch, "ts", "user_id", "30 minutes").select("user_id", "started", "last_seen", "n"))
    assert got and set(got) <= set(want) and len(want) - len(got) < 20  # the last ones are still open


def test_rolling(spark, folder):
    batch = spark.read.parquet(folder)
    stream = serving.rolling(serving.source(spark, folder, batch.schema, 100), every="30 minutes")
    query = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("rolled")) == rows(usage.rolling(batch, "ts", ["event_type"], "1 hour", "30 minutes"))


def test_cache(spark, folder, tmp_path):
    keyed = lambda df: df.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts")
    batch = spark.read.parquet(folder)
    query = serving.to_table(serving.cache(keyed(serving.source(spark, folder, batch.schema, 100))), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(usage.ttl_cache(keyed(batch)))


def test_memory(spark, small, tmp_path):
    talk = spark.read.parquet(f"{small}/conversations.parquet").where("role <> 'system'")
    talk.write.parquet(str(tmp_path / "talk"))
    query = serving.to_table(serving.memory(serving.source(spark, str(tmp_path / "talk"), talk.schema, 100)), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    got = {r["conv_id"]: r["history"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["conv_id"]: r["history"] for r in control.history(talk, 5).collect()}


def test_incremental_index(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("source"), "text")
    chunks = chunk.split(docs).withColumn("id", chunk.chunk_id("c", F.col("source"), F.col("chunk_index")))
    path = str(tmp_path / "index")
    n = tables.append_new(chunks.where("source < 100"), path, "id")
    assert n == spark.read.parquet(path).count() > 0
    assert tables.append_new(chunks, path, "id") == chunks.count() - n
    assert tables.append_new(chunks, path, "id") == 0
    chunks.write.parquet(str(tmp_path / "stream"))
    for _ in range(2):
        serving.build_index(serving.source(spark, str(tmp_path / "stream"), chunks.schema, 100), path, "id", str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(path).count() == chunks.count()


def test_collections(spark, tmp_path):
    path = str(tmp_path / "vectors")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "collection string, id long").write.partitionBy("collection").parquet(path)
    assert tables.collection(spark, path, "a").count() == 2
    assert [tuple(r) for r in tables.drop_collection(spark, path, "a").collect()] == [("b", 1)]


def test_live_sessions_expire(spark, tmp_path):
    """Requests of three days: sessions begin anew after a pause, and what the watermark has passed is out."""
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", 0), ("a", 10), ("b", 20), ("a", 200), ("c", 400), ("b", 900), ("d", 2_000), ("d", 2_010), ("e", 4_000)]
    path = str(tmp_path / "r")
    for i, (s, minute) in enumerate(rows):
        spark.createDataFrame([(s, t0 + datetime.timedelta(minutes=minute))], "session_id string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(0.02 * (i > 0))
    stream = serving.live_sessions(serving.source(spark, path, "session_id string, ts timestamp", 1), 1800, "10 minutes")
    serving.to_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(200)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    seen = sorted((r["session_id"], r["status"]) for r in got)
    assert seen.count(("a", "new")) == 2 and seen.count(("a", "going on")) == 1 and seen.count(("b", "new")) == 2
    expired = [s for s, status in seen if status == "expired"]
    assert expired.count("a") == 2 and "c" in expired and "e" not in expired


def test_frames_across_chunks(spark, tmp_path):
    whole = 'event: session\ndata: {"id": 1}\n\nevent: delta\r\ndata: {"text": "a"}\r\n\r\n: ping\n\nevent: done\ndata: {}\n\nevent: cut'
    cuts = [0, 5, 16, 30, 33, 60, 75, 90, len(whole)]
    rows = [("s", i, whole[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "session_id string, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = serving.framed(serving.source(spark, str(tmp_path / "in"), "session_id string, seq long, text string", 100))
    serving.to_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(200)
    got = [(r["event"], r["data"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("session", '{"id": 1}'), ("delta", '{"text": "a"}'), ("done", "{}")]


def test_memory_is_forgotten(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    for i, (conv, turn, minute) in enumerate([(1, 0, 0), (2, 0, 300), (2, 1, 301), (1, 1, 302)]):
        spark.createDataFrame([(conv, turn, "user", f"t{turn}", t0 + datetime.timedelta(minutes=minute))], "conv_id long, turn long, role string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = serving.memory(serving.source(spark, str(tmp_path / "in"), "conv_id long, turn long, role string, text string, ts timestamp", 1), 5, "ts", 1800)
    serving.to_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(200)
    got = {(r["conv_id"], r["turn"]): r["history"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[2, 1] == "Student: t0\nStudent: t1" and got[1, 1] == "Student: t1"
