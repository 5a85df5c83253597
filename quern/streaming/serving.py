"""The stateful parts of a service, as Structured Streaming over the same operators as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.config import DEFAULTS
from quern.operators import usage
from quern.sources.tables import append_new


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder (or one file by its name) of Parquet files as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", idle: str = DEFAULTS.session_idle, watermark: str = DEFAULTS.watermark) -> DataFrame:
    """Closed sessions, in append mode: one is out once the watermark has passed its end."""
    return usage.sessions(events.withWatermark(ts, watermark), ts, by, idle)


def rolling(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("event_type",), length: str = "1 hour", every: str = "1 minute", watermark: str = DEFAULTS.watermark) -> DataFrame:
    return usage.rolling(events.withWatermark(ts, watermark), ts, list(by), length, every)


def cache(lookups: DataFrame, seconds: int = DEFAULTS.cache_seconds, watermark: str = DEFAULTS.watermark) -> DataFrame:
    """lookups (key string, seq long, ts): -> (key, seq, hit), with one stored time for each key. The rows of
    a micro-batch are walked in their order; an entry past its time is a miss and is stored anew. An entry
    whose time the watermark has passed is dropped."""

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        hits = []
        for at in rows["at"]:
            hits.append(until >= at)
            if not hits[-1]:
                until = at + seconds * 1_000_000
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "hit": hits})

    rows = lookups.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).select("key", "seq", F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("key").applyInPandasWithState(walk, "key string, seq long, hit boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def memory(messages: DataFrame, turns: int = DEFAULTS.history_turns, ts: str | None = None, idle_seconds: int = 1800, watermark: str = DEFAULTS.watermark) -> DataFrame:
    """messages (conv_id long, turn long, role, text): after each micro-batch, the last 2 * turns messages of
    the conversations that it touched, as one text: (conv_id, turn, history). With a column of times, ts, a
    conversation is forgotten when the watermark is past its last message by idle_seconds; without one,
    times can't tell and all are held."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = list(zip(state.get[0], state.get[1])) if state.exists else []
        rows = [r for f in frames for r in f.itertuples()]
        new = [(int(r.turn), f"{'Student' if r.role == 'user' else 'Assistant'}: {r.text}") for r in rows]
        held = sorted(old + new)[-2 * turns :]
        state.update(([t for t, _ in held], [x for _, x in held]))
        if ts:
            last = max(pd.Timestamp(getattr(r, ts)).timestamp() for r in rows)
            state.setTimeoutTimestamp(max(int((last + idle_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [held[-1][0]], "history": ["\n".join(x for _, x in held)]})

    if ts:
        messages = messages.withWatermark(ts, watermark)
    return messages.groupBy("conv_id").applyInPandasWithState(keep, "conv_id long, turn long, history string", "turns array<long>, lines array<string>", "append", GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout)


def live_sessions(requests: DataFrame, idle_seconds: int = 1800, watermark: str = DEFAULTS.watermark) -> DataFrame:
    """requests (session_id, ts): what becomes of each session with a micro-batch: (session_id, status: new,
    going on or expired, requests, last_access). A session expires when the watermark is past its last
    request by more than idle_seconds; a later request begins a new one."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda status, n, last: pd.DataFrame({"session_id": [key[0]], "status": [status], "requests": [n], "last_access": [pd.Timestamp(last, unit="us")]})
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield row("expired", n, last)
            return
        begun = not state.exists
        n, last = (0, 0) if begun else state.get
        for at in sorted(int(x) for frame in frames for x in frame["at"]):
            if n and at - last > idle_seconds * 1_000_000:  # before the watermark told
                if begun:
                    yield row("new", n, last)
                yield row("expired", n, last)
                n, begun = 0, True
            n, last = n + 1, max(last, at)
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield row("new" if begun else "going on", n, last)

    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).select("session_id", F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, status string, requests long, last_access timestamp", "requests long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def framed(chunks: DataFrame) -> DataFrame:
    """chunks (session_id string, seq long, text) of event streams, cut anywhere: the frames that are complete
    so far: (session_id, event, data). What isn't complete waits for the next chunk; what has no data is
    skipped."""

    def join(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        *whole, held = (held + "".join(rows["text"])).replace("\r\n", "\n").split("\n\n")
        state.update((held,))
        found = []
        for block in whole:
            lines = [line.partition(":")[::2] for line in block.split("\n")]
            named = {k: v.strip() for k, v in reversed(lines)}
            if "data" in named:
                found.append((key[0], named.get("event", ""), named["data"]))
        yield pd.DataFrame(found, columns=["session_id", "event", "data"])

    return chunks.groupBy("session_id").applyInPandasWithState(join, "session_id string, event string, data string", "held string", "append", GroupStateTimeout.NoTimeout)


def build_index(chunks: DataFrame, path: str, key: str, checkpoint: str):
    """Append the rows of a stream whose key the table doesn't have yet; a batch that is run again adds
    nothing."""
    return chunks.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that there is now, into a Parquet table."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
