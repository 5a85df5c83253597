"""State with timers and times to live, by transformWithState. It needs the RocksDB state store: see ready()."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.config import DEFAULTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


class HeldSessions(StatefulProcessor):
    """The sessions of one shard: a map of each to its last request and how many it had."""

    def __init__(self, idle_ms: int, most: int):
        self.idle, self.most = idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "session_id string", "last long, n long")

    def _row(self, session_id: str, status: str, n: int, last: int) -> tuple:
        return session_id, status, n, pd.Timestamp(last, unit="ms")

    def _known(self) -> dict[str, tuple[int, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.held.iterator()} if self.held.exists() else {}

    def _drop(self, session_id: str) -> None:
        self.held.removeKey((session_id,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = self._known(), []
        asked = sorted((int(at), s) for frame in rows for at, s in zip(frame["at"], frame["session_id"]))
        touched, begun = [], set()
        for at, s in asked:
            for old in [k for k, (last, _) in known.items() if at - last > self.idle]:  # sweep before each request
                last, n = known.pop(old)
                if old in touched:
                    touched.remove(old)
                    out.append(self._row(old, "new" if old in begun else "going on", n, last))
                out.append(self._row(old, "expired", n, last))
                self._drop(old)
                begun.discard(old)
            if s not in known:
                begun.add(s)
            last, n = known.get(s, (at, 0))
            known[s] = max(last, at), n + 1
            if s not in touched:
                touched.append(s)
            if len(known) > self.most:  # the one that was quiet longest
                old = min((k for k in known if k != s), key=lambda k: (known[k][0], k))
                last, n = known.pop(old)
                if old in touched:
                    touched.remove(old)
                    out.append(self._row(old, "new" if old in begun else "going on", n, last))
                out.append(self._row(old, "evicted", n, last))
                self._drop(old)
                begun.discard(old)
        for s in touched:
            last, n = known[s]
            self.held.updateValue((s,), (last, n))
            out.append(self._row(s, "new" if s in begun else "going on", n, last))
        self._sweep_at(known)
        yield pd.DataFrame(out, columns=["session_id", "status", "requests", "last_access"])

    def _sweep_at(self, known: dict[str, tuple[int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if known:
            self.handle.registerTimer(min(last for last, _ in known.values()) + self.idle + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, now = self._known(), timerValues.getCurrentWatermarkInMs()
        gone = {s: x for s, x in known.items() if now - x[0] > self.idle}
        for s in gone:
            self._drop(s)
        left = [last for s, (last, _) in known.items() if s not in gone]
        if left:
            self.handle.registerTimer(max(min(left) + self.idle + 1, now + 1))
        yield pd.DataFrame([self._row(s, "expired", n, last) for s, (last, n) in gone.items()], columns=["session_id", "status", "requests", "last_access"])

    def close(self) -> None:
        pass


def held_sessions(requests: DataFrame, idle_seconds: int = 1800, most: int = 5_000, shards: int = 16, watermark: str = DEFAULTS.watermark) -> DataFrame:
    """requests (session_id, ts): (session_id, status, requests, last_access) of each session that a micro-batch
    touched (new, going on), that was swept because its last request is over idle_seconds ago by the
    requests of its shard or by the watermark (expired), or that gave way because its shard held over `most`
    (evicted, the one that was quiet longest). Sessions are dealt to shards by a hash, so a shard's map is
    bounded by `most`; a null id is the session "". A session that expired begins anew with its next request."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = rows.select(F.coalesce("session_id", F.lit("")).alias("session_id"), F.unix_millis("ts").alias("at"), "ts")
    return rows.withColumn("shard", F.pmod(F.xxhash64("session_id"), F.lit(shards))).groupBy("shard").transformWithStateInPandas(
        HeldSessions(idle_seconds * 1000, most), "session_id string, status string, requests long, last_access timestamp", "append", "eventTime"
    )


def _not_a_number(name: str):
    raise ValueError(name)


def frames_of(text: str) -> tuple[list[tuple[str, str]], str]:
    """The (event, data) of the whole frames of a text, as sources.ingest.frames() has them, and what is left."""
    *whole, left = text.replace("\r\n", "\n").split("\n\n")
    out = []
    for block in whole:
        name, data = "message", []
        for line in block.split("\n"):
            if line.startswith("event:"):
                name = line[6:].strip()
            elif line.startswith("data:"):
                data.append(line[5:].strip())
        try:
            json.loads("\n".join(data), parse_constant=_not_a_number)
        except ValueError:
            continue
        out.append((name, "\n".join(data)))
    return out, left


class Frames(StatefulProcessor):
    """What a stream has sent of a frame that isn't complete. It is forgotten after a time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "text string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.left.get()[0] if self.left.exists() else ""
        chunks = pd.concat(list(rows)).sort_values("seq")
        found, left = frames_of(held + "".join(chunks["text"].fillna("")))
        if left:
            self.left.update((left,))
        elif held:
            self.left.clear()
        yield pd.DataFrame([(key[0], *f) for f in found], columns=["session_id", "event", "data"])

    def close(self) -> None:
        pass


def framed(chunks: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """chunks (session_id string, seq long, text) of event streams, cut anywhere: the frames that are complete
    so far: (session_id, event, data), as of sources.ingest.frames(). What isn't complete waits for the next
    chunk, ttl_seconds at most since the last one, so a session that never ends its frame costs nothing for long."""
    return chunks.groupBy("session_id").transformWithStateInPandas(Frames(ttl_seconds * 1000), "session_id string, event string, data string", "append", "processingTime")


class Memory(StatefulProcessor):
    """A conversation's last messages as a list, and a timer for when it was quiet too long."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "turn long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.lines.get()] if self.lines.exists() else []
        frame = pd.concat(list(rows))
        new = [(int(t), f"{'Student' if r == 'user' else 'Assistant'}: {x}") for t, r, x in zip(frame["turn"], frame["role"], frame["text"])]
        held = sorted(old + new)[-self.most :]
        self.lines.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(frame["at"].max()) + self.idle + 1)
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [held[-1][0]], "history": ["\n".join(x for _, x in held)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.lines.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "turn": pd.array([None], "Int64"), "history": [None]})

    def close(self) -> None:
        pass


def memory(messages: DataFrame, turns: int = DEFAULTS.history_turns, idle_seconds: int = 1800, watermark: str = DEFAULTS.watermark) -> DataFrame:
    """messages (conv_id long, turn long, role, text, ts): after each micro-batch, the last 2 * turns messages of
    the conversations that it touched, as one text: (conv_id, turn, history); once the watermark is past a
    conversation's last message by over idle_seconds, a row without a history: it is forgotten."""
    rows = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("conv_id").transformWithStateInPandas(Memory(2 * turns, idle_seconds * 1000), "conv_id long, turn long, history string", "append", "eventTime")
