"""Chat formatting into budgeted windows.

A conversation's rows, numbered in the order of their turns, are dealt into blocks of BLOCK rows, so that
no task holds an unbounded conversation. Within a block, prefix sums of the turns' tokens choose the
longest run of whole turns that fits the budget. Each window after the first repeats the conversation's
system turn and as many of the turns before it as the history budget holds, those of the block before
included; of what is repeated, nothing is under the loss mask. A turn's tokens are those of its rendered
form; as turns begin with < and end with one line feed, the sums are the windows' token counts.

The template is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. Within texts, a
control string's first < gets a backslash after it, and a run of backslashes there gets one more, which
is undone by taking one away; in roles, backslashes and line feeds are escaped as well.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm import bpe
from quern.llm.common import materialise, parts

BLOCK, BUDGET, HISTORY = 1024, 1024, 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: No turn has fewer tokens.
LEAST_TOKENS = 4

WINDOWS = "conv_id {kind}, block long, window int, formatted string, loss array<struct<start: int, end: int>>, context_turns int, turns int, tokens long, over_budget boolean"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted window."""
    turns = [part.removeprefix(OPEN).split("\n", 1) for part in formatted.split(CLOSE)[:-1]]
    return [(unescape_role(role), unescape(text)) for role, text in turns]


def turn_of(role: str, text: str) -> tuple[str, str]:
    """A turn's rendered form: what stands before its escaped text, and from there on."""
    return f"{OPEN}{escape_role(role)}\n", escape(text)


def render(context: list[tuple[str, str]], turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted window and its loss spans: the texts of the assistant's turns that aren't context."""
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate([*context, *turns]):
        head, body = turn_of(role, text)
        if role == "assistant" and i >= len(context):
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += head, body, CLOSE
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), loss


def spans(tokens: np.ndarray, room: int, first_room: int) -> list[tuple[int, int]]:
    """Runs of whole turns of at most room tokens (first_room for the first run); a longer turn is a run
    by itself."""
    sums, out, at = np.r_[0, np.cumsum(tokens)], [], 0
    while at < len(tokens):
        limit = sums[at] + (room if out else first_room)
        end = max(at + 1, int(np.searchsorted(sums, limit, "right")) - 1)
        out.append((at, end))
        at = end
    return out


def _windows(rows: list[dict], budget: int, history: int) -> Iterator[dict]:
    """Of one block: its system row, the history that the block before hands on, then its turns."""
    system, past, own = ([r for r in rows if r["part"] == p] for p in (0, 1, 2))
    system_tokens = sum(r["tokens"] for r in system)
    room = max(1, budget - history - system_tokens)
    turns = [*past, *own]
    tokens = np.array([r["tokens"] for r in turns], "i8")
    sums = np.r_[0, np.cumsum(tokens)]
    for k, (a, b) in enumerate(spans(tokens[len(past) :], room, room if rows[0]["block"] else budget)):  # none, if the block before was the last
        a, b = a + len(past), b + len(past)
        since = int(np.searchsorted(sums, sums[a] - history, "left"))
        repeated = turns[since:a]
        lead = [r for r in system if r["place"] < turns[since]["place"]]
        context = [(r["role"], r["text"]) for r in [*lead, *repeated]]
        formatted, loss = render(context, [(r["role"], r["text"]) for r in turns[a:b]])
        total = int(sums[b] - sums[since]) + system_tokens * len(lead)
        yield {"conv_id": rows[0]["conv_id"], "block": rows[0]["block"], "window": k, "formatted": formatted, "loss": loss, "context_turns": len(context), "turns": b - a, "tokens": total, "over_budget": total > budget}


def numbered(rows: DataFrame, ranks: str) -> DataFrame:
    """rows (conv_id, turn, role, text): written with tokens, those of the rendered turn, and place, the
    number of a row in its conversation from 0, in the order of turn, role and text. Rows are sorted over
    all partitions and counted where they are; to that comes what partitions before have of the same
    conversation, which is asked of one conversation in each partition only. So a conversation may be
    spread over many tasks. Rows that tie on turn and role share a task, which sorts them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    sorted_ = turns.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, now, n = bpe.loaded(ranks, public_tokenizers.PATTERN), TaskContext.get().partitionId(), object(), 0
        for batch in (part for whole in batches for part in parts(whole)):
            ids = encoder.encode_batch(["".join((*turn_of(r, t), CLOSE)) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
            at = []
            for conv in batch.column(0).to_pylist():
                if conv != now:
                    now, n = conv, 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(at, pa.int64()), pa.array([task] * len(at), pa.int32())], ["conv_id", "role", "text", "tokens", "at", "task"])

    found = materialise(sorted_.mapInArrow(run, f"conv_id {kind}, role string, text string, tokens long, at long, task int"), "turns")
    own = F.struct("conv_id", "task").alias("own")  # a struct joins null to null
    counts = found.groupBy(own).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("own.conv_id").orderBy("own.task")) - F.col("n")
    shifts = counts.select("own", before.alias("before")).where("before > 0")  # at most one for each task
    return found.withColumn("own", own).join(F.broadcast(shifts), "own", "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "role", "text", "tokens")


def windows(rows: DataFrame, ranks: str, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """rows (conv_id, turn, role, text): -> WINDOWS, which by (conv_id, block, window) hold every turn
    once besides what they repeat. Turns are ordered by turn, then role and text: rows that tie on all
    are alike, and repeated rows are turns of their own. Null roles and texts are empty; a null conv_id is
    a conversation and a null turn comes first. A turn over the budget, however long, is a window by
    itself, marked as such. ranks: a file of bpe.py, for counting tokens. Other columns aren't read,
    whatever their names; an empty table has no windows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = numbered(rows, ranks)
    number = lambda c: F.floor(F.col(c) / block)
    to = lambda of, part: F.struct(of.cast("long").alias("block"), F.lit(part).alias("part"))
    fields = ["place", "role", "text", "tokens"]
    handed_on = F.col("place") % block >= block - max(1, history // LEAST_TOKENS)
    where = F.concat(F.array(to(number("place"), 2)), F.when(handed_on, F.array(to(number("place") + 1, 1))).otherwise(F.array()))
    conv = F.struct("conv_id").alias("conv")
    systems = turns.where("role = 'system'").groupBy(conv).agg(F.min(F.struct(*fields)).alias("s"))
    last = turns.groupBy(conv).agg(F.max(number("place")).alias("last"))
    lead = systems.join(last, "conv").select("conv.conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"), F.lit(0).alias("part"), *(F.col("s")[c].alias(c) for c in fields))
    dealt = turns.select("conv_id", F.explode(where).alias("to"), *fields).select("conv_id", "to.block", "to.part", *fields).unionByName(lead)
    sorted_ = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = (r for batch in batches for part in parts(batch) for r in part.to_pylist())
        ready: list[dict] = []
        for _, group in groupby(rows_, key=lambda r: (r["conv_id"], r["block"])):
            for w in _windows(list(group), budget, history):
                ready.append(w)
                if len(ready) >= 256:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(WINDOWS.format(kind=kind))
    schema = to_arrow_schema(spark_schema)
    return sorted_.mapInArrow(run, spark_schema)


@functools.cache
def _digest_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows say when read back, by conversation: each turn once, and all text under the loss
    mask. A digest is a running one over the conversation's windows in order, so that no conversation is
    held; one conversation's digest can't be split, whatever its length."""
    import hashlib

    kind = formatted.schema["conv_id"].dataType.simpleString()
    sorted_ = formatted.select("conv_id", "block", "window", "formatted", "loss", "context_turns").repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, schema, rows_ = [], None, iter(())

        def rows() -> Iterator[dict]:
            nonlocal schema
            for batch in batches:
                schema = schema or _digest_schema(batch.schema.field("conv_id").type)
                for part in parts(batch):
                    yield from part.to_pylist()

        for conv, group in groupby(rows(), key=lambda r: r["conv_id"]):
            turns, loss, n, chars, size, count = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for w in group:
                own = read(w["formatted"])[w["context_turns"] :]
                turns.update("".join(f"{role}\n{text}\n" for role, text in own).encode())
                masked = "".join(unescape(w["formatted"][s["start"] : s["end"]]) for s in w["loss"])
                loss.update(masked.encode())
                n, chars, size, count = n + len(own), chars + len(masked), size + len(w["formatted"]), count + 1
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return sorted_.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
