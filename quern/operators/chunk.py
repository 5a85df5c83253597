"""Splitting texts into overlapping chunks with stable ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.config import DEFAULTS
from quern.functions.text import uuid5
from quern.operators.numbering import numbered

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def pieces(text: str, separator: str) -> list[str]:
    """Split so that each separator begins the piece after it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def split_text(text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """By the first separator that occurs: pieces shorter than size are joined up to it, with at most
    overlap characters carried over; a longer one is split by the separators that follow."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in pieces(text, separators[at]):
        if len(piece) >= size and separators[at]:
            flush()
            held, length = [], 0
            out += split_text(piece, size, overlap, separators[at + 1 :])
            continue
        if length + len(piece) > size and held:
            flush()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    flush()
    return out


def split(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """docs (source, text): -> (source, chunk_index, page_content). No shuffle; each text on its own."""
    kind = docs.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, i, c) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for i, c in enumerate(split_text(t, size, overlap))]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["source", "chunk_index", "page_content"])

    return docs.select("source", "text").mapInArrow(run, f"source {kind}, chunk_index int, page_content string")


def with_ordinal(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """The place of each row in its source, from 0. A source of any size spreads over tasks."""
    return numbered(rows, list(order), (by,), "chunk_index", "ordinals").withColumn("chunk_index", F.col("chunk_index").cast("int"))


def chunk_id(collection: str, source: Column, index: Column) -> Column:
    return uuid5(F.concat(F.lit(f"{collection}:"), source.cast("string"), F.lit("#"), index.cast("string")))


def not_stored(chunks: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """What an interrupted build has still to do."""
    return chunks.join(stored.select(key), key, "left_anti")


def size_stats(chunks: DataFrame, text: Column) -> DataFrame:
    size = F.length(text)
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.floor(F.avg(size)).cast("long").alias("avg_size"), F.min(size).cast("long").alias("min_size"), F.max(size).cast("long").alias("max_size"))
