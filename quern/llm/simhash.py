"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 3 bits agree in at least 5 of their 8 bytes: that is the
guaranteed minimum of matches. Of any 5 positions, 3 lie in one half of the 8; so the index posts each
print under the 8 ways to choose 3 positions of a half, with their bytes. Within a list the equal bytes
of each pair are tallied, pairs that reach the minimum are retained and their bits verified.

A list of over LONG prints is not compared: its prints are posted again under 2 more positions (a pair
that has 5 in common has 2 outside of the 3), and if a list is still too long, under 3 of the 6 nibbles
that are left (3 bits differ in 3 nibbles at most), where no list can have more than 4,096 distinct
prints. So no task holds more than LONG prints of a list and no pair is left out. Equal fingerprints are
one entry. A list gives a star for each of its components, not its pairs; the links over all lists have
the components that all links between fingerprints have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import each, free_name, materialise
from quern.llm.components import components

SEED, BYTES, MOST_BITS = 42, 8, 3
#: Shingles hashed at a time, so that a text of any length takes bounded memory.
AT_ONCE = 1 << 16
#: Lists up to this length are compared; longer ones are posted under more positions.
LONG = 4096
#: Rows of a list whose bytes are compared with all of it at a time.
BLOCK = 64
#: Long lists are broadcast up to this number; beyond it postings are shuffled to them.
BROADCAST_LISTS = 100_000


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Bit b is set if it is in over half of the shingles' hashes; 0 without words. Signed."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and just the white space of ASCII
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    total, shingles = np.zeros(64, "i8"), max(1, len(words) - width + 1)
    for at in range(0, shingles, AT_ONCE):
        part = words[at : at + AT_ONCE + width - 1]
        runs = zip(*(part[i:] for i in range(width))) if len(part) >= width else [part]
        hashes = b"".join([digest(b" ".join(run), SEED) for run in runs])
        total += np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, BYTES), axis=1).sum(0, dtype="i8")
    return int(np.packbits(2 * total > shingles).view(">i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """long: the fingerprint of a whole text; 0 for a text that is null or has no words."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, width) for t in each(texts)], pa.int64())

    return run(text)


def masks() -> list[int]:
    """The bits of 3 positions of a half, for each choice."""
    return [sum(0xFF << 8 * i for i in c) for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def finer(mask: int) -> list[int]:
    """The masks that a long list of a mask is dealt to: 2 more bytes, then 3 nibbles of what is left."""
    free = [i for i in range(BYTES) if not mask >> 8 * i & 0xFF]
    if len(free) > MOST_BITS:
        return [mask | sum(0xFF << 8 * i for i in c) for c in combinations(free, len(free) - MOST_BITS)]
    nibbles = [0xF << 4 * i for i in range(2 * BYTES) if not mask >> 4 * i & 0xF]
    return [mask | sum(c) for c in combinations(nibbles, MOST_BITS)] if len(nibbles) > MOST_BITS else []


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label: the root of each place, roots being least: with the links (a, b) as well."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def local_components(prints: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """For distinct prints: the place of the first print in the component of each."""
    n = len(prints)
    label, own = np.arange(n), np.ascontiguousarray(prints).view("u1").reshape(n, BYTES)
    for at in range(0, n, BLOCK):
        tally = (own[at : at + BLOCK, None] == own[None, at:]).sum(-1, dtype="u1")
        a, b = np.nonzero(tally >= BYTES - most_bits)
        a, b = a + at, b + at
        near = (a < b) & (np.bitwise_count(prints[a] ^ prints[b]) <= most_bits)
        unite(label, a[near], b[near])
    return label


def _stars(lists: DataFrame, most_bits: int) -> DataFrame:
    """lists (print, mask, key): the stars (a, b) of the components within each list."""
    sorted_ = lists.select("print", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key", "print")

    def stars(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(rows)])
        own = rows[:, 2].view("u8")
        pair = begin[size == 2]
        pair = pair[np.bitwise_count(own[pair] ^ own[pair + 1]) <= most_bits]
        a, b = [own[pair]], [own[pair + 1]]
        for at, n in zip(begin[size > 2], size[size > 2]):
            some = np.sort(own[at : at + n])
            place = local_components(some, most_bits)
            (rest,) = np.nonzero(place != np.arange(n))
            a.append(some[place[rest]])
            b.append(some[rest])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view("i8")) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists((np.stack([batch.column(i).to_numpy() for i in (1, 2, 0)], axis=1) for batch in batches), 2):
            yield stars(rows)

    return sorted_.mapInArrow(run, "a long, b long")


def whole_lists(batches: Iterator[np.ndarray], keys: int) -> Iterator[np.ndarray]:
    """Sorted rows, dealt anew so that the rows of a list (equal in the first `keys` columns) come together.
    It holds one list, and the lists that end in a batch."""
    held: list[np.ndarray] = []
    for rows in batches:
        if not len(rows):
            continue
        if held and (held[0][0, :keys] != rows[0, :keys]).any():
            yield np.concatenate(held)
            held = []
        (other,) = np.nonzero((rows[:, :keys] != rows[-1, :keys]).any(1))
        if len(other):
            yield np.concatenate([*held, rows[: other[-1] + 1]])
            held, rows = [], rows[other[-1] + 1 :]
        held.append(rows)
    if held:
        yield np.concatenate(held)


def links(prints: DataFrame, most_bits: int = MOST_BITS, long: int = LONG) -> DataFrame:
    """prints: distinct longs in column print. Distinct links (a, b), b > a unsigned, with the
    components of all pairs that differ in at most most_bits (0 to 3) bits."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"{MOST_BITS} differing bits at most leave enough equal bytes")
    out, level, now = None, masks(), prints.select("print", F.explode(F.array(*map(F.lit, map(_signed, masks())))).alias("mask"))
    while True:
        now = now.withColumn("key", F.col("print").bitwiseAND(F.col("mask"))).withColumn("list", F.struct("mask", "key"))
        level = [(m, more) for m in level if (more := finer(m))]
        rest = None
        if level:  # else no list can be long
            too_long = materialise(now.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select("list"), "long-lists")
            n = too_long.limit(BROADCAST_LISTS + 1).count()
            if n:
                too_long = F.broadcast(too_long) if n <= BROADCAST_LISTS else too_long
                rest, now = now.join(too_long, "list", "left_semi"), now.join(too_long, "list", "left_anti")
        found = _stars(now, most_bits)
        out = found if out is None else out.unionByName(found)
        if rest is None:
            return out.distinct()
        deal = F.create_map(*(x for m, more in level for x in (F.lit(_signed(m)), F.array(*map(F.lit, map(_signed, more))))))
        now = materialise(rest.select("print", F.explode(F.element_at(deal, F.col("mask"))).alias("mask")).distinct(), "long-postings")
        level = sorted({m for _, more in level for m in more})


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, print, component_id) for each row of docs. component_id: the smallest doc_id that links
    of at most most_bits differing bits reach, itself included; null only where all ids are null.
    Texts that are null or have no words have fingerprint 0 and are linked like any other. Repeated rows
    are rows of one fingerprint. Other columns aren't read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("print"))
    rows = materialise(rows, "prints")
    classes = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")), "print-classes")
    found = components(materialise(links(classes.select("print"), most_bits), "print-links"))
    named = classes.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = ids.select(F.struct("component").alias("of"), "component_id")  # by a struct: dealt anew, so that the join may split a large component
    named = named.withColumn("of", F.struct("component")).join(ids, "of").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", "print", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs whose id is that of their component, with their columns as they are. doc_id is a
    key: rows that repeat one stay or go together."""
    key = free_name(docs, "_key")
    keep = annotate(docs, doc_id, text, width, most_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.struct(F.col("doc_id").alias("id")).alias(key)).distinct()
    return docs.withColumn(key, F.struct(F.col(doc_id).alias("id"))).join(keep, key, "left_semi").select(*docs.columns)
