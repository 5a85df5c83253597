"""How five quality filters interact: what each removes first, again, or alone, in every order.

A: under LEAST_WORDS words. B: under half of the words distinct. C: over 3 % capital letters. D: holds a
symbol. E: the text of a smaller doc_id, wherever in the table and whether that one is removed or not.

Duplicates are found by sorting. Rows go to ranges of (fingerprint, doc_id), so that copies of one text,
however many, spread over tasks, and a range is sorted by fingerprint, whole text and doc_id; each row is
compared with the row before it. What a task can't see is a copy that ends the range before its own: each
task hands on the texts of its first and its last fingerprint, one row a text, and these few are compared
once more. So each document gets a mask of the filters that it fails, and from there on only counts move:
documents by part, mask and label, then their sums by order and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import materialise, parts

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: The bit of filter E in a mask; those of A to D are the lower ones.
SEEN = 16


def own_mask(text: bytes, chars: int) -> int:
    """The filters A to D that a text of so many code points fails, as bits."""
    words, size = text.split(), len(text)  # of bytes: just the white space of ASCII
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (size - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * chars
    return few | same << 1 | loud << 2 | (len(text.translate(None, SYMBOLS)) < size) << 3


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fingerprint: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask) for each row of docs: part is its lang ("" for null), mask has bit k for the
    k-th filter that it fails. A null text is empty; a null doc_id is greater than all others. Rows that
    repeat a doc_id don't fail E by each other. Texts of one fingerprint are told apart by the whole text.
    Other columns aren't read; an empty table gives no rows."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"))
    by_id = F.col("doc_id").asc_nulls_last()
    dealt = rows.withColumn("print", fingerprint(F.col("text"))).repartitionByRange("print", by_id)
    sorted_ = dealt.sortWithinPartitions("print", "text", by_id).select("doc_id", "part", "print", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, part, mask, task, edge, null, null) and, for the texts of the task's first and last
        fingerprints, rows (first doc_id, null, null, task, edge, print, text)."""
        task = TaskContext.get().partitionId()
        first_print, now, before, first_id, edge, ids, held = None, None, None, None, -1, pa.int64(), []

        def edges() -> pa.RecordBatch:
            some = [pa.array(c, k) for c, k in zip(zip(*held), (ids, pa.int64(), pa.int64(), pa.binary()))]
            none = lambda k: pa.nulls(len(held), k)
            return pa.RecordBatch.from_arrays([some[0], none(pa.string()), none(pa.int32()), pa.array([task] * len(held), pa.int32()), some[1], some[2], some[3].cast(pa.string())], names)

        names = ["doc_id", "part", "mask", "task", "edge", "print", "text"]
        for batch in (part for whole in batches for part in parts(whole)):
            ids, found, at = batch.column(0).type, [], []
            for i, p, t, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), pc.utf8_length(batch.column(3)).to_pylist()):
                if p != now:
                    if held and now == first_print:
                        yield edges()
                    first_print = p if now is None else first_print
                    now, held, before = p, [], None
                if t != before:
                    before, first_id, edge = t, i, edge + 1
                    held.append((i, edge, p, t))
                known = i != first_id
                found.append(own_mask(t, n) | SEEN * known)
                at.append(edge if p == first_print and not known else None)
            k = len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array([task] * k, pa.int32()), pa.array(at, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names)
        if held:
            yield edges()

    all_ = materialise(sorted_.mapInArrow(run, f"doc_id {kind}, part string, mask int, task int, edge long, print long, text string"), "filter-masks")
    edges = all_.where("mask is null").select("task", "edge", "print", "text", "doc_id")
    least = edges.groupBy("print", "text").agg(F.min("doc_id").alias("least"))
    again = edges.join(least, ["print", "text"]).where(~F.col("doc_id").eqNullSafe(F.col("least"))).select("task", "edge", F.lit(SEEN).alias("more"))
    open_ = all_.where("mask is not null and edge is not null").join(again.distinct(), ["task", "edge"], "left")
    open_ = open_.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0))).alias("mask"))
    return all_.where("mask is not null and edge is null").select("doc_id", "part", "mask").unionByName(open_)


def counters(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """marked (doc_id, part, mask), labels (doc_id, quality, toxic): (part, mask, n, good, toxic), additive.
    A document without a label is neither; of labels that repeat an id, one that says 1 counts."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(f"is_{c}") for c in ("quality", "toxic")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    known = marked.join(told.withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    return known.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("is_quality").alias("good"), total("is_toxic").alias("toxic"))


def by_order(counts: DataFrame) -> DataFrame:
    """counters() -> one row for each part, order and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley)."""
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    steps = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("bits", F.transform(F.split("filter_order", ""), bit))
    steps = steps.withColumn("own", F.element_at("bits", F.col("step"))).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b)))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    sums = {"kept": total(~fails & ~gone), "removed": total(fails & ~gone), "redundant": total(fails & gone), "unique_fails": total(F.col("mask") == F.col("own")), "good_lost": total(fails & ~gone, "good"), "toxic_lost": total(fails & ~gone, "toxic")}
    steps = steps.groupBy("part", "filter_order", "step", "own").agg(*(c.alias(k) for k, c in sums.items()))
    shapley = steps.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "own"]).drop("own")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """by_order() of docs; see masks() and counters() for what they make of nulls, ties and repeated rows.
    An empty table has no parts and so no rows."""
    return by_order(materialise(counters(masks(docs, doc_id, text, lang), labels), "filter-counts"))
