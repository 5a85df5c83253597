"""Exact deduplication by skew-safe combining.

Texts are grouped by their whole content, with the digest only to spread them: equal texts of one task
are combined before anything is shuffled, then those of one digest and salt, then the winners of all
salts. The grouping key holds the text itself at each of these stages, so that two texts of one digest
never merge. A group of any size costs a task no more than one row for each salt and earlier task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.common import free_name, materialise

#: What one space replaces.
BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def groups(rows: DataFrame, salts: int) -> DataFrame:
    """rows (doc_id, content, digest) -> one row (digest, content, keep_id, group_size) for each text."""
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of docs, dropped ones too. keep_id is the
    smallest id of the row's group (null ids only if there are no others); of rows that repeat that id,
    one is kept. A null text is empty. Other columns aren't read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("content")).withColumn("digest", digest(F.col("content")))
    classes = groups(rows, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = materialise(classes, "exact-groups")
    one = classes.where("texts = 1").drop("texts")
    found = rows.drop("content").join(one, "digest")
    clashing = classes.where("texts > 1").select("digest")
    if clashing.limit(1).count():  # different texts of one digest
        apart = rows.join(clashing, "digest", "left_semi")
        found = found.unionByName(apart.join(groups(apart, salts), ["digest", "content"]).drop("content"))
    # by a struct, so that rows are dealt anew and the join before may split a hot digest
    again = F.row_number().over(Window.partitionBy(F.struct("digest", "doc_id", "keep_id", "group_size")).orderBy("doc_id"))
    return found.select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are."""
    marked = materialise(annotate(docs, doc_id, text, salts), "exact-marked")
    key, mark = free_name(docs, "_key"), free_name(docs, "_digest")
    keep = marked.where("kept").select(F.struct(F.col("doc_id").alias("id"), F.col("digest").alias("digest")).alias(key))
    own = F.struct(F.col(doc_id).alias("id"), sha256(normalised(F.col(text))).alias("digest"))
    kept = docs.withColumn(key, own).join(keep, key, "left_semi")
    if marked.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1).count():  # rows that repeat a kept id
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)
