"""From raw documents to packed training sequences: quality rules, exact dedup, near-dedup,
secret scans, packing. Each stage's documents are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import exact_dedup, quality, queries, secret_scan, simhash_long
from quern.llm.common import materialise, new_path
from quern.llm.packing import pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text has too few words and goes. Each row is judged by
    its own whole text, however long, so ties and repeated rows need no rule."""
    return docs.where(quality.verdict(F.col("text"))["kept"])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id stays. Null is an empty
    text; a null id stays only if its text has no other; of rows that repeat the id and text that stay, one does."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 or more of their 5-word shingles, the document with the
    smallest id stays. Texts without words are one component; rows that repeat an id stay or go together; rows
    without an id are linked by equal shingles only, as nothing tells their texts apart for the comparison."""
    return simhash_long.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets go, the documents stay, all rows and repeated ones too; of spans that overlap the first one names
    the kind. A null text stays null. n_chars, where docs has it, is that of the new text."""
    clean = secret_scan.redact(docs, new_path(spark, "ledger"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence, with its tokens. A null or empty text is the closing
    id alone; each row is a document by itself, repeated ids and null ids too; a text of any length is cut."""
    return pack(docs, queries.TOKENIZER, cached=60_000).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("simhash near-dedup", near_duplicates), ("secret scans", secrets), ("packing", packing)]

#: SQL expresses neither the compression bands nor the shingles' similarity or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
