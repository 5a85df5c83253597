import pytest
from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHING = ("slot", "shard", "kept", "digest", "print", "component_id", "blob", "findings", "version", "_key", "_KEY", "content", "salt", "keep_id", "sequence_id", "_blob", "_found", "ids", "start")
LONG = "lorem ipsum dolor sit amet " * 40_000

ROWS = [
    (1, "one two three four"), (2, None), (3, ""), (4, "one  two\nthree four"), (5, LONG), (5, LONG), (6, LONG + " end"), (None, "nobody's text"),
    (7, "secret = abcdef123456 and\ttoken:'x'"), (7, "another text of seven"), (8, " \n\t "), (9, "x" * 70_000), (10, "日本語 🙂 ünï\x1ccode"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in CLASHING if c != "_KEY"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
