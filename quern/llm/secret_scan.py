"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Each version of a text is addressed by its content (a blob). The ledger is a Parquet table of findings
by blob, in one folder for each version of the rules. A scan asks the ledger which blobs of the given
paths it hasn't seen under the present rules, scans one copy of each of those, appends what it found
(finding nothing is a row, too) and joins all paths to the findings of their blobs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import free_name, materialise

#: Unseen blobs, and blobs with findings, are broadcast up to these numbers; beyond them they are joined by a
#: shuffle that can spill.
UNSEEN_ROWS, BROADCAST_ROWS = 10_000, 100_000

FINDINGS = "array<struct<start: bigint, place: int, end: bigint, kind: string>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which equal starts are listed. A run that is too short has no longer
#: run within it, so the last two ask for the length in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _ends(lengths: Column) -> Column:
    """Running sums of an array. Summed within runs of 128 first, so that an array of n costs about
    n**1.5 and not n**2."""
    step = 128
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda i: F.slice(lengths, i * step + 1, F.lit(step)))

    def sums(array: Column) -> Column:
        return F.aggregate(array, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    return F.aggregate(runs, F.array().cast("array<bigint>"), lambda a, run: F.concat(a, F.transform(sums(run), lambda x: x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))


def _matches(text: Column, rule: Rule, place: int) -> Column:
    """FINDINGS of one rule. What a split leaves and what it takes out alternate, so running sums of
    their lengths give the places, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # struct(end, length, length of the group) by match
    lengths = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("before"), found.alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("group"))
    ends = _ends(F.transform(lengths, lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("bigint")))
    spans = F.transform(F.arrays_zip(lengths.alias("x"), ends.alias("end")), lambda y: F.struct(
        (y["end"] - F.length(y["x"]["match"])).cast("bigint").alias("start"), F.lit(place).alias("place"), y["end"].alias("end"),
        F.when(F.length(y["x"]["group"]) >= rule.least, F.lit(rule.kind)).alias("kind")))
    return F.when(text.rlike(rule.pattern), F.filter(spans, lambda s: s["kind"].isNotNull())).otherwise(F.array().cast(FINDINGS))


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """FINDINGS of a text by start, then by the rules' order."""
    return F.array_sort(F.concat(*(_matches(text, rule, i) for i, rule in enumerate(rules))))


def scan(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, findings) for each row of docs; ledger: a folder on shared storage, new or from an
    earlier scan. A null text is empty. Repeated rows and rows of equal texts share a blob, which is
    scanned once; if jobs that were broken off or ran at once left a blob twice in the ledger, one entry
    counts. A text of any length is scanned as a whole, in one row of a task. An empty table gives no rows
    and leaves the ledger as it is. Other columns, whatever their names, aren't read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialise(rows.select("doc_id", "blob"), "paths")
    place = f"{ledger.rstrip('/')}/rules={rules_version(rules)}"
    known = spark.range(0).select(F.lit(None).cast("string").alias("blob"), F.lit(None).cast(FINDINGS).alias("findings"))
    known.write.mode("append").parquet(place)
    entries = spark.read.schema(known.schema).parquet(place)
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(entries, "blob", "left_anti")
    unseen = materialise(unseen.select(F.struct("doc_id", "blob").alias("version")), "unseen")
    n = unseen.limit(UNSEEN_ROWS + 1).count()
    if n:  # else no text is read again
        texts = rows.select("blob", "text", F.struct("doc_id", "blob").alias("version")).join(F.broadcast(unseen) if n <= UNSEEN_ROWS else unseen, "version", "left_semi")
        new = texts.select("blob", findings(F.col("text"), rules).alias("findings")).dropDuplicates(["blob"])
        new.write.mode("append").parquet(place)
    # by a struct, so that entries are dealt anew and the join may split a hot blob
    entries = spark.read.schema(known.schema).parquet(place).groupBy(F.struct("blob").alias("of")).agg(F.first("blob").alias("blob"), F.first("findings").alias("findings"))
    return paths.join(entries, "blob").select("doc_id", "blob", "findings")


def spans(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined; kinds: all, or just these."""
    if kinds is not None:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with <kind> for each finding; overlapping ones become one."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.concat(done["out"], text.substr(done["at"].cast("int") + 1, (s["start"] - done["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], gap).otherwise(done["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda done: F.concat(done["out"], text.substr(done["at"].cast("int") + 1, F.length(text))))


def redact(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secrets out of its texts; all other rows and columns as they are."""
    hits = scan(docs, ledger, doc_id, text, rules).where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    blob, found = free_name(docs, "_blob"), free_name(docs, "_found")
    hits = materialise(hits.select(F.col("blob").alias(blob), F.col("findings").alias(found)), "hits")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and hits.agg(F.coalesce(F.sum(F.size(found)), F.lit(0))).first()[0] <= 10 * BROADCAST_ROWS
    marked = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(F.broadcast(hits) if few else hits, blob, "left")
    clean = F.when(F.col(found).isNotNull(), redacted(F.col(text), F.col(found))).otherwise(F.col(text))
    return marked.withColumn(text, clean).select(*docs.columns)
