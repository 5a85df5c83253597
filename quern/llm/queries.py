"""The queries of the operators of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm import bpe, chat, exact_dedup, filter_audit, langid, packing, quality, runs, secret_scan, sharding, simhash, suffix_dedup, toxicity
from quern.llm.common import new_path, small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = [f"shard-{i:04d}" for i in range(256)]
BASE_KINDS = ("assign", "access", "hex")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), new_path(spark, "ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(secret_scan.spans(F.col("findings"), BASE_KINDS), 256).alias("base_sha256"), secret_scan.spans(F.col("findings")).alias("spans"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(told))
    return chat.digests(chat.windows(rows.union(more), RANKS))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.annotate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.annotate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(small_batches(spark), sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), RANKS).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), RANKS).alias("decoded"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(small_batches(spark), sf_dir, "documents"))


def pieces(docs: DataFrame) -> DataFrame:
    found = packing.pack(docs, TOKENIZER)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told, _ = langid.identify(docs, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), told.alias("told"))
    return rows.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), "told.score", "told.rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", quality.verdict(F.col("text")).alias("v"))
    return rows.select("doc_id", "v.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", runs.periodic(F.col("text"), F.col("doc_id")).alias("p"))
    lines = F.transform("p.runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    told = own.select("doc_id", F.size("p.runs").cast("long").alias("n_runs"), runs.longest(F.col("p.runs")).alias("top"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("p.collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    return told.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli, "runs_sha256", "collapsed_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.annotate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_windows, op3_sharding, op4_simhash, op5_exact_dedup, op6_bpe, op7_packing, op8_langid, op9_quality, op10_toxicity, op11_periodic_runs, op12_filter_audit, op13_suffix_dedup)}

ASSIGN, ACCESS, HEX = (rule.pattern.replace("'", "''") for rule in secret_scan.RULES)

ORACLE_SQL = {
    "op1_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 'assign' AS kind, 0 AS place, 6 AS least, string_split_regex(t, '{ASSIGN}') AS pieces, regexp_extract_all(t, '{ASSIGN}', 0) AS hits, regexp_extract_all(t, '{ASSIGN}', 2) AS inner_hits FROM d
  UNION ALL SELECT doc_id, 'access', 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 24, string_split_regex(t, '[0-9a-f]{{8,}}'), regexp_extract_all(t, '[0-9a-f]{{8,}}', 0), regexp_extract_all(t, '[0-9a-f]{{8,}}', 0) FROM d
),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0),
placed AS (
  SELECT doc_id, kind, place, len(hits[i]) AS n,
    list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS start
  FROM numbered WHERE len(inner_hits[i]) >= least
),
spans AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, place) AS spans
  FROM placed GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spans USING (doc_id)
""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
""",
    "op12_filter_audit": r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order, 0 AS n
  UNION ALL SELECT filter_order || f, n + 1 FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(f) WHERE n < 5 AND NOT contains(filter_order, f)
),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step-1] AS earlier FROM orders, range(1, 6) AS r(step) WHERE n = 5),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS failed
  FROM d LEFT JOIN l USING (doc_id)
),
counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM fails GROUP BY ALL),
told AS (
  SELECT *, contains(failed, f) AS own, regexp_matches(failed, '[' || earlier || '0]') AS gone FROM counts, steps
),
sums AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM sums
""",
}
