"""The whole batch flow: index once, then questions to contexts and answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern import models
from quern.config import DEFAULTS, Config
from quern.functions import documents, text as tx
from quern.operators import chunk, context, control, dense, entities, fusion, lexical, select
from quern.sources.tables import materialise


@dataclass
class Models:
    """What a deployment replaces; each has a deterministic offline stand-in. embed(text): a vector;
    split(question, most): its sub-queries; rerank(question, title, text): a score or null, null for a
    question meaning that the reranker failed; extra(question): a passage that a dense arm of its own
    looks for; answer(texts, sources); decide: see operators.control; rewrite(question, history): a rewriter's
    reply, see models.rewritten(); judge(answer, context): a share that is supported."""

    embed: Callable[[Column], Column] = models.embed
    split: Callable[[Column, int], Column] = models.subqueries
    rerank: Callable[[Column, Column, Column], Column] = models.rerank
    answer: Callable[[Column, Column], Column] = models.answer
    extra: Callable[[Column], Column] | None = None
    decide: Callable[[DataFrame], DataFrame] = control.lexical_controller
    rewrite: Callable[[Column, Column], Column] | None = None
    judge: Callable[[Column, Column], Column] = models.support


@dataclass
class Engine:
    """chunks (doc_id, source, chunk_index, page_content, title, url, filename, category), vectors (vec_id,
    embedding); doc_id and vec_id are the same numbers."""

    chunks: DataFrame
    vectors: DataFrame
    words: lexical.Index
    entities: entities.Entities | None = None
    models: Models = field(default_factory=Models)
    config: Config = DEFAULTS


def build(sources: DataFrame, config: Config = DEFAULTS, own: Models | None = None, tokenise: Callable[[str], list[str]] = lexical.words, index_text: Column | None = None, scoped: bool = True) -> Engine:
    """sources (source, text, and as far as known title, url, filename, category): split, numbered, embedded
    and counted, as written tables. index_text: what BM25 sees of a chunk, its text if not given."""
    own = own or Models()
    about = [F.col(c).cast("string").alias(c) if c in sources.columns else F.lit(None).cast("string").alias(c) for c in context.ABOUT]
    chunks = chunk.split(sources.select("source", "text"), config.chunk_size, config.chunk_overlap)
    chunks = chunks.join(sources.select("source", *about), "source").withColumn("doc_id", F.xxhash64("source", "chunk_index"))
    chunks = materialise(chunks, "chunks")
    vectors = materialise(chunks.select(F.col("doc_id").alias("vec_id"), own.embed(F.col("page_content")).alias("embedding")), "vectors")
    named = None
    if scoped:
        seq = F.struct(F.col("source").cast("string"), "chunk_index")
        named = entities.build(chunks.withColumn("seq", F.xxhash64(seq)).withColumn("source", F.col("source").cast("string")), F.col("page_content"), config)
        named = entities.Entities(*(materialise(df, "entities") for df in (named.codes, named.programs, named.people)))
    return Engine(chunks, vectors, lexical.build(chunks, F.col("page_content") if index_text is None else index_text, tokenise), named, own, config)


def ready(spark: SparkSession, paths: dict[str, str]) -> None:
    """Fail at once, and say so, if a table that an engine needs isn't there."""
    for name, path in paths.items():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(f"{name} is not at {path}")


def sub_queries(engine: Engine, questions: DataFrame) -> DataFrame:
    """questions (query_id, text, maybe sub_queries, history): -> (query_id, sub_idx, sub_id, text, question,
    n_subs, fallback), at least one of each question. With a rewriter, its sub-queries; fallback says that its
    reply couldn't be used and the raw question stands."""
    most = engine.config.max_subqueries
    parts, fallback = engine.models.split(F.col("text"), most), F.lit(False)
    if engine.models.rewrite is not None:
        history = F.col("history") if "history" in questions.columns else F.lit("")
        questions = materialise(questions.withColumn("_reply", models.rewritten(F.col("text"), engine.models.rewrite(F.col("text"), history), most)), "rewritten")
        parts, fallback = F.col("_reply.sub_queries"), F.col("_reply.fallback")
    if "sub_queries" in questions.columns:
        parts = F.when(F.size("sub_queries") > 0, F.slice("sub_queries", 1, most)).otherwise(parts)
    asked = questions.select("query_id", F.col("text").alias("question"), fallback.alias("fallback"), F.when(F.size(parts) > 0, parts).otherwise(F.array("text")).alias("parts"))
    rows = asked.select("query_id", "question", "fallback", F.size("parts").alias("n_subs"), F.posexplode("parts").alias("sub_idx", "text"))
    return materialise(rows.withColumn("sub_id", F.col("query_id") * (most + 1) + F.col("sub_idx")), "subqueries")


def lists(engine: Engine, subs: DataFrame) -> DataFrame:
    """(query_id, sub_idx, key, rank, fusion_score, dense_rank, bm25_rank, scoped, n_subs): each sub-query's
    candidates: both arms fused, wider for a question of one sub-query; before them what the entities
    that it names have and they don't. A dense arm of its own has the origin n_subs."""
    config, own = engine.config, engine.models
    ids = subs.select(F.col("sub_id").alias("query_id"), "text", "query_id", "sub_idx", "n_subs").toDF("query_id", "text", "of", "sub_idx", "n_subs")
    single = F.col("n_subs") == 1
    known = ids.select("query_id", "of", "sub_idx", "n_subs")
    narrow = lambda df, one, many: df.join(lexical.bounded(known), "query_id").where(F.col("rank") <= F.when(single, one).otherwise(many)).drop("of", "sub_idx", "n_subs")
    sparse = lexical.search(engine.words, ids, F.col("text"), max(config.sparse_k, config.multi_k), config).withColumnRenamed("doc_id", "key")
    near = dense.nearest(engine.vectors, ids.select("query_id", own.embed(F.col("text")).alias("embedding")), max(config.dense_k, config.multi_k)).withColumnRenamed("vec_id", "key")
    fused = fusion.fuse(narrow(near, config.dense_k, config.multi_k), narrow(sparse, config.sparse_k, config.multi_k), max(config.fused_k, config.multi_fused_k), config)
    found = narrow(fused, config.fused_k, config.multi_fused_k).withColumn("scoped", F.lit(False))
    if engine.entities is not None:
        hits = entities.scoped_candidates(ids.select("query_id", F.col("text").alias("question")), engine.words, engine.entities, config)
        found = fusion.prepend(found, hits.withColumnRenamed("doc_id", "key"), ("query_id",))
    found = found.join(lexical.bounded(known), "query_id").select(F.col("of").alias("query_id"), "sub_idx", "key", "rank", "fusion_score", "dense_rank", "bm25_rank", "scoped", "n_subs")
    if own.extra is not None:
        more = subs.where("sub_idx = 0").select("query_id", "n_subs", own.embed(own.extra(F.col("question"))).alias("embedding"))
        hits = dense.nearest(engine.vectors, more, min(config.multi_k, config.multi_fused_k)).withColumnRenamed("vec_id", "key").join(more.select("query_id", "n_subs"), "query_id")
        none = F.lit(None).cast("int")
        found = found.unionByName(hits.select("query_id", F.col("n_subs").alias("sub_idx"), "key", "rank", F.lit(0.0).alias("fusion_score"), none.alias("dense_rank"), none.alias("bm25_rank"), F.lit(False).alias("scoped"), "n_subs"))
    return found


def retrieve(engine: Engine, questions: DataFrame) -> DataFrame:
    """questions (query_id, text, maybe sub_queries, rewrite_skipped): -> select.CHOSEN: searched, pooled,
    reranked and chosen."""
    config = engine.config
    subs = sub_queries(engine, questions)
    found = materialise(lists(engine, subs), "lists")
    cap = F.when(F.col("n_subs") > 1, config.pool_cap).otherwise(1 << 30)
    pooled = fusion.pool(found, cap, ("dense_rank", "bm25_rank", "scoped", "n_subs"))
    texts = engine.chunks.select(F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), "page_content", "title", "filename", "category")
    skipped = F.col("rewrite_skipped") if "rewrite_skipped" in questions.columns else F.lit(False)
    asked = questions.select("query_id", F.col("text").alias("question"), skipped.alias("rewrite_skipped"))
    parts = subs.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_idx", "text"))), lambda x: x["text"]).alias("parts"))
    rows = texts.join(lexical.bounded(pooled), "key").join(lexical.bounded(asked.join(parts, "query_id")), "query_id")
    key = select.fan_in_key(F.col("question"), config.site_words)
    title = F.coalesce("title", F.lit(""))
    score = lambda q: F.round(engine.models.rerank(q, title, documents.record_text(F.col("page_content"))), 6)
    by_sub = F.array(*(F.when(F.size("parts") > i, score(F.get("parts", F.lit(i)))) for i in range(config.max_subqueries))) if config.rerank_mode == "per_subquery" else F.lit(None).cast("array<double>")
    rows = rows.select("query_id", "key", "pool_rank", "origins", F.col("pool_fusion_score").alias("fusion"), "scoped", "n_subs", "source", "rewrite_skipped", (F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull()).alias("both_arms"), score(F.col("question")).alias("score"), by_sub.alias("sub_scores"), F.contains(F.lower("page_content"), F.lower(key)).alias("mentions"))
    return select.final(rows, config)


def chosen_texts(engine: Engine, chosen: DataFrame, rank: str = "final_rank") -> DataFrame:
    """(query_id, rank, source, page_content, ABOUT) of what was chosen."""
    rows = engine.chunks.withColumnRenamed("doc_id", "key").join(lexical.bounded(chosen.select("query_id", "key", F.col(rank).alias("rank"))), "key")
    return rows.select("query_id", "key", "rank", "source", "page_content", *context.ABOUT)


def answer(engine: Engine, questions: DataFrame) -> DataFrame:
    """(query_id, context, chunks, sources, misses, chars, answer, support: the judge's)."""
    config = engine.config
    chosen = select.score_threshold(retrieve(engine, questions).withColumn("rank", F.col("final_rank")), config.score_threshold, config.min_kept)
    texts = materialise(chosen_texts(engine, chosen), "chosen")
    rendered = context.render(texts, engine.chunks.select("source", "chunk_index", "page_content"), config)
    rows = F.array_sort(F.collect_list(F.struct("rank", "source", "page_content")))
    said = texts.groupBy("query_id").agg(rows.alias("r"))  # at most top_k chunks of a question and two for each sub-query
    said = said.select("query_id", engine.models.answer(F.transform("r", lambda x: x["page_content"]), F.transform("r", lambda x: x["source"].cast("string"))).alias("answer"))
    return rendered.join(said, "query_id", "left").withColumn("support", F.round(engine.models.judge(F.col("answer"), F.col("context")), 6))


def controlled(engine: Engine, questions: DataFrame) -> control.Outcome:
    """The loop of operators.control over this engine: a first pass for the question, later ones for the
    queries of the controller, whose question is the only one of them or else the first question."""

    def search(asked: DataFrame, hop: int) -> DataFrame:
        if hop:
            asked = asked.select("query_id", F.when(F.size("queries") == 1, F.col("queries")[0]).otherwise(F.col("text")).alias("text"), F.col("queries").alias("sub_queries"))
        else:
            asked = asked.select("query_id", "text", tx.is_simple_question(F.col("text")).alias("rewrite_skipped"))
        return retrieve(engine, asked).select("query_id", "key", F.col("final_rank").alias("rank"))

    def evidence(held: DataFrame) -> DataFrame:
        rows = chosen_texts(engine, held.withColumnRenamed("merged_rank", "final_rank"))
        totals = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources")).withColumn("sub_queries", F.array().cast("array<string>"))
        return context.evidence(context.digest(rows, F.col("page_content"), config=engine.config), totals)

    return control.run(questions, engine.models.decide, search, evidence, engine.config)
