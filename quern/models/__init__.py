"""Stand-ins for models, deterministic and offline. Their quality says nothing about real models; each is
a column function or plain function that a deployment replaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, functions as F

from quern.functions.text import tokens

DIM = 64


def embed(text: Column, dim: int = DIM) -> Column:
    """array<double>: signed hashes of tokens, summed, of length 1."""

    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        out = []
        for words in lists.to_pylist():
            vector = np.zeros(dim)
            for word in words or ():
                h = xxhash.xxh64_intdigest(word)
                vector[h % dim] += 1 if h >> 63 else -1
            out.append((vector / (np.linalg.norm(vector) or 1)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return run(tokens(text))


def subqueries(question: Column, most: int = 4) -> Column:
    """array<string>: a question's parts, at least one."""
    parts = F.filter(F.transform(F.split(question, r"[?;]|\band\b"), F.trim), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(question))


def rerank(question: Column, title: Column, text: Column) -> Column:
    """The share of a question's distinct tokens that a chunk or its title has."""
    return support(question, F.concat_ws(" ", title, text))


def answer(chunks: Column, sources: Column) -> Column:
    """The first sentence of each chunk, then the sources."""
    said = F.array_join(F.transform(chunks, lambda c: F.split(c, r"(?<=[.!?])\s")[0]), " ")
    return F.concat(said, F.lit("\n\nSources:\n"), F.array_join(F.array_distinct(sources), "\n"))


def support(answer_text: Column, evidence: Column) -> Column:
    """The share of an answer's distinct tokens that the evidence has: a judge by containment."""
    said = F.array_distinct(tokens(answer_text))
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, tokens(evidence))) / F.size(said)).otherwise(F.lit(1.0))


def rewritten(question: Column, reply: Column, most: int = 4) -> Column:
    """struct<standalone, sub_queries, keywords, passage, fallback> of a rewriter's reply to a question with its
    history, a text of JSON. What the reply leaves empty is the question, one sub-query, nothing; a reply that is
    null or no JSON object falls back to the raw question, and says so."""
    told = F.from_json(reply, "standalone_question string, sub_queries array<string>, bm25_keywords array<string>, hyde_passage string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    fine = told.isNotNull() & told["_corrupt"].isNull() & F.startswith(F.trim(reply), F.lit("{"))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    listed = lambda x, n: F.slice(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), trimmed), lambda t: F.coalesce(t != "", F.lit(False))), 1, n)
    alone = F.coalesce(F.nullif(trimmed(told["standalone_question"]), F.lit("")), question)
    parts = listed(told["sub_queries"], most)
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(fine, alone).otherwise(question).alias("standalone"),
        F.when(fine & (F.size(parts) > 0), parts).when(fine, F.array(alone)).otherwise(F.array(question)).alias("sub_queries"),
        F.when(fine, listed(told["bm25_keywords"], 8)).otherwise(none).alias("keywords"),
        F.when(fine, trimmed(F.coalesce(told["hyde_passage"], F.lit("")))).otherwise("").alias("passage"),
        (~F.coalesce(fine, F.lit(False))).alias("fallback"),
    )
