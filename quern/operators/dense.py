"""Exact cosine search over vectors, and re-selection for diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.config import DEFAULTS, Config
from quern.operators.numbering import numbered
from quern.sources.tables import materialise

#: Bytes of query vectors that are sent to the tasks at a time.
SENT = 128 << 20
#: Vectors, and queries, that a task compares at a time.
AT_ONCE, ASKED_AT_ONCE = 2048, 512


def unit(vector: Column) -> Column:
    """Of length 1; a vector of zeros stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(vector, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, sent: int = SENT) -> DataFrame:
    """vectors (vec_id, embedding), queries (query_id, embedding): -> (query_id, vec_id, score, rank),
    cosines rounded to 6 places, equal ones by vec_id. Every vector is compared with every query of its
    length by matrix products. The queries are a stated set. They are counted; up to `sent` bytes of them go
    to the tasks at once. More are numbered and written, and go out in blocks of that size, one job and one
    pass over the vectors for each, whose results are written. A task keeps the k best of its rows for each
    query, so k rows a query and task are shuffled. Vectors that are null, or hold one, have no cosine and
    are left out, on both sides; of queries that repeat an id the one with the smallest vector counts."""
    asked = queries.where("embedding is not null").groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    most = max(1, sent // (8 * max(1, size["dim"] or 1)))
    if size["n"] <= most:
        out = _search(vectors, asked, k)
    else:
        placed, out = numbered(asked, ["query_id"], name="_place", written="vector-queries"), None
        for at in range(0, size["n"], most):
            part = materialise(_search(vectors, placed.where(F.col("_place").between(at, at + most - 1)).drop("_place"), k), "vector-hits")
            out = part if out is None else out.unionByName(part)
    return best_of(out, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) -> the k best of each query with their rank; equal ones by vec_id."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def by_length(ids: pa.Array, embeddings: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each length, as ids and unit vectors; rows that are null or hold one are left out."""
    sizes, out = pc.list_value_length(embeddings), {}
    for dim in pc.unique(sizes.drop_null()).to_pylist():
        some = pc.equal(sizes, dim)
        own, rows = ids.filter(some, null_selection_behavior="drop"), embeddings.filter(some, null_selection_behavior="drop")
        if rows.flatten().null_count:
            whole = pa.array([None not in v for v in rows.to_pylist()], pa.bool_())
            own, rows = own.filter(whole), rows.filter(whole)
        if len(own):
            out[dim] = own.to_numpy(), _unit_rows(rows.flatten().to_numpy().reshape(len(own), dim).astype("f8"))
    return out


class Best:
    """The k best (id, score) of each of n queries, over parts of the vectors."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, None, None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score (queries, vectors), ids (vectors)."""
        ids = np.broadcast_to(ids, score.shape)
        if self.score is not None:
            score, ids = np.hstack([self.score, score]), np.hstack([self.ids, ids])
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score, self.ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, self.ids.shape[1])), pa.array(self.ids.ravel()), pa.array(self.score.ravel())], ["query_id", "vec_id", "score"])


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.round(queries @ rows.T, 6) if rows.shape[1] else np.zeros((len(queries), len(rows)))


def _search(vectors: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """block: queries whose bytes have been counted against a bound."""
    told = block.orderBy("query_id").toArrow().combine_chunks()
    wanted = by_length(told["query_id"].combine_chunks(), told["embedding"].combine_chunks()) if len(told) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return best_in(batches, wanted, k)

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def best_in(batches: Iterator[pa.RecordBatch], wanted: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of batches (vec_id, embedding) for queries as by_length() gives them. What is held at
    once are k rows a query, and the cosines of ASKED_AT_ONCE queries with AT_ONCE rows."""
    parts = {dim: [(names[at : at + ASKED_AT_ONCE], units[at : at + ASKED_AT_ONCE], Best(k)) for at in range(0, len(names), ASKED_AT_ONCE)] for dim, (names, units) in wanted.items()}
    for batch in batches:
        for dim, (ids, rows) in by_length(batch.column(0), batch.column(1)).items():
            for at in range(0, len(ids) if dim in parts else 0, AT_ONCE):
                for _, units, best in parts[dim]:
                    best.add(cosines(units, rows[at : at + AT_ONCE]), ids[at : at + AT_ONCE])
    for names, _, best in (p for own in parts.values() for p in own):
        if best.score is not None:
            yield best.batch(names)


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def mmr(found: DataFrame, vectors: DataFrame, k: int, config: Config = DEFAULTS) -> DataFrame:
    """found: the nearest() of each query, at most config.mmr_fetch of them: -> (query_id, vec_id, score,
    dense_rank). The most similar first; then again and again the candidate with the most of lambda times
    its similarity less (1 - lambda) times its greatest similarity to those picked. Equal ones: the
    better rank. A group is one query's candidates, so its size is bounded."""
    lam = config.mmr_lambda
    with_vectors = found.where(F.col("rank") <= config.mmr_fetch).join(vectors.select("vec_id", "embedding"), "vec_id")

    def pick(pdf):
        pdf = pdf.sort_values("rank")
        rows = _unit_rows(np.stack(pdf["embedding"].to_list()).astype("f8"))
        likeness, score = rows @ rows.T, pdf["score"].to_numpy()
        chosen, left = [], list(range(len(pdf)))
        while left and len(chosen) < k:
            worth = [lam * score[i] - (1 - lam) * max((likeness[i, j] for j in chosen), default=0.0) if chosen else score[i] for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(worth, 9)))))
        out = pdf.iloc[chosen][["query_id", "vec_id", "score"]].copy()
        out["dense_rank"] = range(1, len(out) + 1)
        return out

    return with_vectors.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, score double, dense_rank int")
