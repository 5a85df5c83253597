"""An inverted file over vectors: each vector lies in the cell of its nearest centroid, a search compares a
query with the vectors of a few cells, exactly.

Centroids are fitted by spherical k-means on a bounded sample; every row of the table is in a cell. Cells
are written once, as blocks of at most BLOCK vectors in a table that is partitioned by cell, and appended
to. How many cells a query has to look into is measured at the fit, on the sample: the fewest with which
sampled vectors find TARGET of their nearest ones. A search sends queries to their cells as blocks too, so
that what is joined are blocks of a cell with queries that look there, and a large cell is many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.config import DEFAULTS
from quern.operators.dense import Best, best_of, by_length, cosines
from quern.sources.tables import materialise

#: Bytes of the sample that centroids are fitted on, and most cells.
SAMPLE_BYTES, MOST_CELLS = 32 << 20, 4096
#: Vectors of a block of a cell; queries of a block that goes to a cell.
BLOCK, ASKED = 1024, 256
#: Share of the nearest vectors of sampled ones that a search has to find, how many of these are asked for, and of
#: how many sampled vectors.
TARGET, NEAR, PROBED = 0.96, DEFAULTS.dense_k, 512
ROUNDS, SEED = 12, 42


@dataclass
class VectorIndex:
    path: str
    centroids: np.ndarray
    probes: int
    recall: float  # on the sample, with that many probes

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _closest(rows: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """(rows, n): the cells of the n nearest centroids, nearest first; equal ones by number."""
    return np.argsort(-np.round(rows @ centroids.T, 9), axis=1, kind="stable")[:, :n]


def _means(rows: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit rows; a cell that gets empty takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = rows[np.sort(rng.choice(len(rows), cells, replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([_closest(rows[at : at + 8192], centroids)[:, 0] for at in range(0, len(rows), 8192)])
        total = np.zeros_like(centroids)
        np.add.at(total, own, rows)
        (empty,) = np.nonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            far = np.argsort(np.einsum("ij,ij->i", rows, centroids[own]), kind="stable")[: len(empty)]
            total[empty] = rows[far]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centroids)
    return centroids


def _probes(rows: np.ndarray, centroids: np.ndarray, target: float) -> tuple[int, float]:
    """The fewest cells in which sampled rows find `target` of their nearest rows, and what they find there."""
    own = _closest(rows, centroids)[:, 0]
    asked = np.linspace(0, len(rows) - 1, min(PROBED, len(rows))).astype(int)
    order = _closest(rows[asked], centroids, len(centroids))
    place = np.empty_like(order)  # of a cell in a query's order
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    near = np.argsort(-(rows[asked] @ rows.T), axis=1, kind="stable")[:, :NEAR]
    depth = np.take_along_axis(place, own[near], 1).ravel()
    found = np.cumsum(np.bincount(depth, minlength=len(centroids))) / len(depth)
    n = int(np.searchsorted(found, target)) + 1
    return min(n, len(centroids)), float(found[min(n, len(centroids)) - 1])


def _blocks(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cell, ids, matrix) of all rows that have the centroids' length."""
    sent, dim = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = by_length(batch.column(0), batch.column(1)).get(dim)
            if found is not None:
                ids, rows = found
                own = np.concatenate([_closest(rows[at : at + 4096], sent.value)[:, 0] for at in range(0, len(rows), 4096)])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype("i4")), pa.array(ids), pa.array([r.tobytes() for r in rows], pa.binary())], ["cell", "vec_id", "unit"])

    return packed(vectors.select("vec_id", "embedding").mapInArrow(assign, "cell int, vec_id long, unit binary"), "vec_id", BLOCK)


def packed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (cell, key, unit) -> (cell, ids, matrix): blocks of at most `most` rows of a cell. By ranges of
    cell and key, so that a large cell is many tasks' work."""
    sorted_ = rows.repartitionByRange("cell", key).sortWithinPartitions("cell", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, units = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.array(ids, "i8").tobytes()], pa.binary()), pa.array([b"".join(units)], pa.binary())], ["cell", "ids", "matrix"])

        for batch in batches:
            for cell, i, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (cell != now or len(ids) >= most):
                    yield block()
                    ids, units = [], []
                now = cell
                ids.append(i)
                units.append(unit)
        if ids:
            yield block()

    return sorted_.select("cell", key, "unit").mapInArrow(run, "cell int, ids binary, matrix binary")


def build(vectors: DataFrame, path: str, cells: int | None = None, target: float = TARGET, sample_bytes: int = SAMPLE_BYTES) -> VectorIndex:
    """vectors (vec_id, embedding) into an index at `path`. The length that counts is that of most vectors, the
    smaller of equally frequent ones; vectors that are null, hold one or have another length have no place.
    cells: about the square root of the rows, MOST_CELLS at most, if not given. The sample has at most
    sample_bytes; it is chosen by hash of vec_id and embedding, so that it doesn't depend on the layout."""
    counts = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "dim").first()
    if top is None or not top["dim"]:
        raise ValueError("no vectors")
    most = max(1, sample_bytes // (8 * top["dim"]))
    level = F.xxhash64("vec_id", "embedding")
    some = vectors.where(F.size("embedding") == top["dim"])
    if top["n"] > most:
        some = some.where(level < int((most / top["n"] - 0.5) * 2.0**64))
    told = some.orderBy(level, "vec_id").select("vec_id", "embedding").limit(most).toArrow().combine_chunks()
    _, rows = by_length(told["vec_id"].combine_chunks(), told["embedding"].combine_chunks()).get(top["dim"], (None, None))
    if rows is None:
        raise ValueError("no vectors")
    cells = min(cells or math.isqrt(top["n"]), MOST_CELLS, len(rows))
    centroids = _means(rows, cells)
    probes, recall = _probes(rows, centroids, target)
    _blocks(vectors, centroids).write.partitionBy("cell").parquet(path)
    return VectorIndex(path, centroids, probes, recall)


def append(index: VectorIndex, vectors: DataFrame) -> None:
    """More vectors, into the cells as they are."""
    _blocks(vectors, index.centroids).write.mode("append").partitionBy("cell").parquet(index.path)


def stored(index: VectorIndex, spark: SparkSession) -> DataFrame:
    return spark.read.schema("ids binary, matrix binary, cell int").parquet(index.path)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """queries (query_id, embedding): (query_id, vec_id, score, rank) as of dense.nearest(), among the vectors
    of each query's `probes` nearest cells. With as many probes as cells it is nearest() itself. Of queries
    that repeat an id the one with the smallest vector counts; those of another length find nothing."""
    spark, probes = queries.sparkSession, min(probes or index.probes, index.cells)
    sent, dim = spark.sparkContext.broadcast(index.centroids), index.centroids.shape[1]
    asked = queries.where("embedding is not null").groupBy("query_id").agg(F.min("embedding").alias("embedding"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = by_length(batch.column(0), batch.column(1)).get(dim)
            if found is not None:
                ids, rows = found
                for at in range(0, len(ids), 256):
                    own, part = ids[at : at + 256], [r.tobytes() for r in rows[at : at + 256]]
                    near = _closest(rows[at : at + 256], sent.value, probes)
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype("i4")), pa.array(np.repeat(own, probes)), pa.array([p for p in part for _ in range(probes)], pa.binary())], ["cell", "query_id", "unit"])

    looking = packed(asked.mapInArrow(assign, "cell int, query_id long, unit binary"), "query_id", ASKED)
    looking = materialise(looking, "vector-asked").select("cell", F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    cells = [r["cell"] for r in looking.select("cell").distinct().collect()]  # MOST_CELLS at most; only their folders are read
    met = stored(index, spark).where(F.col("cell").isin(cells)).join(looking, "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                ids, matrix, names, wanted = (batch.column(c)[at].as_buffer() for c in range(4))
                best = Best(k)
                best.add(cosines(np.frombuffer(wanted, "f8").reshape(-1, dim), np.frombuffer(matrix, "f8").reshape(-1, dim)), np.frombuffer(ids, "i8"))
                yield best.batch(np.frombuffer(names, "i8"))

    return best_of(met.select("ids", "matrix", "query_ids", "queries").mapInArrow(compare, "query_id long, vec_id long, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query_id, vec_id) of `exact` that are found; 1 if there are none."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    row = both.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("n")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0
