"""Vector search: any size of what is sent, lengths, repeated ids; the index against the exact search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import dense, vector_index
from quern.operators.numbering import numbered


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(vectors, queries, k):
    first = {}
    for q, e in queries:
        if e is not None and (q not in first or [(x is not None, x) for x in e] < [(x is not None, x) for x in first[q]]):
            first[q] = e
    unit = lambda e: np.array(e) / (np.linalg.norm(e) or 1)
    out = []
    for q, e in first.items():
        if None in e:
            continue
        found = sorted((-round(float(unit(e) @ unit(v)), 6) if e else 0.0, i) for i, v in vectors if v is not None and None not in v and len(v) == len(e))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_nearest_for_any_block(spark):
    """Mixed lengths, null and repeated ids, vectors with nulls and of zeros: what is sent at once changes nothing."""
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(2 + i % 2).round(2).tolist()) for i in range(40)] + [(90, None), (91, [1.0, None]), (92, [0.0, 0.0]), (93, [])]
    queries = [(i, rng.standard_normal(2 + (i > 2)).round(2).tolist()) for i in range(6)] + [(3, [9.0, 1.0]), (3, [9.0, 1.0, 0.0]), (7, None), (8, [None, 1.0])]
    v, q = spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), spark.createDataFrame(queries, "query_id long, embedding array<float>")
    as_float = lambda some: [(i, e and [None if x is None else float(np.float32(x)) for x in e]) for i, e in some]
    want = by_hand(as_float(vectors), as_float(queries), 4)
    for sent in (1, 60, 100, 1 << 20):
        assert rows(dense.nearest(v, q, 4, sent)) == want
    assert dense.nearest(v, q.limit(0), 4).count() == dense.nearest(v.limit(0), q, 4).count() == 0


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbered(spark, by):
    """A hot group, null groups, ties in nothing but copies; over more tasks than groups."""
    got = spark.range(3_000).select((F.col("id") * 7 % 1_009).alias("x"), "id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbered(got.repartition(5), ["x", "id"], by).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = {}
    for r in sorted(out, key=lambda r: (r["x"], r["id"])):
        key = r["g"] if by else None
        assert r["n"] == places.get(key, 0)
        places[key] = r["n"] + 1
    assert len(out) == 3_000
    assert numbered(got.limit(0), ["x"], by).count() == 0


def test_numbered_plan_has_no_single_partition(spark):
    plan = numbered(spark.range(50), [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def clusters(spark, n=3_000, dim=16, seed=1, first=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(8).standard_normal((12, dim))
    data = [(first + i, (centres[i % 12 if i % 3 else 0] + 0.7 * rng.standard_normal(dim)).tolist()) for i in range(n)]  # a third is in one cluster
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def test_index_recall_and_append(spark, tmp_path):
    vectors = clusters(spark).unionByName(spark.createDataFrame([(9_001, None), (9_002, [1.0]), (9_003, [None] * 16), (9_004, [0.0] * 16)], "vec_id long, embedding array<float>"))
    queries = vectors.where("vec_id % 50 = 0 or vec_id > 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.build(vectors, str(tmp_path / "ivf"))
    assert index.cells == 54 and index.probes < index.cells and index.recall >= vector_index.TARGET
    exact = dense.nearest(vectors, queries.where("query_id <> 9002"), 23)
    assert vector_index.recall(vector_index.search(index, queries, 23), exact) >= 0.9
    assert rows(vector_index.search(index, queries, 23, index.cells)) == rows(exact)
    more = clusters(spark, 500, seed=2, first=20_000)
    vector_index.append(index, more)
    exact = dense.nearest(vectors.unionByName(more), queries.where("query_id <> 9002"), 23)
    assert exact.where("vec_id >= 20000").count() > 0
    assert rows(vector_index.search(index, queries, 23, index.cells)) == rows(exact)
    assert vector_index.recall(vector_index.search(index, queries, 23), exact) >= 0.9
    counted = vector_index.stored(index, spark).select(F.sum(F.octet_length("ids") / 8)).first()[0]
    assert counted == 3_501  # every row that has the length, once


def test_index_reads_only_probed_cells(spark, tmp_path):
    index = vector_index.build(clusters(spark, 600), str(tmp_path / "ivf"), cells=10)
    plan = vector_index.search(index, clusters(spark, 1).withColumnRenamed("vec_id", "query_id"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "cell#" in plan.split("PartitionFilters: [")[1]


def test_index_on_a_bounded_sample(spark, tmp_path):
    vectors = clusters(spark, 2_000)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.build(vectors, str(tmp_path / "ivf"), sample_bytes=8 * 16 * 400)
    assert index.cells == 44
    exact = dense.nearest(vectors, queries, 23)
    assert vector_index.recall(vector_index.search(index, queries, 23), exact) >= 0.9
    with pytest.raises(ValueError):
        vector_index.build(vectors.limit(0), str(tmp_path / "none"))


def test_cosines_that_a_task_holds_are_bounded():
    """Many queries meet many vectors in blocks; the result is that of all at once."""
    rng = np.random.default_rng(5)
    q, v = rng.standard_normal((8000, 4)), rng.standard_normal((3000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(v.tolist(), pa.list_(pa.float64()))], ["vec_id", "embedding"])
    wanted = dense.by_length(pa.array(np.arange(8000)), pa.array(q.tolist(), pa.list_(pa.float64())))
    tracemalloc.start()
    found = pa.Table.from_batches(dense.best_in(iter([batch]), wanted, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 24000 and peak < 150e6  # 8,000 by 2,048 cosines alone are 131 MB, and were sorted in copies
    score = dense.cosines(wanted[4][1][:50], dense._unit_rows(v))
    want = np.lexsort((np.broadcast_to(np.arange(3000), score.shape), -score), axis=1)[:, :3]
    assert found["vec_id"].to_pylist()[:150] == want.ravel().tolist()
