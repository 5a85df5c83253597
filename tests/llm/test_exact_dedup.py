import hashlib
import re

from pyspark.sql import functions as F

from quern.llm import exact_dedup, queries
from tests.llm.conftest import ROWS


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def want(rows):
    out = {}
    for i, t in rows:
        g = out.setdefault(plain(t), [None, 0])
        g[0], g[1] = (i if g[0] is None else g[0] if i is None else min(g[0], i)), g[1] + 1
    return out


def same(got, rows):
    groups, left = want(rows), {}
    assert len(got) == len(rows)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        keep, size = groups[texts[r["digest"]]]
        assert (r["keep_id"], r["group_size"]) == (keep, size)
        if r["kept"]:
            assert r["doc_id"] == keep
            left[r["digest"]] = left.get(r["digest"], 0) + 1
    assert left == {h: 1 for h in texts}


def test_odd_rows(odd, none):
    same(exact_dedup.annotate(odd).collect(), ROWS)
    same(exact_dedup.annotate(odd, salts=1).collect(), ROWS)
    assert exact_dedup.annotate(none).count() == 0


def test_equal_digests_of_different_texts_do_not_merge(odd):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = exact_dedup.annotate(odd, digest=weak).collect()
    strong = exact_dedup.annotate(odd).collect()
    key = lambda r: (str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"])
    assert sorted(map(key, got)) == sorted(map(key, strong))


def test_one_hot_text(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy  of one").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.annotate(rows.repartition(7))
    assert got.where("kept").count() == 1_001
    assert got.where("group_size = 2000 and keep_id = 1").count() == 2_000


def test_deduplicate_keeps_rows_whole(odd, none):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    got = kept.select("doc_id", "text", "kept").collect()
    assert sorted(plain(r["text"]) for r in got) == sorted(want(ROWS))
    assert all(r["kept"] == "own kept" for r in got)
    assert exact_dedup.deduplicate(none).count() == 0


def test_query(spark, small, duck):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_exact_dedup(spark, small).collect()}
    sql = duck.sql(queries.ORACLE_SQL["op5_exact_dedup"]).fetchall()
    assert got == {r[0]: r[1:] for r in sql}
