"""Lexical and dense search, fusion, pools, scoped search, selection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from quern.catalogue.registry import query, tok
from quern.config import DEFAULTS
from quern.functions import documents, text as tx
from quern.operators import dense, fusion, lexical, select, vector_index
from quern.sources.tables import materialise, new_path

K = DEFAULTS.top_k


def text():
    return F.col("text")



def bm25_sql(docs: str = "SELECT doc_id, text FROM documents", queries: str = "SELECT item_id AS query_id, text FROM benchmark", cutoff: float = 0) -> str:
    """CTEs up to scored(query_id, doc_id, score)."""
    drop = f" WHERE NOT any_rare OR share < {cutoff}" if cutoff else ""
    return f"""
WITH d AS ({docs}), q AS ({queries}),
words AS (SELECT doc_id, unnest({tok("text")}) AS term FROM d),
sizes AS (SELECT doc_id, len({tok("text")}) AS dl FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
raw AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, corpus),
idf AS (SELECT term, avgdl, df / n AS share, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({tok("text")}) AS term FROM q) GROUP BY ALL),
w0 AS (SELECT *, bool_or(share < {cutoff}) OVER (PARTITION BY query_id) AS any_rare FROM qt JOIN idf USING (term)),
w AS (SELECT * FROM w0{drop}),
scored AS (
  SELECT query_id, doc_id, round(sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM w JOIN tf USING (term) JOIN sizes USING (doc_id) GROUP BY ALL
)"""


TOP_SQL = f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {K}"""


def questions(table):
    return table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def indexed(table):
    return lexical.build(table("documents"), text())


def scored(table):
    return lexical.score(indexed(table), questions(table), text())


@query(bm25_sql() + TOP_SQL)
def bm25_topk(table, spark):
    return lexical.search(indexed(table), questions(table), text(), K)


@query(f"""WITH w AS (SELECT doc_id, unnest({tok("text")}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term""")
def bm25_stats(table, spark):
    return lexical.build(table("documents"), text()).stats


@query(bm25_sql() + "SELECT n, round(avgdl, 6) AS avgdl, round(avg(r), 6) AS avg_idf FROM raw GROUP BY n, avgdl")
def bm25_corpus(table, spark):
    found = lexical.build(table("documents"), text()).corpus
    return found.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


@query(bm25_sql() + TOP_SQL)
def bm25_segments(table, spark):
    """Documents come in four batches, each a segment of the index."""
    index = lexical.open_index(spark, new_path(spark, "bm25"))
    for n in range(4):
        index.append(table("documents").where(F.pmod("doc_id", F.lit(4)) == n), text(), f"batch-{n}")
    return lexical.search(index, questions(table), text(), K)


@query(bm25_sql(cutoff=0.2) + TOP_SQL)
def bm25_df_filter(table, spark):
    return lexical.search(indexed(table), questions(table), text(), K, replace(DEFAULTS, df_cutoff=0.2))


@query(bm25_sql("SELECT doc_id, source || ' ' || lang || ' ' || text AS text FROM documents") + TOP_SQL)
def bm25_augmented(table, spark):
    docs = table("documents").select("doc_id", documents.lexical_text(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.lit(""), text()).alias("text"))
    return lexical.search(lexical.build(docs, text()), questions(table), text(), K)


#: Every vector whose id is divisible by 50 is a query against all vectors.
DENSE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def vector_queries(table):
    return table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(DENSE_SQL + f"SELECT query_id, vec_id, score, rank FROM near WHERE rank <= {DEFAULTS.dense_k}")
def dense_topk(table, spark):
    return dense.nearest(table("embeddings"), vector_queries(table), DEFAULTS.dense_k)


def index_of(table, spark):
    return vector_index.build(table("embeddings"), new_path(spark, "vector-index"))


@query()
def vector_index_topk(table, spark):
    return vector_index.search(index_of(table, spark), vector_queries(table), DEFAULTS.dense_k)


@query(DENSE_SQL + f"SELECT query_id, vec_id, score, rank FROM near WHERE rank <= {DEFAULTS.dense_k}")
def vector_index_all_cells(table, spark):
    index = index_of(table, spark)
    return vector_index.search(index, vector_queries(table), DEFAULTS.dense_k, index.cells)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS u FROM v)
SELECT vec_id, label, round(list_sum(u), 6) AS total, round(list_dot_product(u, u), 6) AS norm2 FROM u""")
def vector_normalise(table, spark):
    u = table("embeddings").select("vec_id", "label", dense.unit(F.col("embedding")).alias("u"))
    total = lambda f: F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + f(x)), 6)
    return u.select("vec_id", "label", total(lambda x: x).alias("total"), total(lambda x: x * x).alias("norm2"))


@query()
def dense_mmr(table, spark):
    vectors = table("embeddings")
    found = dense.nearest(vectors, vector_queries(table), DEFAULTS.mmr_fetch)
    return dense.mmr(found, vectors, DEFAULTS.dense_k)


#: Fusion of the lexical arm over documents and a dense arm whose keys are vec_ids taken as doc_ids: the
#: queries are all passages that have a vector of their id.
FUSED_SQL = (
    bm25_sql(queries="SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)")
    + f""", {DENSE_SQL.strip().removeprefix("WITH ").replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")},
arms AS (
  SELECT query_id, vec_id AS key, rank, 0.48 AS w, true AS dense FROM near WHERE rank <= {DEFAULTS.dense_k} AND query_id IN (SELECT query_id FROM q)
  UNION ALL SELECT query_id, doc_id, rank, 0.52, false FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {DEFAULTS.sparse_k}
),
keys AS (SELECT query_id, key, min(rank) FILTER (dense) AS dense_rank, min(rank) FILTER (NOT dense) AS bm25_rank, round(sum(w / (60 + rank)), 9) AS fusion_score FROM arms GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(dense_rank, bm25_rank + 1000000), key) AS rank FROM keys)
"""
)


def fused(table):
    own = table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(F.broadcast(questions(table).select("query_id")), "query_id", "left_semi")
    wanted = questions(table).join(F.broadcast(own.select("query_id")), "query_id", "left_semi")
    sparse = lexical.search(indexed(table), wanted, text(), DEFAULTS.sparse_k)
    near = dense.nearest(table("embeddings"), own, DEFAULTS.dense_k)
    return fusion.fuse(near.withColumnRenamed("vec_id", "key"), sparse.withColumnRenamed("doc_id", "key"), DEFAULTS.fused_k)


@query(FUSED_SQL + f"SELECT query_id, key, dense_rank, bm25_rank, fusion_score, rank FROM fused WHERE rank <= {DEFAULTS.fused_k}")
def rrf_fusion(table, spark):
    return fused(table)


@query(FUSED_SQL + f"SELECT query_id, round(avg(CASE WHEN dense_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN 1 ELSE 0 END), 6) AS consensus FROM fused WHERE rank <= {DEFAULTS.top_k} GROUP BY query_id")
def consensus(table, spark):
    return fusion.consensus(fused(table).where(F.col("rank") <= DEFAULTS.top_k).withColumn("origins", F.array(F.lit(0))))


#: A question's scope: the sources of its two best documents.
SCOPE_SQL = ", scope AS (SELECT DISTINCT query_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) JOIN documents USING (doc_id) WHERE rank <= 2)"


def scoped_hits(table):
    docs = table("documents")
    index = lexical.build(docs, text())
    hits = lexical.search(index, questions(table), text(), 2)
    scopes = docs.select("doc_id", "source").join(lexical.bounded(hits.select("query_id", "doc_id")), "doc_id").select("query_id", "source").distinct()
    return lexical.scoped(index, questions(table), scopes, text(), DEFAULTS.entity_k)


@query(bm25_sql() + SCOPE_SQL + f""", hits AS (
  SELECT query_id, source, doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id, source ORDER BY coalesce(score, 0) DESC, doc_id) AS depth
  FROM scope JOIN documents USING (source) LEFT JOIN scored USING (query_id, doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, source, doc_id) AS scoped_rank FROM hits WHERE depth <= {DEFAULTS.entity_k})
SELECT query_id, source, doc_id, score, depth, scoped_rank, round(1 / (60 + scoped_rank), 6) AS fusion_score FROM best""")
def scoped_search(table, spark):
    return scoped_hits(table).select("query_id", "source", "doc_id", "score", "depth", "scoped_rank", "fusion_score")


#: The sub-queries of a passage are its sentences, at most four.
SUBQUERIES_SQL = """SELECT item_id * 10 + i AS query_id, s AS text FROM (
  SELECT item_id, unnest(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')[1:4]) AS s, generate_subscripts(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')[1:4], 1) - 1 AS i FROM benchmark)"""

LISTS_SQL = f""", lists AS (
  SELECT query_id // 10 AS query_id, (query_id % 10)::INT AS sub_idx, doc_id AS key, rank, score, round(1 / (60 + rank), 9) AS fusion_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {DEFAULTS.multi_fused_k})"""


def lists(table):
    """The best documents of each sub-query, written: they are searched for once, however often they are used."""
    parts = F.slice(F.filter(F.transform(F.split(text(), "[.]"), F.trim), lambda x: x != ""), 1, DEFAULTS.max_subqueries)
    subs = table("benchmark").select("item_id", F.posexplode(parts).alias("i", "text")).select((F.col("item_id") * 10 + F.col("i")).alias("query_id"), "text")
    found = lexical.search(indexed(table), subs, text(), DEFAULTS.multi_fused_k)
    of = found.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("sub_idx"), F.col("doc_id").alias("key"), "rank", "score", F.round(1 / (DEFAULTS.rrf_k + F.col("rank")), 9).alias("fusion_score"))
    return materialise(of, "lists")


POOL_SQL = f""", pool AS (
  SELECT query_id, key, min((rank, sub_idx)) AS first, list_sort(list(DISTINCT sub_idx)) AS origins, round(sum(fusion_score), 9) AS pool_fusion_score, max(score) AS score FROM lists GROUP BY ALL),
pooled AS (SELECT query_id, key, pool_rank, origins, pool_fusion_score, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, key) AS pool_rank FROM pool) WHERE pool_rank <= {DEFAULTS.pool_cap})"""


@query(bm25_sql(queries=SUBQUERIES_SQL) + LISTS_SQL + POOL_SQL + "SELECT query_id, key, pool_rank, array_to_string(origins, ',') AS origins, pool_fusion_score FROM pooled")
def interleave_pool(table, spark):
    found = fusion.pool(lists(table), DEFAULTS.pool_cap)
    return found.withColumn("origins", F.array_join(F.col("origins").cast("array<string>"), ","))


def pooled(found):
    """The pool of lists() with each key's best score, as a stand-in for a reranker's."""
    best = found.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    return fusion.pool(found, DEFAULTS.pool_cap).join(best, ["query_id", "key"])


@query(bm25_sql(queries=SUBQUERIES_SQL) + LISTS_SQL + POOL_SQL + """, n AS (SELECT query_id, count(DISTINCT sub_idx) AS subs FROM lists GROUP BY ALL)
SELECT query_id, key, score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_rank) AS final_rank FROM pooled) JOIN n USING (query_id) WHERE final_rank <= greatest(10, 2 * subs)""")
def rerank_topk(table, spark):
    found = lists(table)
    subs = found.groupBy("query_id").agg(F.count_distinct("sub_idx").alias("subs"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank")
    ranked = pooled(found).withColumn("final_rank", F.row_number().over(order)).join(subs, "query_id")
    return ranked.where(F.col("final_rank") <= F.greatest(F.lit(DEFAULTS.top_k), 2 * F.col("subs"))).select("query_id", "key", "score", "final_rank")


@query()
def coverage_quota(table, spark):
    return select.coverage_quota(pooled(lists(table)))


def with_texts(table, found):
    """found (key, ...) with the source and text of its documents, which stay where they are unless it is large."""
    docs = table("documents").select(F.col("doc_id").alias("key"), "source", "text")
    return docs.join(lexical.bounded(found), "key")


@query()
def fanin_retain(table, spark):
    keys = questions(table).select("query_id", select.fan_in_key(text()).alias("mention"))
    rows = with_texts(table, materialise(pooled(lists(table)), "pooled")).join(lexical.bounded(keys), "query_id")
    rows = rows.withColumn("mentions", F.coalesce(F.contains(F.lower("text"), F.lower("mention")), F.lit(False)))
    return select.fan_in(rows.select("query_id", "key", "pool_rank", "score", "source", "mentions"))


@query(bm25_sql() + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored),
cut AS (SELECT *, count(*) FILTER (score >= 20) OVER (PARTITION BY query_id) AS good FROM ranked WHERE rank <= {K})
SELECT query_id, doc_id, score, rank FROM cut WHERE CASE WHEN good >= 3 THEN score >= 20 ELSE rank <= 3 END""")
def score_threshold(table, spark):
    return select.score_threshold(lexical.search(indexed(table), questions(table), text(), K), 20.0, DEFAULTS.min_kept)


#: Two hops: a passage's best documents, then those of its first sentence.
@query("WITH a AS (" + bm25_sql() + "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 12), b AS ("
       + bm25_sql(queries="SELECT item_id AS query_id, string_split(text, '.')[1] AS text FROM benchmark") + f"""SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 12),
keys AS (SELECT query_id, doc_id AS key, min((hop, rank)) AS first_seen FROM (SELECT *, 0 AS hop FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
SELECT query_id, key, merged_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_seen, key) AS merged_rank FROM keys) WHERE merged_rank <= {DEFAULTS.hop_chunks}""")  # fmt: skip
def multi_hop_merge(table, spark):
    index = lexical.build(table("documents"), text())
    hops = [lexical.search(index, questions(table).withColumn("text", t), text(), DEFAULTS.multi_k).withColumn("hop", F.lit(i)) for i, t in enumerate((text(), F.split(text(), "[.]")[0]))]
    return fusion.merge_hops(hops[0].unionByName(hops[1]).withColumnRenamed("doc_id", "key")).select("query_id", "key", "merged_rank")


@query("""SELECT p_partkey, p_size::INT AS size, p_name || ' (' || p_brand || '). ' || p_type AS text FROM part""")
def embed_text(table, spark):
    return table("part").select("p_partkey", F.col("p_size").alias("size"), documents.embedding_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text"))


@query("""SELECT p_partkey, left(p_name || ' ' || p_brand || ' ' || p_type, 200) AS title FROM part""")
def rerank_title(table, spark):
    return table("part").select("p_partkey", documents.record_title(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("title"))


@query("""SELECT doc_id, source || '::' || md5(text) AS chunk_key, md5(text) AS digest FROM documents""")
def chunk_keys(table, spark):
    return table("documents").select("doc_id", tx.chunk_key(F.col("source"), text(), True).alias("chunk_key"), F.md5("text").alias("digest"))
