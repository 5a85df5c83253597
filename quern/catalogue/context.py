"""Chunks, neighbours, runs, budgets, conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.catalogue.registry import query
from quern.catalogue.retrieval import bm25_sql, indexed, questions
from quern.config import DEFAULTS
from quern.functions import text as tx
from quern.operators import chunk, context, control, lexical
from quern.sources.tables import materialise

#: A document is a chunk: its source is the page, its place in it by doc_id.
CHUNKS_SQL = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, text AS page_content FROM documents"
HITS_SQL = bm25_sql() + f", chunks AS ({CHUNKS_SQL}), hits AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5)"


def contents(table):
    return table("documents").select("doc_id", "source", F.col("text").alias("page_content"))


def places(table):
    """Chunks without their texts, which numbering would shuffle, hand to Python and write."""
    return chunk.with_ordinal(table("documents").select("doc_id", "source"), "source", "doc_id")


def digested(rows):
    """places() of rows (doc_id, source, page_content) with a digest of each text."""
    return chunk.with_ordinal(rows.select("doc_id", "source", F.md5("page_content").alias("digest")), "source", "doc_id")


def hits(table):
    return lexical.search(indexed(table), questions(table), F.col("text"), 5).select("query_id", "doc_id", "rank")


def ordinals(table):
    docs = places(table)
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return context.neighbours(docs.join(F.broadcast(hits(table)), "doc_id").select("query_id", "source", "chunk_index"), sizes, DEFAULTS.radius)


NEAR_SQL = f""", near AS (SELECT DISTINCT h.query_id, o.source, o.chunk_index FROM hits h JOIN chunks c USING (doc_id) JOIN chunks o ON o.source = c.source AND o.chunk_index BETWEEN c.chunk_index - {DEFAULTS.radius} AND c.chunk_index + {DEFAULTS.radius})"""


@query()
def split_chunks(table, spark):
    return chunk.split(table("documents").select(F.col("doc_id").alias("source"), "text"))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('corpus:' || source || '#' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1))) AS h FROM documents)""")
def chunk_ids(table, spark):
    return places(table).select("doc_id", chunk.chunk_id("corpus", F.col("source"), F.col("chunk_index")).alias("id"))


@query("SELECT count(*) AS chunks, floor(avg(length(text)))::BIGINT AS avg_size, min(length(text)) AS min_size, max(length(text)) AS max_size FROM documents")
def chunk_size_stats(table, spark):
    return chunk.size_stats(table("documents"), F.col("text"))


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT source, md5(page_content) AS digest, min(chunk_index) AS chunk_index FROM c GROUP BY ALL")
def first_ordinals(table, spark):
    return context.first_ordinal(digested(contents(table)))


@query(HITS_SQL + NEAR_SQL + "SELECT query_id, source, chunk_index FROM near")
def neighbor_expand(table, spark):
    return ordinals(table)


@query(HITS_SQL + NEAR_SQL + "SELECT query_id, source, min(chunk_index) AS run_start, max(chunk_index) AS run_end, count(*) AS n FROM (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, source ORDER BY chunk_index) AS island FROM near) GROUP BY query_id, source, island")
def ordinal_runs(table, spark):
    return context.runs(ordinals(table))


@query(f"""SELECT doc_id, source, n, so_far FROM (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS so_far FROM (SELECT doc_id, source, length(left(text, {DEFAULTS.judge_doc_chars})) AS n FROM documents)) WHERE so_far <= {DEFAULTS.judge_chars}""")
def context_budget(table, spark):
    found = context.budget_prefix(table("documents"), F.col("text"), "source", ["doc_id"], DEFAULTS.judge_doc_chars, DEFAULTS.judge_chars)
    return found.select("doc_id", "source", F.length("cut").cast("long").alias("n"), "so_far")


def chosen(table):
    rows = contents(table).join(lexical.bounded(hits(table)), "doc_id")
    return rows.select("query_id", "rank", "source", "page_content", F.concat(F.lit("https://x.org/"), "source").alias("url"), F.lit("a title").alias("title"), F.concat(F.lit("file"), F.regexp_extract("source", "([0-9]+)", 1)).alias("filename"), F.lit("page").alias("category"))


@query()
def context_render(table, spark):
    return context.render(chosen(table), digested(contents(table)), texts=contents(table))


#: Without a limit that binds: blocks of sources in the order in which they are first chosen, runs of neighbours in each.
#: Neighbours are whole documents between marks of their own, so that they share no text at their ends.
RENDER_SQL = HITS_SQL + NEAR_SQL + """, firsts AS (SELECT query_id, source, min(rank) AS first_rank FROM hits JOIN chunks USING (doc_id) GROUP BY ALL),
isles AS (SELECT query_id, source, chunk_index, '<' || doc_id || '>' || page_content || '<' || doc_id || '>' AS page_content, chunk_index - row_number() OVER (PARTITION BY query_id, source ORDER BY chunk_index) AS island FROM near JOIN chunks USING (source, chunk_index)),
bodies AS (SELECT query_id, source, min(chunk_index) AS pos, string_agg(page_content, chr(10) ORDER BY chunk_index) AS body FROM isles GROUP BY query_id, source, island),
texts AS (SELECT query_id, source, string_agg(body, chr(10) || '[...]' || chr(10) ORDER BY pos) AS body FROM bodies GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS i FROM texts JOIN firsts USING (query_id, source))
SELECT query_id, md5(chr(10) || chr(10) || string_agg('Document ' || i || ': [URL: https://x.org/' || source || ']' || chr(10) || 'Filename: file' || regexp_extract(source, '([0-9]+)', 1) || chr(10) || 'Category: page' || chr(10) || chr(10) || body, chr(10) || chr(10) || repeat('-', 60) || chr(10) || chr(10) ORDER BY i)) AS digest, count(*) AS sources FROM numbered GROUP BY query_id"""


@query(RENDER_SQL)
def context_render_whole(table, spark):
    own = F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">"))
    rows = contents(table).withColumn("page_content", F.concat(own, "page_content", own))
    names = [F.concat(F.lit("https://x.org/"), "source").alias("url"), F.concat(F.lit("file"), F.regexp_extract("source", "([0-9]+)", 1)).alias("filename"), F.lit("page").alias("category")]
    picked = rows.join(lexical.bounded(hits(table)), "doc_id").select("query_id", "rank", "source", "page_content", *names)
    found = context.render(picked, digested(rows), limit=1 << 30, texts=rows)
    return found.select("query_id", F.md5("context").alias("digest"), F.col("sources").cast("long").alias("sources"))


@query(HITS_SQL + """, s AS (SELECT DISTINCT query_id, 's' || doc_id AS source, lang, source AS url, text FROM hits JOIN documents USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source) AS i FROM s)
SELECT query_id, chr(10) || chr(10) || repeat('-', 60) || chr(10) || chr(10) || string_agg('Document ' || i || ': [URL: ' || url || ']' || chr(10) || 'Filename: ' || source || '.txt' || chr(10) || 'Category: ' || lang || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS context FROM n WHERE text <> '' GROUP BY query_id""")
def context_full_documents(table, spark):
    """The whole texts of the best documents, each a file of its own."""
    source = F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source")
    files = table("documents").select(source, "text", F.col("source").alias("url"), F.lit(None).cast("string").alias("title"), F.concat(source, F.lit(".txt")).alias("filename"), F.col("lang").alias("category"))
    return context.full_documents(hits(table).select("query_id", source), files)


#: Two of the fields that a controller looks for stand before each text, one of them in every second twice.
FIELDS = "'Course Credits | ' || (doc_id % 5) || chr(10) || 'Name |  A  B' || (doc_id % 2) || chr(10) || 'Other | x' || chr(10)"


@query(HITS_SQL + f""", t AS (SELECT query_id, rank, source, {FIELDS} || page_content AS t, doc_id FROM hits JOIN chunks USING (doc_id)),
f AS (SELECT query_id, source, min(rank) AS first_rank, count(*) AS chunks, arg_min(t, rank) AS t FROM t GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, source) AS place FROM f),
v AS (SELECT query_id, source, field, min(pos) AS pos FROM (
  SELECT query_id, source, 'Course Credits | ' || (doc_id % 5) AS field, rank * 10 AS pos FROM t UNION ALL SELECT query_id, source, 'Name | A B' || (doc_id % 2), rank * 10 + 1 FROM t) GROUP BY ALL),
g AS (SELECT query_id, source, string_agg(field, '; ' ORDER BY pos) AS fields FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS n FROM v) WHERE n <= {DEFAULTS.digest_fields} GROUP BY ALL)
SELECT query_id, source, place, chunks, left(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), {DEFAULTS.digest_chars}) AS head, fields FROM p JOIN g USING (query_id, source) WHERE place <= {DEFAULTS.digest_sources}""")
def evidence_digest(table, spark):
    d = F.col("doc_id")
    rows = contents(table).join(lexical.bounded(hits(table)), "doc_id")
    text = F.concat(F.lit("Course Credits | "), (d % 5).cast("string"), F.lit("\nName |  A  B"), (d % 2).cast("string"), F.lit("\nOther | x\n"), "page_content")
    return context.digest(rows, text)


@query("""SELECT source, count(*) AS chunks, count(DISTINCT k) AS short_keys, count(DISTINCT f) AS full_keys FROM (SELECT source, source || '::' || left(text, 200) AS k, source || '::' || md5(text) AS f FROM documents) GROUP BY source""")
def doc_key_collisions(table, spark):
    source, text = F.col("source"), F.col("text")
    keys = table("documents").select("source", tx.chunk_key(source, text).alias("k"), tx.chunk_key(source, text, True).alias("f"))
    return keys.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("k").alias("short_keys"), F.count_distinct("f").alias("full_keys"))


# conversations


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Student: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history, count(*) AS messages FROM m WHERE back <= {2 * DEFAULTS.history_turns} GROUP BY conv_id""")
def session_window_turns(table, spark):
    return control.history(table("conversations").where("role <> 'system'"), DEFAULTS.history_turns)


VIEW_SQL = """WITH v AS (SELECT conv_id, turn, text || chr(10) || '**Sources**: [1] x' AS a FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, regexp_replace(regexp_replace(a, '(?is)\\n[ \\t*#]*Sources[ \\t*#]*:?.*\\z', ''), '[ \\t\\n\\x0B\\f\\r]+\\z', '') AS s FROM v)"""


@query(f"""{VIEW_SQL}
SELECT conv_id, turn, CASE WHEN s = '' THEN left(a, {DEFAULTS.history_answer_chars}) WHEN length(s) > {DEFAULTS.history_answer_chars} THEN regexp_replace(left(s, {DEFAULTS.history_answer_chars}), '[ \\t\\n\\x0B\\f\\r]+\\z', '') || ' ...' ELSE s END AS view FROM s""")
def history_view(table, spark):
    said = table("conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", tx.history_view(F.concat("text", F.lit("\n**Sources**: [1] x")), DEFAULTS.history_answer_chars).alias("view"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations QUALIFY role = 'assistant'""")
def feedback_question(table, spark):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return table("conversations").withColumn("question", asked).where("role = 'assistant'").select("conv_id", "turn", "question")


SIMPLE_SQL = """len(string_split_regex(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+')) < 12 AND length(text) - length(replace(text, '?', '')) <= 1 AND NOT regexp_matches(lower(text), ',|;| and | or | vs | versus ')"""


@query(f"SELECT conv_id, turn, {SIMPLE_SQL} AS simple, CASE WHEN text = '' THEN 'refuse' WHEN {SIMPLE_SQL} THEN 'single' ELSE 'decompose' END AS route FROM conversations WHERE role = 'user'")
def controller_route(table, spark):
    simple = tx.is_simple_question(F.col("text"))
    return table("conversations").where("role = 'user'").select("conv_id", "turn", simple.alias("simple"), F.when(F.col("text") == "", "refuse").when(simple, "single").otherwise("decompose").alias("route"))


#: What is missing: a user's first sentence, one of the vague phrases, the two with blanks around, none.
MISSING_SQL = f"""SELECT conv_id, turn, i, x, length(y) >= 3 AND y NOT IN ({", ".join(f"'{v}'" for v in tx.VAGUE)}) AND (regexp_matches(y, '[0-9]') OR regexp_matches(y, '[^ \\t\\n\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]+[^ \\t\\n\\x0B\\f\\r]')) AS concrete
FROM (SELECT *, lower(regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS y FROM (
  SELECT conv_id, turn, 0 AS i, string_split(text, '.')[1] AS x FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 1, (list_value({", ".join(f"'{v}'" for v in tx.VAGUE)}))[(turn % {len(tx.VAGUE)} + 1)::BIGINT] FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 2, '  The Rest ' || CASE WHEN turn % 2 = 0 THEN '' ELSE 'of COMP ' || turn END FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 3, '' FROM conversations WHERE role = 'user'))"""


@query(MISSING_SQL)
def missing_is_concrete(table, spark):
    asked = table("conversations").where("role = 'user'")
    vague = F.array(*map(F.lit, tx.VAGUE))
    rest = F.concat(F.lit("  The Rest "), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("of COMP "), F.col("turn").cast("string"))))
    items = F.array(F.split("text", "[.]")[0], F.element_at(vague, (F.col("turn") % len(tx.VAGUE) + 1).cast("int")), rest, F.lit(""))
    rows = asked.select("conv_id", "turn", F.posexplode(items).alias("i", "x"))
    return rows.select("conv_id", "turn", "i", "x", tx.is_concrete(F.array("x")).alias("concrete"))


def evidence_of(table, held):
    """What is held as one text for each question. The documents are read for it once."""
    rows = table("documents").withColumnRenamed("doc_id", "key").join(lexical.bounded(held), "key").select("query_id", F.col("merged_rank").alias("rank"), "source", "text")
    rows = materialise(rows, "evidence")
    totals = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources")).withColumn("sub_queries", F.array().cast("array<string>"))
    return context.evidence(context.digest(rows, F.col("text")), totals)


@query()
def controller_loop(table, spark):
    """All passages as questions that name two codes, one of them nowhere, and some greetings: which way they
    go. The evidence is the digest of the best documents."""
    index = lexical.build(table("documents"), F.col("text"))
    asked = questions(table).withColumn("text", F.when(F.col("query_id") % 5 == 0, "Thanks!").when(F.col("query_id") % 7 == 0, " ").otherwise(F.concat(F.lit("ABCD 1234: "), "text")))

    def search(going, hop):
        what = going.select("query_id", F.when(F.size("queries") > 0, F.array_join("queries", " ")).otherwise(F.col("text")).alias("text"))
        return lexical.search(index, what, F.col("text"), DEFAULTS.top_k).withColumnRenamed("doc_id", "key")

    return control.run(asked, control.lexical_controller, search, lambda held: evidence_of(table, held)).routes


@query()
def answer_batch(table, spark):
    """All passages as questions through the whole flow over all documents."""
    from quern.plans import retrieval

    engine = retrieval.build(table("documents").select(F.col("doc_id").alias("source"), "text"))
    found = retrieval.answer(engine, questions(table))
    return found.select("query_id", "chunks", "sources", "misses", "chars", F.length("answer").alias("answer_chars"))


@query("""WITH p AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS hop, event_id FROM events)
SELECT query_id, sum(event_id % 40)::BIGINT AS n_candidates, sum(event_id % 3)::BIGINT AS n_scoped, sum(event_id % 2)::BIGINT AS n_rerank_calls, sum(event_id % 5)::BIGINT AS fanin_swaps, arg_max(event_id % 7 = 0, hop) AS rerank_skipped, arg_max((event_id % 11) / 10, hop) AS pool_consensus, count(*) AS passes FROM p GROUP BY query_id""")
def hop_stats(table, spark):
    e = F.col("event_id")
    rows = table("events").select(F.col("user_id").alias("query_id"), e.alias("hop"), (e % 40).alias("n_candidates"), (e % 3).alias("n_scoped"), (e % 2).alias("n_rerank_calls"), (e % 5).alias("fanin_swaps"), (e % 7 == 0).alias("rerank_skipped"), ((e % 11) / 10).alias("pool_consensus"))
    return control.hop_stats(rows)


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Ada' WHEN turn % 3 = 1 THEN 'Nobody' END AS answer FROM conversations WHERE role = 'user'""")
def fixed_answers(table, spark):
    asked = F.when(F.col("turn") % 3 == 0, "  who is the BEST teacher? ").when(F.col("turn") % 3 == 1, "who is the worst teacher?").otherwise(F.col("text"))
    return table("conversations").where("role = 'user'").select("conv_id", "turn", control.fixed_answer(asked, {"Who is the best teacher?": "Ada", "WHO IS THE WORST TEACHER?": "Nobody"}).alias("answer"))
