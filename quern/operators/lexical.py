"""BM25 over a table of documents for a table of queries.

An index is a folder of segments. A segment has shards, statistics (term, df) and its size; shards are rows
that hold the postings of up to some thousand documents by term, each list with the greatest count and the
least length that it has, which bound what it can add to a score. Statistics are sums, so documents are
added as a segment of their own, and nothing is counted again.

A search sends the weighted terms of counted queries to the shards. A shard whose bounds don't reach a
query's k-th score so far is passed over; in the others, terms are added by their bounds until what is left
can't lift a document over the k-th score, and only documents that still may reach it are looked up in the
rest. What is found is scored anew in the order of the terms, so a score has the same bits whatever the
layout, and is rounded as score() rounds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.config import DEFAULTS, Config
from quern.operators.numbering import numbered
from quern.sources.tables import batches_of, materialise, new_path

#: Queries are broadcast up to this many distinct terms; beyond it they are shuffled.
BROADCAST_TERMS = 100_000
#: Bytes for each core under which a table is spread over all cores.
SMALL_SHARE = 4 << 20
#: Documents and postings of a shard, at most (one document may have more).
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 19
#: Texts that a task gets, and splits, at once. Of shards, it gets one.
TEXTS = 256
#: Rounding and sums of other orders stay below this.
SLACK = 2e-6

WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    """The same tokens as functions.text.tokens()."""
    return WORD.findall(text.lower())


def spread(df: DataFrame) -> DataFrame:
    """A small table, which may be a single task, over all cores; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


def term_counts(docs: DataFrame, text: Column, key: str, tokenise: Callable[[str], list[str]] = words) -> DataFrame:
    """(key, term, tf), a row for each term of each row, counted where it is. A text that is null has no terms."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                counts = [Counter(tokenise(t or "")) for t in part.column(1).to_pylist()]
                own = np.repeat(np.arange(len(part)), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int32())], [key, "term", "tf"])

    return docs.select(key, text.alias("text")).mapInArrow(run, f"{key} {kind}, term string, tf int")


class Shard:
    """Documents that are made into one row of SHARDS."""

    def __init__(self, most: int):
        self.limit = most
        self.docs, self.sources, self.dls, self.ids, self.tfs, self.sizes, self.vocabulary = [], [], [], [], [], [], {}

    def add(self, doc_id, source: str | None, dl: int, counts: dict[str, int]) -> None:
        known = self.vocabulary
        self.docs.append(doc_id)
        self.sources.append(source)
        self.dls.append(dl)
        self.ids += [known.setdefault(t, len(known)) for t in counts]
        self.tfs += counts.values()
        self.sizes.append(len(counts))

    @property
    def full(self) -> bool:
        return len(self.docs) >= self.limit or len(self.ids) >= SHARD_POSTINGS

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        ids, tfs, dls = np.array(self.ids, "i8"), np.array(self.tfs, "i4"), np.array(self.dls, "i4")
        order = np.argsort(ids, kind="stable")  # by term, then document
        places, tfs = np.repeat(np.arange(len(dls), dtype="i4"), self.sizes)[order], tfs[order]
        starts = np.r_[0, np.cumsum(np.bincount(ids, minlength=len(self.vocabulary)))].astype("i4")
        begin = starts[:-1]
        most, least = (np.maximum.reduceat(tfs, begin), np.minimum.reduceat(dls[places], begin)) if len(begin) else (tfs, tfs)
        rows = [self.docs, self.sources, dls, list(self.vocabulary), starts, places, tfs, most, least]
        return pa.RecordBatch.from_arrays([pa.array([r], f.type) for r, f in zip(rows, schema)], schema=schema)


SHARDS = "docs array<{kind}>, sources array<string>, dls array<int>, terms array<string>, starts array<int>, places array<int>, tfs array<int>, most array<int>, least array<int>"


def _sharded(rows: DataFrame, kind: str, counts: Callable[[pa.RecordBatch], Iterator[tuple]], most: int) -> DataFrame:
    """Rows of SHARDS of at most so many documents; counts: (doc_id, source, dl, counts) of a batch."""
    spark_schema = StructType.fromDDL(SHARDS.format(kind=kind))
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(most)
        for batch in batches:
            for row in counts(batch):
                shard.add(*row)
                if shard.full:
                    yield shard.batch(schema)
                    shard = Shard(most)
        if shard.docs:
            yield shard.batch(schema)

    return rows.mapInArrow(run, spark_schema)


@dataclass
class Index:
    """A folder of segments, those that the last version of its list names. An object sees the list as it
    was when it was first asked for, or as it has changed it since."""

    spark: SparkSession
    path: str
    kind: str
    tokenise: Callable[[str], list[str]] = words
    shard_docs: int = SHARD_DOCS
    told: tuple[int, list[str]] | None = None

    def listed(self) -> tuple[int, list[str]]:
        """The last version of the list, and its segments; a list has a row for each."""
        if self.told is None:
            rows = self.spark.read.schema("version long, segment string").parquet(f"{self.path}/list")
            last = rows.groupBy("version").agg(F.array_sort(F.collect_list("segment")).alias("segments")).orderBy(F.desc("version")).first()
            self.told = last["version"], last["segments"]
        return self.told

    def segments(self) -> list[str]:
        return self.listed()[1]

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{s}" for s in self.segments()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def shards(self) -> DataFrame:
        return self._read("shards", SHARDS.format(kind=self.kind))

    @property
    def stats(self) -> DataFrame:
        """(term, df) of all terms."""
        return self._read("stats", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))

    @property
    def corpus(self) -> DataFrame:
        """One row (n, avgdl, avg_idf)."""
        size = self._read("sizes", "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        n = size["n"] or 0
        avgdl = size["total"] / n if n else 1.0
        return self.stats.agg(F.lit(n).cast("long").alias("n"), F.lit(avgdl).alias("avgdl"), F.avg(raw_idf(F.lit(n), F.col("df"))).alias("avg_idf"))

    def _commit(self, shards: DataFrame, rows: int, segment: str, segments: list[str], version: int) -> None:
        """Write a segment, then the list that names it: what was broken off before that isn't there. The
        shards are made of so many rows at once."""
        # a reader decodes a row group as a whole, or thousands of its rows at once: a group is one shard
        with batches_of(self.spark, rows):
            shards.write.mode("overwrite").option("parquet.block.row.count.limit", 1).parquet(f"{self.path}/shards/{segment}")
        written = self.spark.read.schema(SHARDS.format(kind=self.kind)).parquet(f"{self.path}/shards/{segment}")
        df = F.zip_with(F.slice("starts", 2, F.size("terms")), F.slice("starts", 1, F.size("terms")), lambda a, b: a - b)
        lists = written.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), df.alias("df"))).alias("x"))
        lists.groupBy("x.term").agg(F.sum("x.df").alias("df")).write.mode("overwrite").parquet(f"{self.path}/stats/{segment}")
        length = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
        written.agg(F.sum(F.size("docs")).cast("long").alias("n"), F.sum(length).alias("total")).write.mode("overwrite").parquet(f"{self.path}/sizes/{segment}")
        self.spark.createDataFrame([(version, s) for s in segments], "version long, segment string").coalesce(1).write.mode("append").parquet(f"{self.path}/list")
        self.told = version, sorted(segments)

    def append(self, docs: DataFrame, text: Column, segment: str) -> None:
        """docs (doc_id, maybe source, ...) as a segment. One that is there already stays as it is, so that
        a batch of a stream that is run again adds nothing."""
        held = self.segments()
        if segment not in held:
            self._commit(sharded(docs, text, self.tokenise, self.shard_docs), TEXTS, segment, [*held, segment], self.listed()[0] + 1)

    def compact(self, segment: str) -> None:
        """All segments as one, from their postings; no text is read."""
        held = self.segments()
        if segment not in held:
            self._commit(_sharded(self.shards, self.kind, _documents, self.shard_docs), 1, segment, [segment], self.listed()[0] + 1)


def sharded(docs: DataFrame, text: Column, tokenise: Callable[[str], list[str]] = words, most: int = SHARD_DOCS) -> DataFrame:
    """docs (doc_id, maybe source): texts are read and split once, and counted where they are."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")

    def counts(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, len(batch), TEXTS):
            for i, s, t in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns)):
                found = tokenise(t or "")
                yield i, s, len(found), Counter(found)

    return _sharded(spread(docs).select("doc_id", source.alias("source"), text.alias("text")), docs.schema["doc_id"].dataType.simpleString(), counts, most)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, source, dl, counts) of the documents of shards."""
    for row in (r for at in range(len(batch)) for r in batch.slice(at, 1).to_pylist()):
        terms, starts = np.array(row["terms"], object), np.array(row["starts"])
        of, place, tf = np.repeat(np.arange(len(terms)), np.diff(starts)), np.array(row["places"]), np.array(row["tfs"])
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place, minlength=len(row["docs"])))
        for i, s, dl, at, end in zip(row["docs"], row["sources"], row["dls"], [0, *ends[:-1].tolist()], ends.tolist()):
            own = order[at:end]
            yield i, s, dl, dict(zip(terms[of[own]].tolist(), tf[own].tolist()))


def open_index(spark: SparkSession, path: str, kind: str = "bigint", tokenise: Callable[[str], list[str]] = words, shard_docs: int = SHARD_DOCS) -> Index:
    """The index at path, or a new one without documents. kind: of doc_id."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/list")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([(0, None)], "version long, segment string").coalesce(1).write.parquet(f"{path}/list")
        return Index(spark, path, kind, tokenise, shard_docs, (0, []))
    return Index(spark, path, kind, tokenise, shard_docs)


def build(docs: DataFrame, text: Column, tokenise: Callable[[str], list[str]] = words, shard_docs: int = SHARD_DOCS) -> Index:
    """An index of one segment in the shared folder. doc_id is a key."""
    index = open_index(docs.sparkSession, new_path(docs.sparkSession, "bm25"), docs.schema["doc_id"].dataType.simpleString(), tokenise, shard_docs)
    index.append(docs, text, "all")
    return index


def postings(index: Index) -> DataFrame:
    """(doc_id, dl, term, tf) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                docs, dls, terms, starts, places, tfs = (batch.column(i).slice(at, 1).flatten() for i in range(6))
                of = pa.array(np.repeat(np.arange(len(terms)), np.diff(starts.to_numpy())))
                for k in range(0, len(of), 1 << 16):
                    own, where = of.slice(k, 1 << 16), places.slice(k, 1 << 16)
                    yield pa.RecordBatch.from_arrays([docs.take(where), dls.take(where), terms.take(own), tfs.slice(k, 1 << 16)], ["doc_id", "dl", "term", "tf"])

    return index.shards.select("docs", "dls", "terms", "starts", "places", "tfs").mapInArrow(run, f"doc_id {index.kind}, dl int, term string, tf int")


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def idf(n: Column, df: Column, avg_idf: Column, config: Config = DEFAULTS) -> Column:
    """Terms in over half the documents get a share of the mean."""
    raw = raw_idf(n, df)
    return F.when(raw < 0, config.negative_idf_share * avg_idf).otherwise(raw)


def query_terms(queries: DataFrame, text: Column, tokenise: Callable[[str], list[str]] = words) -> DataFrame:
    """(query_id, term, weight): weight is the term's multiplicity, which counts."""
    return term_counts(queries, text, "query_id", tokenise).groupBy("query_id", "term").agg(F.sum("tf").alias("weight"))


def is_small(df: DataFrame, most: int = BROADCAST_TERMS) -> bool:
    """Has df at most so many rows?"""
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if is_small(df, most) else df


def weighted(index: Index, queries: DataFrame, query_text: Column, config: Config = DEFAULTS) -> DataFrame:
    """(query_id, term, weight, avgdl, idf) of the terms that count, written."""
    terms = materialise(query_terms(queries, query_text, index.tokenise), "query-terms")
    corpus = index.corpus.first()
    n, avgdl, avg_idf = corpus["n"], F.lit(corpus["avgdl"]), F.lit(corpus["avg_idf"] or 0.0)
    known = index._read("stats", "term string, df long").join(bounded(terms.select("term").distinct()), "term", "left_semi")
    df = known.groupBy("term").agg(F.sum("df").alias("df"))
    found = terms.join(df, "term").select("query_id", "term", "weight", avgdl.alias("avgdl"), idf(F.lit(n), F.col("df"), avg_idf, config).alias("idf"), (F.col("df") / n).alias("share"))
    if config.df_cutoff:
        common = F.col("share") >= config.df_cutoff
        rare = F.max(~common).over(Window.partitionBy("query_id"))
        found = found.withColumn("rare", rare).where(~common | ~F.col("rare")).drop("rare")
    return materialise(found.drop("share"), "weighted-terms")


def score(index: Index, queries: DataFrame, query_text: Column, config: Config = DEFAULTS) -> DataFrame:
    """queries (query_id, ...): -> (query_id, doc_id, score), a row for each document that has a term of the
    query, scores rounded to 6 places. A sum goes by the order of the terms, so its bits are always the same."""
    terms = weighted(index, queries, query_text, config)
    gain = F.col("idf") * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
    found = postings(index).join(bounded(terms), "term")
    parts = F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * gain).alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["part"])
    return found.groupBy("query_id", "doc_id").agg(total.alias("score")).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


def rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


class Asked:
    """Counted queries, as tasks get them: their terms in order, with weights."""

    def __init__(self, rows: list, config: Config):
        self.words = sorted({r["term"] for r in rows})
        place = {w: i for i, w in enumerate(self.words)}
        self.k1, self.b, self.avgdl = config.k1, config.b, rows[0]["avgdl"] if rows else 1.0
        own: dict = {}
        for r in sorted(rows, key=lambda r: r["term"]):
            own.setdefault(r["query_id"], []).append((place[r["term"]], r["weight"], r["idf"]))
        self.ids = sorted(own, key=lambda q: (q is None, q))
        self.terms = {q: tuple(np.array(x, t) for x, t in zip(zip(*own[q]), ("i8", "f8", "f8"))) for q in self.ids}

    def part(self, weight: float, idf: float, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return weight * (idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl)))


class Held:
    """A shard, as a task has it."""

    def __init__(self, batch: pa.RecordBatch, asked: Asked):
        docs, self.sources, dls, terms, starts, places, tfs, most, least = (batch.column(i).flatten() for i in range(9))
        self.docs, self.asked = docs, asked
        self.dls, self.starts, self.places, self.tfs, self.most, self.least = (x.to_numpy() for x in (dls, starts, places, tfs, most, least))
        self.where = pc.index_in(pa.array(asked.words, pa.string()), terms).fill_null(-1).to_numpy()

    def of(self, query) -> tuple[np.ndarray, ...]:
        """Of a query's terms that the shard has, in order: lists, weights, idfs, and the most each can add."""
        at, weight, idf = self.asked.terms[query]
        lists = self.where[at]
        some = lists >= 0
        lists, weight, idf = lists[some], weight[some], idf[some]
        return lists, weight, idf, np.maximum(self.asked.part(weight, idf, self.most[lists], self.least[lists]), 0.0)

    def list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.places[a:b], self.tfs[a:b]

    def whole(self, lists: np.ndarray, weight: np.ndarray, idf: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The scores of some documents (places, rising), added in the order of the terms."""
        out = np.zeros(len(chosen))
        for i, w, x in zip(lists, weight, idf):
            places, tfs = self.list(i)
            at = np.searchsorted(places, chosen)
            hit = at < len(places)
            hit[hit] = places[at[hit]] == chosen[hit]
            out[hit] += self.asked.part(w, x, tfs[at[hit]], self.dls[chosen[hit]])
        return out

    def candidates(self, query, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (places, scores) that may be among the k best, given that a score under `least` isn't;
        and how many documents were scored as a whole."""
        lists, weight, idf, bound = self.of(query)
        none = np.zeros(0, "i8"), np.zeros(0), 0
        if not len(lists) or bound.sum() < least - SLACK:
            return none
        order = np.argsort(-bound, kind="stable")
        left = np.r_[np.cumsum(bound[order][::-1])[::-1], 0.0]  # what the terms from here on can add
        total, seen, i = np.zeros(len(self.dls)), np.zeros(len(self.dls), bool), 0
        while i < len(order) and not left[i] < least - SLACK:
            t = order[i]
            places, tfs = self.list(lists[t])
            total[places] += self.asked.part(weight[t], idf[t], tfs, self.dls[places])
            seen[places] = True
            i += 1
        (some,) = np.nonzero(seen & (total + left[i] >= least - SLACK))
        if len(some) > k:  # without those that the k-th of what is sure already leaves behind
            sure = np.partition(total[some], len(some) - k)[len(some) - k]
            some = some[total[some] + left[i] >= max(least, sure) - SLACK] if (idf >= 0).all() else some
        return some, rounded(self.whole(lists, weight, idf, some)), len(some)


def _in_groups(index: Index, terms: DataFrame, run: Callable[[list, DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """What run(rows of terms, rows of more) gives of the shards, for groups of queries of about BROADCAST_TERMS rows
    each. It is written, so that a task can be handed one shard at once, and is searched for once, however often
    it is used."""
    n = max(terms.count(), more.count() if more is not None else 0)
    groups = max(1, -(-n // BROADCAST_TERMS))
    out = None
    for g in range(groups):
        own = lambda df: df if groups == 1 else df.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        part = run(own(terms).collect(), own(more) if more is not None else None)
        with batches_of(index.spark, 1):
            part = materialise(part, "lexical-hits")
        out = part if out is None else out.unionByName(part)
    return out


def search(index: Index, queries: DataFrame, query_text: Column, k: int, config: Config = DEFAULTS) -> DataFrame:
    """The k best documents of each query: (query_id, doc_id, score, rank), as top() of score() gives, bit for
    bit. k rows a query and task are shuffled. It counts and collects the queries' terms, in groups of a
    bounded number, while the plan is made."""
    return top(_searched(index, queries, query_text, k, config).drop("scored"), k)


def work(index: Index, queries: DataFrame, query_text: Column, k: int, config: Config = DEFAULTS) -> DataFrame:
    """(query_id, scored): of how many documents a search makes up the whole score, for each query."""
    return _searched(index, queries, query_text, k, config).groupBy("query_id").agg(F.sum("scored").alias("scored"))


def _searched(index: Index, queries: DataFrame, query_text: Column, k: int, config: Config) -> DataFrame:
    terms = weighted(index, queries, query_text, config)
    asks = terms.schema["query_id"].dataType
    spark_schema = StructType.fromDDL(f"query_id {asks.simpleString()}, doc_id {index.kind}, score double, scored long")
    schema = to_arrow_schema(spark_schema)

    def run(rows: list, _) -> DataFrame:
        sent = index.spark.sparkContext.broadcast(Asked(rows, config))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            best, count = {q: [] for q in asked.ids}, dict.fromkeys(asked.ids, 0)
            for batch in batches:
                for at in range(len(batch)):
                    shard = Held(batch.slice(at, 1), asked)
                    for q in asked.ids:
                        held = best[q]
                        some, score, scored = shard.candidates(q, k, held[-1][0] if len(held) >= k else -np.inf)
                        count[q] += scored
                        if len(some):
                            names = shard.docs.take(pa.array(some)).to_pylist()
                            best[q] = sorted([*held, *zip(score.tolist(), names)], key=lambda x: (-x[0], x[1] is not None, x[1]))[:k]
            out = [(q, i, s, count[q] if n == 0 else 0) for q in asked.ids for n, (s, i) in enumerate(best[q])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return index.shards.mapInArrow(find, spark_schema)

    return _in_groups(index, terms, run)


def scores(docs: DataFrame, queries: DataFrame, text: Column, query_text: Column, config: Config = DEFAULTS) -> DataFrame:
    """score() of an index that is built for these queries."""
    return score(build(docs, text), queries, query_text, config)


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The k best of each group; equal scores by doc_id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn(rank, place).where(F.col(rank) <= k)


def scoped(index: Index, queries: DataFrame, scopes: DataFrame, query_text: Column, k: Column | int, config: Config = DEFAULTS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """scopes (query_id, source, and what `by` and k name), of an index whose documents had a source: the k
    best documents of each source in scope by the statistics of the whole corpus, without a filter on
    terms. Only documents in scope are scored; those without a term of the query count as 0. The sources of
    a scope take turns: scoped_rank goes through their firsts, their seconds, ..."""
    plain = Config(k1=config.k1, b=config.b)
    terms = weighted(index, queries, query_text, plain)
    own = (F.lit(k) if isinstance(k, int) else k).cast("int")
    known = scopes.withColumn("source", F.col("source").cast("string")).withColumn("_k", own)
    known = materialise(numbered(known, [*by, "source"], name="_scope", written="scopes"), "scopes")
    spark_schema = StructType.fromDDL(f"_scope long, doc_id {index.kind}, score double")
    schema = to_arrow_schema(spark_schema)

    def run(rows: list, some: DataFrame) -> DataFrame:
        wanted: dict = {}
        for r in some.select("_scope", "query_id", "source", "_k").collect():
            wanted.setdefault(r["source"], []).append((r["query_id"], r["_scope"], r["_k"]))
        sent = index.spark.sparkContext.broadcast((Asked(rows, plain), wanted))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, wanted = sent.value
            for batch in batches:
                for at in range(len(batch)):
                    shard, out = Held(batch.slice(at, 1), asked), []
                    places: dict = {}
                    for place, source in enumerate(shard.sources.to_pylist()):
                        if source in wanted:
                            places.setdefault(source, []).append(place)
                    for source, own in places.items():
                        own, names = np.array(own), shard.docs.take(pa.array(own)).to_pylist()
                        for q, scope, k in wanted[source]:
                            score = rounded(shard.whole(*shard.of(q)[:3], own)) if q in asked.terms else np.zeros(len(own))
                            reach = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                            (near,) = np.nonzero(score >= reach)
                            out += sorted(((scope, names[i], float(score[i])) for i in near), key=lambda x: (-x[2], x[1] is not None, x[1]))[:k]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return index.shards.mapInArrow(find, spark_schema)

    found = _in_groups(index, terms, run, known).join(known, "_scope")
    depth = F.row_number().over(Window.partitionBy(*by, "source").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("depth", depth).where(F.col("depth") <= F.col("_k")).drop("_k", "_scope")
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("depth", "source", "doc_id"))
    return best.withColumn("scoped_rank", turn).withColumn("fusion_score", F.round(1 / (config.rrf_k + F.col("scoped_rank")), 6))
