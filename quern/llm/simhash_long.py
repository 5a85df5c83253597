"""The SimHash operator with long fingerprints, for texts that share 0.8 or more of their 5-word shingles.

At that similarity the bits of two fingerprints differ at a rate of 0.15, so 64 bits with 3 that may differ
find next to nothing. Fingerprints of 512 bits have 64 byte positions, of which such texts share 17 on
average (strangers share 0.25). An index of byte positions posts each under TRIPLES choices of 3 positions;
pairs that meet in a list have their shared bytes tallied over all positions, pairs that reach
LEAST_SHARED are retained and verified, first by their bits, then by the shingles themselves.

No number of matches is sure at a rate of 0.15 a bit, as each byte may differ: the minimum is one that a
pair of similarity 0.8 falls short of with probability 0.006, and such a pair meets in a list with 0.92,
more similar ones with more (0.96 at 0.82, 0.985 at 0.85, 1.00 at 0.9: 600 pairs of sets each).

Lists give stars, components of these are sets of candidates, and within one all pairs are compared by
their shingles (a text that is linked isn't compared again as a target). Lists and sets of candidates
over a bound are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import each, free_name, materialise
from quern.llm.components import components
from quern.llm.simhash import unite, whole_lists

WIDTH, LEAST, SEED = 5, 0.8, 42
#: 64-bit words of a fingerprint, byte positions, choices of 3 positions, and what a pair must reach.
WORDS = 8
POSITIONS, TRIPLES, LEAST_SHARED, MOST_BITS = 8 * WORDS, 252, 9, 102
#: Shingles that are mixed at a time, so that a text of any length takes bounded memory.
AT_ONCE = 255
#: Longest list and largest set of candidates that one task compares.
LONG, LARGE, BLOCK = 1024, 1000, 64
#: What is broadcast up to this number of rows; beyond it the other side is shuffled.
BROADCAST_ROWS = 500_000

ADDED = (np.arange(1, WORDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))[:, None]
#: (TRIPLES, 3): each permutation of the positions gives as many disjoint choices as it has.
CHOSEN = np.concatenate([np.random.default_rng(i).permutation(POSITIONS)[: POSITIONS // 3 * 3].reshape(-1, 3) for i in range(SEED, SEED + -(-TRIPLES // (POSITIONS // 3)))])[:TRIPLES]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of runs of width words; a shorter text is one run. None without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and just the white space of ASCII
    if not words:
        return np.zeros(0, "u8")
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(run), SEED) for run in runs]), ">u8").astype("u8"))


def node_of(found: np.ndarray) -> int:
    """The identity of a set of shingles. Signed."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def print_of(found: np.ndarray) -> bytes:
    """A bit is set if it is in over half of the shingles' hashes, each mixed to 512 bits."""
    total = np.zeros(64 * WORDS, "i8")
    for at in range(0, len(found), AT_ONCE):
        z = found[None, at : at + AT_ONCE] + ADDED
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(np.ascontiguousarray(z.T).view("u1"), axis=1), axis=0, dtype="u1")  # at most 255 ones
    return np.packbits(2 * total > len(found)).tobytes()


def prints(text: Column) -> Column:
    """struct<node, print> of whole texts."""

    @F.arrow_udf("struct<node: long, print: binary>")
    def run(texts: pa.Array) -> pa.Array:
        found = [(node_of(some), print_of(some)) for some in map(shingles, each(texts))]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.int64(), pa.binary()))], ["node", "print"])

    return run(text)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), POSITIONS)


def postings(classes: DataFrame) -> DataFrame:
    """classes (node, print): (key, node) for each choice of positions; the key is the choice and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                chosen = _bytes(batch.column(1))[:, CHOSEN].astype("i8")  # by print, choice, position
                key = np.arange(TRIPLES) << 24 | chosen[..., 0] << 16 | chosen[..., 1] << 8 | chosen[..., 2]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), TRIPLES))], ["key", "node"])

    return classes.select("node", "print").mapInArrow(run, "key long, node long")


def near_of_list(own: np.ndarray) -> np.ndarray:
    """own: the bytes of a list's prints. The place of the first print in the component of each, by pairs
    that share enough positions and differ in few enough bits."""
    label, bits = np.arange(len(own)), own.view("u8")
    for at in range(0, len(own), BLOCK):
        tally = (own[at : at + BLOCK, None] == own[None, at:]).sum(-1, dtype="u1")
        a, b = np.nonzero(tally >= LEAST_SHARED)
        a, b = a[a < b] + at, b[a < b] + at
        near = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= MOST_BITS
        unite(label, a[near], b[near])
    return label


def candidates(classes: DataFrame, long: int = LONG) -> DataFrame:
    """classes (node, print), distinct nodes: stars (a, b) of the components within each list. A list of
    over `long` entries is cut into parts of about that many, and each two parts (and each one) are compared
    in a tile of their own, so that no task holds more than two parts and each pair of a list meets."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = postings(classes.select("node", "print").repartition(tasks, "node"))  # each row becomes TRIPLES rows
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = materialise(lists.withColumn("parts", F.ceil(F.col("n") / long)), "lists")
    own = lists.select(F.struct("key").alias("list"), "parts")  # a struct, so that a join may split a long list
    members = posted.withColumn("list", F.struct("key")).join(own, "list")
    part, other = F.pmod(F.xxhash64("node"), "parts"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    tiles = F.transform(other, lambda o: F.greatest(part, o) * F.col("parts") + F.least(part, o))
    entries = members.select("key", F.explode(tiles).alias("part"), "node").join(classes.select("node", "print"), "node")
    sorted_ = entries.select("key", "part", "node", "print").repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def stars(rows: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        size = np.diff(np.r_[begin, len(rows)])
        own, node = np.ascontiguousarray(rows[:, 3:]).view("u1").reshape(len(rows), POSITIONS), rows[:, 2]
        pair = begin[size == 2]
        near = ((own[pair] == own[pair + 1]).sum(1) >= LEAST_SHARED) & (np.bitwise_count(own[pair] ^ own[pair + 1]).sum(1, dtype="i8") <= MOST_BITS)
        a, b = [node[pair[near]]], [node[pair[near] + 1]]
        for at, n in zip(begin[size > 2], size[size > 2]):
            label = near_of_list(own[at : at + n])
            (rest,) = np.nonzero(label != np.arange(n))
            a.append(node[at + label[rest]])
            b.append(node[at + rest])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (np.hstack([np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1), _bytes(batch.column(3)).view("i8")]) for batch in batches if len(batch))
        for rows in whole_lists(arrays, 2):
            yield stars(rows)

    return sorted_.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def similar(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For distinct sets: the place of the first set in the component of each, by links of all pairs of
    a similarity of at least `least`."""
    sizes = np.array([len(s) for s in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    place, mark = np.full(len(sets), -1), np.zeros(len(vocabulary), bool)
    rest, end, open_ = np.arange(len(sets)), np.cumsum(sizes), np.ones(len(sets), bool)
    for first in range(len(sets)):
        if place[first] >= 0:
            continue
        place[first], frontier = first, [first]
        while frontier:
            open_ = place[rest] < 0
            if 2 * open_.sum() < len(rest):
                rest = rest[open_]
                flat = np.concatenate([own[i] for i in rest]) if len(rest) else flat[:0]
                end, open_ = np.cumsum(sizes[rest]), open_[open_]
            if not len(rest):
                return np.where(place < 0, first, place)
            x = frontier.pop()
            mark[own[x]] = True
            upto = np.r_[0, np.cumsum(mark[flat])]
            mark[own[x]] = False
            shared = upto[end] - upto[end - sizes[rest]]
            near = rest[open_ & (shared + 1e-9 >= least * (sizes[x] + sizes[rest] - shared))]
            place[near] = first
            frontier += near.tolist()
    return place


def verified(texts: DataFrame, by: list[str]) -> DataFrame:
    """texts (node, text, and the columns `by` of a set): (node, group), group the same for the nodes that
    links within a set reach."""

    def run(table: pa.Table) -> pa.Table:
        found = {}
        for node, text in zip(table["node"].to_pylist(), table["text"].to_pylist()):
            if node not in found and node_of(some := shingles(text)) == node:
                found[node] = some
        nodes = sorted(found)
        first = similar([found[n] for n in nodes]) if nodes else []
        return pa.table({"node": pa.array(nodes, pa.int64()), "group": pa.array([nodes[i] for i in first], pa.int64())})

    return texts.groupBy(*by).applyInArrow(run, "node long, group long")


def _large(texts: DataFrame, sizes: DataFrame, large: int) -> DataFrame:
    """verified() of sets of candidates (component, node, text) that are too large for one task; sizes
    (component, n, least). First each part of a set with the set's least node; what is linked to the
    set's greatest group by then needs no more among itself. The others are compared with all of the set,
    part by part, so that no pair of different groups is left out."""
    of = lambda df: df.withColumn("set", F.struct("component"))  # noqa: E731  dealt anew, so that a join may split a set
    parts = F.ceil(F.col("n") / large)
    known = of(texts).join(of(sizes).drop("component"), "set").withColumn("part", F.pmod(F.xxhash64("node"), parts)).drop("set")
    known = materialise(known.select("component", "node", "text", "n", "least", "part"), "large-sets")
    leaders = known.where(F.col("node") == F.col("least")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    first = materialise(verified(known.unionByName(leaders).dropDuplicates(["component", "part", "node"]), ["component", "part"]), "large-first")
    edges = first.select(F.col("group").alias("a"), F.col("node").alias("b"))
    groups = components(edges)
    named = known.select(F.col("component").alias("whole"), "node").distinct().join(groups, "node", "left")
    named = materialise(named.select("whole", "node", F.coalesce("component", "node").alias("group")), "large-groups")
    greatest = named.groupBy("whole", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("whole").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
    apart = named.join(greatest, "whole").where(F.col("group") != F.col("main")).select(F.col("whole").alias("component"), "node")
    apart = materialise(apart, "large-apart")
    more = materialise(apart.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / large).alias("others")), "large-others")
    if not more.limit(1).count():
        return named.select("node", "group")
    rows = known.join(more, "component")
    tile = F.pmod(F.xxhash64("node"), F.col("others"))
    own = rows.join(apart.select("node"), "node", "left_semi").withColumn("tile", tile).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    all_ = rows.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    names = ["component", "tile", "part", "node", "text"]
    second = verified(own.select(*names).unionByName(all_.select(*names)).dropDuplicates(names[:-1]), names[:3])
    every = edges.unionByName(second.select(F.col("group").alias("a"), F.col("node").alias("b")))
    final = components(materialise(every, "large-links"))
    return named.select("node").join(final, "node", "left").select("node", F.coalesce("component", "node").alias("group"))


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, node, component_id) for each row of docs. component_id: the smallest doc_id that links of
    a similarity of LEAST or more reach, itself included; null only where all ids are null. Texts of
    equal shingles, and texts that are null or without words, are linked; a text of fewer than WIDTH words
    is one shingle. Repeated rows are rows of one class. Texts of any length are hashed in parts. Other
    columns aren't read; an empty table gives no rows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialise(own.select("doc_id", prints(F.col("text")).alias("k")).select("doc_id", "k.*"), "near-prints")
    classes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("print").alias("print")), "near-classes")
    found = components(materialise(candidates(classes), "near-stars"))
    wanted = materialise(classes.select("node", "first_id").join(found, "node"), "near-wanted")
    wanted_ids = wanted.where("first_id is not null").withColumnRenamed("first_id", "doc_id")
    few = wanted_ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = own.join(F.broadcast(wanted_ids) if few else wanted_ids, "doc_id").select("component", "node", "text")
    sizes = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    sizes = materialise(sizes.where(F.col("n") > large), "near-large")
    if sizes.limit(1).count():
        key = F.struct("component")
        big = sizes.select(key.alias("set"))
        apart = texts.withColumn("set", key)
        groups = verified(apart.join(big, "set", "left_anti").drop("set"), ["component"]).unionByName(_large(apart.join(big, "set", "left_semi").drop("set"), sizes, large))
    else:
        groups = verified(texts, ["component"])
    groups = materialise(groups, "near-groups")
    named = classes.select("node", "first_id").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    ids = named.groupBy("group").agg(F.min("first_id").alias("component_id")).select(F.struct("group").alias("of"), "component_id")
    named = named.withColumn("of", F.struct("group")).join(ids, "of").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is that of their component, with their columns as they are. doc_id is a
    key: rows that repeat one stay or go together."""
    key = free_name(docs, "_key")
    keep = annotate(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(F.struct(F.col("doc_id").alias("id")).alias(key)).distinct()
    return docs.withColumn(key, F.struct(F.col(doc_id).alias("id"))).join(keep, key, "left_semi").select(*docs.columns)
