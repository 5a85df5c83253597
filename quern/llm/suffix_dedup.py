"""Removal of passages that an earlier document has: a distributed difference-cover suffix array.

Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id goes.
Texts are cut into blocks of whole documents (a document over BLOCK bytes into pieces that overlap), and
what a block asks about its strings is sent to parts by value and answered to the block, five times:

1. Discarding. A suffix whose first bytes stand once in the corpus needs no sorting. Positions that are 1 or
   2 mod 3 in their document are the sample of a difference cover: any two positions have an offset of 0,
   1 or 2 at which both are sampled, so two equal strings of LENGTH bytes have equal sampled strings of
   LENGTH - 2. Hashes of these are counted, sorted and coded by differences; of those that come once, nothing
   more is asked.
2. Of the positions left, one at which all occurrences have the same byte before, and whose predecessor has
   the same byte after it everywhere, occurs just where its predecessor does: it is decided with it. The
   others, the heads, are sorted.
   Hashes only say what may be left out: equal hashes of different strings cost work, not results.
3. Triples of characters of 8 bytes at the sampled suffixes of heads, and 24 bytes on, are sorted and named.
4. The names of the two triples of a suffix are sorted and named: the recursion. Two names hold 48 bytes,
   which decide, so it ends here.
5. All heads are merged: two suffixes compare by the bytes before the offset at which both are sampled, the
   names there, and the bytes left of LENGTH. Adjacent ones with an equal prefix of LENGTH bytes are one group, and
   the smallest doc_id of a group is the answer.

A block asks for each of its different strings once, so a passage that all documents have is as many rows
of a part as there are blocks. Parts get about as many strings each, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.llm.common import materialise, parts, small_batches

LENGTH, SAMPLED, TRIPLE = 50, 48, 24
#: Bytes of a block, and strings of a part.
BLOCK, PART = 1 << 22, 1 << 22
#: A null doc_id is greater than any other.
NOBODY = (1 << 63) - 1
#: Bits of a name: its part's number, then its place there.
PLACE_BITS, NAME_BITS = 26, 48
#: Blocks and strings of each that the limits of parts are taken from. They only say how work is dealt.
SPLIT_BLOCKS, SPLIT_STRINGS = 1000, 64
#: Positions that are hashed at a time.
AT_ONCE = 1 << 14
#: What stands beside a string at the beginning or end of a document.
EDGE = 256
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]

ASK = "block long, part int, asked binary"


# Arrays as bytes


def _zip(array: np.ndarray) -> bytes:
    """An array's bytes, the first of each value together, then the second."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array.view("u1").reshape(len(array), -1).T).tobytes()) if len(array) else b""


def _unzip(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    flat, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1"), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1)


def _pack(rising: np.ndarray) -> bytes:
    return _zip(np.diff(rising.astype("u8"), prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, "u8"), dtype="u8")


def _pack_strings(rising: np.ndarray) -> bytes:
    """Sorted strings of one width; what they share with the one before becomes zeros."""
    raw = rising.view("u1").reshape(len(rising), -1)
    return _zip(np.vstack([raw[:1], raw[1:] ^ raw[:-1]]))


def _unpack_strings(data: bytes, width: int) -> np.ndarray:
    raw = _unzip(data, f"V{width}").view("u1").reshape(-1, width)
    return np.ascontiguousarray(np.bitwise_xor.accumulate(raw, axis=0)).view(f"S{width}").reshape(-1)


def _pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1"), count=n).view(bool)


# Blocks


BLOCKS = "block long, size long, text binary, ids binary, digests binary, bases binary, sizes binary, ends binary"


def _blocks(docs: DataFrame, size: int, session: SparkSession) -> DataFrame:
    """docs (doc_id, text): BLOCKS. Of each piece its document's id and digest, its place there, its bytes, and whether
    it is the document's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, pieces = TaskContext.get().partitionId() << 32, bytearray(), []

        def block() -> pa.RecordBatch:
            nonlocal number, held, pieces
            ids, digests, bases, sizes, ends = zip(*pieces)
            row = [number, len(held), zstandard.ZstdCompressor(level=3).compress(bytes(held)), _zip(np.array(ids, "i8")), b"".join(digests), _zip(np.array(bases, "i8")), _zip(np.array(sizes, "i8")), bytes(ends)]
            number, held, pieces = number + 1, bytearray(), []
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64()] * 2 + [pa.binary()] * 6)], ["block", "size", "text", "ids", "digests", "bases", "sizes", "ends"])

        for batch in (part for whole in batches for part in parts(whole, 64)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if len(t) < LENGTH:
                    continue  # holds no string
                digest, at = hashlib.sha256(t).digest(), 0
                while True:
                    piece = t[at : at + size]
                    if held and len(held) + len(piece) > size:
                        yield block()
                    held += piece
                    last = at + size >= len(t)
                    pieces.append((NOBODY if i is None else i, digest, at, len(piece), last))
                    if last:
                        break
                    at += size - LENGTH - 1
        if pieces:
            yield block()

    return materialise(docs.mapInArrow(run, BLOCKS), "suffix-blocks", session)


class Block:
    """A block's bytes and pieces."""

    def __init__(self, row: dict):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), "u1")
        self.ids, self.bases, self.sizes = (_unzip(row[c], "i8") for c in ("ids", "bases", "sizes"))
        self.digests, self.last = row["digests"], np.frombuffer(row["ends"], "u1").view(bool)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.n = len(self.data)

    def _within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for a, b in zip(low.tolist(), high.tolist()):
            out[a : max(a, b)] = True
        return out

    def phase(self) -> np.ndarray:
        """Each position's place in its document, mod 3."""
        out, turns = np.empty(self.n, "u1"), np.resize(np.arange(3, dtype="u1"), int(self.sizes.max()) + 2)
        for at, n, base in zip(self.begin.tolist(), self.sizes.tolist(), (self.bases % 3).tolist()):
            out[at : at + n] = turns[base : base + n]
        return out

    def sampled(self) -> np.ndarray:
        return self._within(self.begin, self.begin + self.sizes - SAMPLED + 1) & (self.phase() > 0)

    def own(self) -> np.ndarray:
        """Where a string of LENGTH bytes starts. In a piece that isn't a document's first, the first one
        belongs to the piece before; in one that isn't the last, a byte follows each."""
        return self._within(self.first(), self.begin + self.sizes - LENGTH + self.last)

    def first(self) -> np.ndarray:
        return self.begin + (self.bases > 0)

    def hashes(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the strings of SAMPLED and of LENGTH bytes from each position on; made in parts that a core's
        cache holds, and only in parts that have a position that is wanted."""
        data, short, long = np.concatenate([self.data, np.zeros(LENGTH + 8, "u1")]), np.empty(self.n, "u8"), np.empty(self.n, "u8")
        for at in range(0, self.n, AT_ONCE):
            n = min(AT_ONCE, self.n - at)
            if wanted is not None and not wanted[at : at + n].any():
                continue
            c = data[at : at + n + LENGTH + 7].astype("u8")
            for k in (1, 2, 4):  # characters of 8 bytes
                c = c[:-k] << np.uint64(8 * k) | c[k:]
            h = np.zeros(n, "u8")
            for k, place in enumerate((*range(0, SAMPLED, 8), LENGTH - 8)):
                if place == LENGTH - 8:
                    short[at : at + n] = _mixed(h)
                h ^= h >> np.uint64(29)
                h *= MIX[0]
                h += c[place : place + n] * MIX[k]
            long[at : at + n] = _mixed(h)
        return short, long

    def strings(self, at: np.ndarray, width: int) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, width)[at]).view(f"S{width}").reshape(-1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX[1]
    return (h ^ h >> np.uint64(29)) * MIX[2]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in parts(batch, 1):
            yield from part.to_pylist()


def _each(table: DataFrame, made: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """What `made` makes of each row, one row at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if found := made(row):
                yield pa.RecordBatch.from_pylist(found, kinds)

    return table.mapInArrow(run, schema)


# Questions and answers


def _exchange(asked: DataFrame, answer: Callable[[list[bytes], int], list[bytes]], name: str) -> DataFrame:
    """asked: ASK, at most one row a block and part. (block, answers), of the parts in order."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        return table.set_column(2, "asked", pa.array(answer(table["asked"].to_pylist(), part), pa.binary()))

    told = asked.groupBy("part").applyInArrow(run, ASK)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("part", "asked"))), lambda x: x["asked"]).alias("answers")
    return materialise(told.groupBy("block").agg(lists), name)


def _messages(block: int, cuts: np.ndarray, make: Callable[[slice], bytes]) -> list[dict]:
    """cuts: where each part but the first begins in what a block asks."""
    ends = np.r_[0, cuts]
    return [{"block": block, "part": k, "asked": make(slice(a, b))} for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]


def _power(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _hash_cuts(values: np.ndarray, bits: int, power: int) -> np.ndarray:
    return np.searchsorted(values, (np.arange(1, (1 << power) + 1, dtype="u8") << np.uint64(bits - power)) - np.uint64(1), "right")


def _same(sorted_: np.ndarray) -> np.ndarray:
    """For sorted values: where a new one begins."""
    return np.r_[True, sorted_[1:] != sorted_[:-1]] if len(sorted_) else np.zeros(0, bool)


def _unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[_same(values)]


def _sampled_keys(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of a block's sampled strings, and whether each comes twice there."""
    keys = np.sort(block.hashes()[0][block.sampled()] >> np.uint64(64 - bits))
    (new,) = np.nonzero(_same(keys))
    return keys[new], np.diff(np.r_[new, len(keys)]) > 1


def _repeated(asked: list[bytes], part: int) -> list[bytes]:
    values = [_unpack(a) for a in asked]
    every = np.sort(np.concatenate(values)) >> np.uint64(1)
    twice = every[1:][every[1:] == every[:-1]]
    marked = np.concatenate([v[(v & np.uint64(1)) > 0] >> np.uint64(1) for v in values])
    twice = _unique(np.concatenate([twice, marked]))
    return [_pack_bits(_is_in(v >> np.uint64(1), twice)) for v in values]


def _is_in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _answers(row: dict, cuts: np.ndarray, read: Callable[[bytes, int], np.ndarray]) -> np.ndarray:
    ends = np.r_[0, cuts]
    sizes = [int(b - a) for a, b in zip(ends[:-1], ends[1:]) if a < b]
    return np.concatenate([read(a, n) for a, n in zip(row["answers"] or [], sizes)] or [np.zeros(0, "u8")])


def _candidates(row: dict, bits: int, power: int) -> list[dict]:
    """The positions that have a sampled string within 2 bytes that comes twice."""
    block = Block(row)
    (at,) = np.nonzero(block.sampled())
    keys = block.hashes()[0][at] >> np.uint64(64 - bits)
    known = _unique(keys)
    twice = known[_answers(row, _hash_cuts(known, bits, power), _unpack_bits).astype(bool)]
    # most of those that aren't among them are told by a table of the first bits
    small = max(1, min(bits, _power(len(twice)) + 3))
    table = np.zeros(1 << small, bool)
    table[twice >> np.uint64(bits - small)] = True
    maybe = table[keys >> np.uint64(bits - small)]
    at, keys = at[maybe], keys[maybe]
    marked = np.zeros(block.n + 2, bool)
    marked[at[_is_in(keys, twice)]] = True
    marked = (marked[:-2] | marked[1:-1] | marked[2:]) & block.own()
    return [{"block": row["block"], "n": int(marked.sum()), "marked": _pack_bits(marked)}] if marked.any() else []


def _contexts(block: Block, at: np.ndarray, bits: int) -> np.ndarray:
    """Of the strings at `at`: hash, byte before, byte after. For the first string of a piece nothing stands
    before: it has to decide by itself, so all that are equal to it must."""
    wanted = np.zeros(block.n, bool)
    wanted[at] = True
    key = block.hashes(wanted)[1][at] >> np.uint64(64 - bits)
    piece = np.searchsorted(block.begin, at, "right") - 1
    left = np.where(at > block.first()[piece], block.data[at - 1], EDGE).astype("u8")
    end = at + LENGTH
    right = np.where(end < block.begin[piece] + block.sizes[piece], block.data[np.minimum(end, block.n - 1)], EDGE).astype("u8")
    return key << np.uint64(18) | left << np.uint64(9) | right


def _ask_contexts(row: dict, bits: int, power: int) -> list[dict]:
    block = Block(row)
    items = np.sort(_contexts(block, np.flatnonzero(_unpack_bits(row["marked"], block.n)), bits))
    (key,) = np.nonzero(_same(items >> np.uint64(18)))
    twice = np.repeat(np.diff(np.r_[key, len(items)]) > 1, np.diff(np.r_[key, len(items)]))
    new = _same(items)
    items, twice = items[new], twice[new]
    cuts = _hash_cuts(items >> np.uint64(18), bits, power)
    return _messages(row["block"], cuts, lambda s: _pack(items[s] << np.uint64(1) | twice[s]))


def _differing(asked: list[bytes], part: int) -> list[bytes]:
    """Of each item three bits: it comes twice; bytes before differ; bytes after differ."""
    values = [_unpack(a) for a in asked]
    every = np.sort(np.concatenate(values))
    (new,) = np.nonzero(_same(every >> np.uint64(19)))
    key, low = every[new] >> np.uint64(19), np.uint64(511)
    ends = np.r_[new[1:], len(every)]
    twice = (ends - new > 1) | (np.bitwise_or.reduceat(every & np.uint64(1), new) > 0)
    apart = [np.maximum.reduceat(x, new) != np.minimum.reduceat(x, new) for x in (every >> np.uint64(10) & low, every >> np.uint64(1) & low)]
    return [_pack_bits(np.stack([b[np.searchsorted(key, v >> np.uint64(19))] for b in (twice, *apart)]).ravel()) for v in values]


HEADS = "block long, stretches binary, ends binary, edges binary, docs binary, triples binary, n_triples long, of binary"


def _heads(row: dict, bits: int, power: int) -> list[dict]:
    """HEADS. stretches: where the answer may change among the candidates, and whether that is at a head (else
    what follows isn't repeated); ends: where stretches of candidates end. Of each head: the bytes at its
    edges and its phase, its document, and its places (`of`) among the sorted triples of the block."""
    block = Block(row)
    at = np.flatnonzero(_unpack_bits(row["marked"], block.n))
    contexts = _contexts(block, at, bits)
    items = _unique(contexts)
    told = _answers(row, _hash_cuts(items >> np.uint64(18), bits, power), lambda a, n: _unpack_bits(a, 3 * n).reshape(3, n).T.astype("u1") @ np.array([4, 2, 1], "u1"))
    told = told.astype("u1")[np.searchsorted(items, contexts)]
    twice, before, after = told & 4 > 0, told & 2 > 0, told & 1 > 0
    alone = np.r_[True, np.diff(at) > 1] | np.isin(at, block.first())  # no position before it
    head = twice & (alone | before | np.r_[False, after[:-1]])
    # where a stretch of positions that are decided alike begins: at heads, and, as not repeated, at the others
    begin = head | alone | ~twice
    places = at[head]
    stops = np.stack([at[begin], head[begin]], axis=1)
    last = np.r_[np.diff(at) > 1, True] | np.r_[alone[1:], True]
    ends = at[last] + 1  # where a stretch of candidates ends
    if not len(places):
        return []
    piece = np.searchsorted(block.begin, places, "right") - 1
    suffix = _suffixes(block.phase()[places], places)
    need = np.unique(np.concatenate([suffix.ravel(), suffix.ravel() + TRIPLE]))
    triples, of = np.unique(block.strings(need, TRIPLE), return_inverse=True)
    whole = np.searchsorted(need, np.stack([suffix, suffix + TRIPLE], axis=-1))  # (heads, 2 suffixes, 2 triples)
    edges = block.data[places[:, None] + np.array([0, 1, SAMPLED, SAMPLED + 1])]
    return [{
        "block": row["block"], "stretches": _pack(stops[:, 0] << 1 | stops[:, 1]), "ends": _pack(ends), "edges": _zip(np.ascontiguousarray(np.c_[edges, block.phase()[places]]).view("V5").reshape(-1)),
        "docs": _zip(block.ids[piece]), "triples": _pack_strings(triples), "n_triples": len(triples), "of": _zip(of[whole].astype("i4").reshape(-1)),
    }]


#: By place mod 3: the offsets of a head's two sampled suffixes.
OFFSETS = np.array([[1, 2], [0, 1], [0, 2]])


def _suffixes(phase: np.ndarray, places: np.ndarray) -> np.ndarray:
    return places[:, None] + OFFSETS[phase]


def _limits(strings: DataFrame, column: str, n: int, width: int) -> np.ndarray:
    """The strings at which parts begin, from a bounded number of blocks and of strings of each."""
    count = strings.count()
    wanted = max(1, -(-n // PART))
    some = strings if count <= SPLIT_BLOCKS else strings.where(F.pmod(F.xxhash64("block"), F.lit(-(-count // SPLIT_BLOCKS))) == 0)

    def pick(row: dict) -> list[dict]:
        own = _unpack_strings(row[column], width)
        return [{"string": own[i].ljust(width, b"\0")} for i in np.linspace(0, len(own) - 1, min(SPLIT_STRINGS, len(own))).astype(int)]

    found = sorted(r["string"] for r in _each(some.select("block", column), pick, "string binary").collect()) if wanted > 1 else []
    return np.array([found[len(found) * k // wanted] for k in range(1, wanted)], f"S{width}")


def _named(strings: DataFrame, column: str, n: int, width: int, name: str) -> DataFrame:
    """strings (block, column: packed sorted strings of one width): (block, answers), of each string its
    name: names are in the order of the strings, equal ones have one name over all blocks."""
    limits = _limits(strings, column, n, width)

    def ask(row: dict) -> list[dict]:
        own = _unpack_strings(row[column], width)
        return _messages(row["block"], np.r_[np.searchsorted(own, limits), len(own)], lambda s: _pack_strings(own[s]))

    def answer(asked: list[bytes], part: int) -> list[bytes]:
        values = [_unpack_strings(a, width) for a in asked]
        every = np.unique(np.concatenate(values))
        if len(every) >> PLACE_BITS or part >> NAME_BITS - PLACE_BITS:
            raise ValueError("names don't fit: raise PLACE_BITS")
        return [_pack(np.searchsorted(every, v) + (part << PLACE_BITS)) for v in values]

    return _exchange(_each(strings.select("block", column), ask, ASK), answer, name)


def _names(row: dict) -> np.ndarray:
    return np.concatenate([_unpack(a) for a in row["names"]])


def _pairs(row: dict) -> list[dict]:
    """The names of each suffix's two triples as strings of 16 bytes, the different ones sorted."""
    two = _names(row)[_unzip(row["of"], "i4")].astype(">u8").reshape(-1, 2)
    pairs, of = np.unique(two.view("S16").reshape(-1), return_inverse=True)
    return [{"block": row["block"], "pairs": _pack_strings(pairs), "n_pairs": len(pairs), "of": _zip(of.astype("i4"))}]


def _keys(row: dict) -> tuple[np.ndarray, ...]:
    """(phase, a, b, doc) of a block's heads. a: what heads of one phase, or of phases 1 and 2, compare by; b:
    phases 0 and 1, and of phase 2 what is compared with a of phase 0."""
    names = _names(row)[_unzip(row["of"], "i4")].reshape(-1, 2)
    edges = _unzip(row["edges"], "V5").view("u1").reshape(-1, 5)
    b0, b1, y, z = edges[:, :4].astype("u8").T
    phase, s = edges[:, 4], lambda n: np.uint64(n)
    at0 = names[:, 0] << s(16) | y << s(8) | z  # phases 1 and 2: the suffix itself
    at1 = b0 << s(56) | names[np.arange(len(names)), (phase == 1).astype(int)] << s(8) | z  # phases 0 and 1
    at2 = b0 << s(56) | b1 << s(48) | names[:, 1]  # phases 0 and 2
    return phase, np.where(phase == 0, at2, at0), np.where(phase == 2, at2, at1), _unzip(row["docs"], "i8")


def _other(mine: int, his: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The keys by which heads of phase `mine` compare with those of phase `his`."""
    if mine == his or 0 not in (mine, his):
        return a
    if mine == 0:
        return b if his == 1 else a
    return b


def merged(phase: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of heads in the suffix array, and where, in that order, a new prefix begins."""
    at = [np.flatnonzero(phase == p) for p in range(3)]
    at = [x[np.argsort(a[x], kind="stable")] for x in at]
    sampled = np.concatenate(at[1:])
    sampled = sampled[np.argsort(a[sampled], kind="stable")]
    place = sum(np.searchsorted(_other(p, 0, a, b)[at[p]], _other(0, p, a, b)[at[0]]) for p in (1, 2))
    order = np.empty(len(phase), "i8")
    own = place + np.arange(len(at[0]))
    order[own] = at[0]
    rest = np.ones(len(phase), bool)
    rest[own] = False
    order[rest] = sampled
    x, y = order[:-1], order[1:]
    zero = (phase[x] == 0).astype("u1") + (phase[y] == 0)
    other = np.maximum(phase[x], phase[y])  # where one of two is 0
    key = lambda i: np.where(zero != 1, a[i], np.where((phase[i] == 0) & (other == 2), a[i], b[i]))
    return order, np.r_[True, key(x) != key(y)] if len(order) else np.zeros(0, bool)


def _asked_heads(row: dict) -> tuple[np.ndarray, ...]:
    """A block's different heads in the order of the suffix array (phase, a, b, least doc), and of each head its place there."""
    phase, a, b, doc = _keys(row)
    order, new = merged(phase, a, b)
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], begin)
    place = np.empty(len(order), "i8")
    place[order] = np.cumsum(new) - 1
    one = order[begin]
    return phase[one], a[one], b[one], least, place


def _head_cuts(limits: tuple[np.ndarray, ...], phase: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where parts begin among sorted heads: each limit is compared with the heads of every phase."""
    if not len(limits[0]):
        return np.array([len(phase)])
    cuts = np.zeros(len(limits[0]), "i8")
    for his in range(3):
        at = phase == his
        for mine in range(3):
            of = limits[0] == mine
            cuts[of] += np.searchsorted(_other(his, mine, a, b)[at], _other(mine, his, limits[1], limits[2])[of])
    return np.r_[cuts, len(phase)]


def _head_limits(heads: DataFrame, n: int) -> tuple[np.ndarray, ...]:
    count, wanted = heads.count(), max(1, -(-n // PART))
    some = heads if count <= SPLIT_BLOCKS else heads.where(F.pmod(F.xxhash64("block"), F.lit(-(-count // SPLIT_BLOCKS))) == 0)

    def pick(row: dict) -> list[dict]:
        phase, a, b, _, _ = _asked_heads(row)
        return [{"phase": int(phase[i]), "a": int(a[i].view("i8")), "b": int(b[i].view("i8"))} for i in np.linspace(0, len(phase) - 1, min(SPLIT_STRINGS, len(phase))).astype(int)]

    found = _each(some, pick, "phase int, a long, b long").collect() if wanted > 1 else []
    phase, a, b = np.array([r["phase"] for r in found], "u1"), *(np.array([r[c] for r in found], "i8").view("u8") for c in "ab")
    order, _ = merged(phase, a, b)
    chosen = order[[len(order) * k // wanted for k in range(1, wanted)]] if len(order) else order
    return phase[chosen], a[chosen], b[chosen]


def _least(asked: list[bytes], part: int) -> list[bytes]:
    rows = np.concatenate([_unzip(x, "V25") for x in asked]).view("u1").reshape(-1, 25)
    a, b, doc = (np.ascontiguousarray(rows[:, k : k + 8]).view(t).reshape(-1) for k, t in ((0, "u8"), (8, "u8"), (16, "i8")))
    order, new = merged(rows[:, 24], a, b)
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    out = np.empty(len(rows), "i8")
    out[order] = least[np.cumsum(new) - 1]
    ends = np.cumsum([0, *(len(_unzip(x, "V25")) for x in asked)])
    return [_zip(out[i:j]) for i, j in zip(ends[:-1], ends[1:])]


SPANS = "doc_id long, digest string, spans array<struct<start: long, end: long>>"


def _spans(row: dict) -> list[dict]:
    """Of each piece that loses bytes: what goes, as places in its document."""
    *_, place = _asked_heads(row)
    least = np.concatenate([_unzip(x, "i8") for x in row["least"]])[place]
    covered = least < _unzip(row["docs"], "i8")
    coded = _unpack(row["stretches"]).astype("i8")
    at, is_head = coded >> 1, (coded & 1).astype(bool)
    gone = np.zeros(len(at), bool)
    gone[is_head] = covered
    ends = _unpack(row["ends"]).astype("i8")
    until = np.minimum(np.r_[at[1:], 1 << 40], ends[np.searchsorted(ends, at, "right")])
    ids, bases, sizes = (_unzip(row[c], "i8") for c in ("ids", "bases", "sizes"))
    begin = np.cumsum(sizes) - sizes
    start, end = at[gone], until[gone] + LENGTH - 1
    piece = np.searchsorted(begin, start, "right") - 1
    out = []
    for p, low, high in zip(*_joined(piece, start, end)):
        if not out or out[-1][0] != p:
            out.append((p, []))
        out[-1][1].append({"start": int(low - begin[p] + bases[p]), "end": int(high - begin[p] + bases[p])})
    digest = lambda p: row["digests"][32 * p : 32 * p + 32].hex()
    return [{"doc_id": None if ids[p] == NOBODY else int(ids[p]), "digest": digest(p), "spans": s} for p, s in out]


def _joined(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted spans, those that overlap or touch and are of one piece as one."""
    if not len(start):
        return of, start, end
    new = np.r_[True, (start[1:] > end[:-1]) | (of[1:] != of[:-1])]  # ends rise as starts do
    begin = np.flatnonzero(new)
    return of[begin], start[begin], end[np.r_[begin[1:], len(end)] - 1]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """(doc_id, digest, spans) for documents that lose bytes, by id and SHA-256 of the text: the maximal
    spans of bytes that are covered by strings of LENGTH bytes of documents with a smaller id. Ids are
    integers; a null one is greater than any other. Rows that repeat an id lose nothing to each other; rows
    that repeat id and text are one row here. A null text is empty. A text of any length is cut into pieces of
    `size` bytes. Other columns aren't read."""
    session = small_batches(docs.sparkSession, "8m")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks are small and take long
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = _blocks(rows, size, session)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    if not total:
        return docs.sparkSession.createDataFrame([], SPANS)
    bits = min(63, _power(total) + 6)
    power = _power(-(-total // PART))

    def ask(row: dict) -> list[dict]:
        keys, twice = _sampled_keys(Block(row), bits)
        return _messages(row["block"], _hash_cuts(keys, bits, power), lambda s: _pack(keys[s] << np.uint64(1) | twice[s]))

    told = _exchange(_each(blocks, ask, ASK), _repeated, "suffix-repeated")
    few = materialise(_each(blocks.join(told, "block"), lambda row: _candidates(row, bits, power), "block long, n long, marked binary"), "suffix-candidates")
    left = few.agg(F.sum("n")).first()[0] or 0
    if not left:
        return docs.sparkSession.createDataFrame([], SPANS)
    bits2, power2 = min(45, _power(left) + 6), _power(-(-left // PART))
    known = blocks.join(few, "block")
    told = _exchange(_each(known, lambda row: _ask_contexts(row, bits2, power2), ASK), _differing, "suffix-contexts")
    heads = materialise(_each(known.join(told, "block"), lambda row: _heads(row, bits2, power2), HEADS), "suffix-heads")
    n = heads.agg(F.sum("n_triples")).first()[0] or 0
    if not n:
        return docs.sparkSession.createDataFrame([], SPANS)
    names = _named(heads, "triples", n, TRIPLE, "suffix-names").withColumnRenamed("answers", "names")
    pairs = materialise(_each(heads.select("block", "of").join(names, "block"), _pairs, "block long, pairs binary, n_pairs long, of binary"), "suffix-pairs")
    n = pairs.agg(F.sum("n_pairs")).first()[0]
    names = _named(pairs, "pairs", n, 16, "suffix-ranks").withColumnRenamed("answers", "names")
    ready = heads.select("block", "stretches", "ends", "edges", "docs").join(pairs.select("block", "of"), "block").join(names, "block")
    ready = materialise(ready, "suffix-ready")
    limits = _head_limits(ready, n)

    def ask_heads(row: dict) -> list[dict]:
        phase, a, b, doc, _ = _asked_heads(row)
        every = np.ascontiguousarray(np.c_[a[:, None].view("u1"), b[:, None].view("u1"), doc[:, None].view("u1"), phase]).view("V25").reshape(-1)
        return _messages(row["block"], _head_cuts(limits, phase, a, b), lambda s: _zip(every[s]))

    told = _exchange(_each(ready, ask_heads, ASK), _least, "suffix-least").withColumnRenamed("answers", "least")
    last = ready.join(told, "block").join(blocks.select("block", "ids", "digests", "bases", "sizes"), "block")
    return materialise(_each(last, _spans, SPANS), "suffix-spans", docs.sparkSession)


def _cut(text: Column, spans: Column) -> Column:
    """struct<spans, kept> of the bytes of text: spans, sorted and some of one piece, as maximal ones. Null for null."""

    @F.arrow_udf("struct<spans: array<struct<start: long, end: long>>, kept: binary>")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, own in ((t, s) for at in range(0, len(texts), 64) for t, s in zip(texts.slice(at, 64).cast(pa.binary()).to_pylist(), found.slice(at, 64).to_pylist())):
            if not own:
                out.append(None)
                continue
            whole: list[dict] = []
            for s in own:
                if whole and s["start"] <= whole[-1]["end"]:
                    whole[-1]["end"] = max(s["end"], whole[-1]["end"])
                else:
                    whole.append(dict(s))
            edges = [0, *(x for s in whole for x in (s["start"], s["end"])), len(t)]
            out.append({"spans": whole, "kept": b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))})
        return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))

    return run(text, spans)


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs: the maximal spans of bytes that go, as of
    repeats(), which says what nulls, ties and repeated rows give, and the bytes that stay. A text that loses
    nothing has no spans; an empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = repeats(docs, doc_id, text, size).groupBy(F.struct("doc_id", "digest").alias("key"))
    found = found.agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    known = rows.withColumn("key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("digest"))).join(found, "key", "left")
    cut = _cut(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    told = known.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", cut.alias("cut"))
    return told.select("doc_id", "n_bytes", F.coalesce("cut.spans", none).alias("spans"), F.coalesce("cut.kept", F.col("text").cast("binary")).alias("kept"))
