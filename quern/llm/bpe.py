"""Byte-level BPE over a file of ranks, encoded with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Each adjacent pair whose bytes are in the vocabulary waits in
the bucket of its merge rank; a two-level bitmap over the ranks finds the lowest bucket that holds
anything by find-first-set. Entries whose pair has changed since are stale and skipped. A pre-token of
n bytes costs O(n log n), however long it is. Many short ones go through the queue at once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from quern.llm.common import parts

#: Bits of one word of the bitmap; its words have a bitmap of their own.
FANOUT = 256


class RankQueue:
    """Positions by merge rank. Bit r of the leaves says that bucket r holds something, bit w of the top
    that leaf w isn't zero; the lowest rank is found by find-first-set in the top, then in one leaf."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * (ranks // FANOUT + 1)
        self.top = 0

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word = rank // FANOUT
        self.leaves[word] |= 1 << rank % FANOUT
        self.top |= 1 << word

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [at])
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right, while top isn't zero."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.leaves[word]
        rank = word * FANOUT + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.leaves[word] = bits
        if not bits:
            self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Bpe:
    """ranks: id by the bytes of a token. pattern: what splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, most: int = 450_000):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.bytes = [ranks.get(bytes((a,)), -1) for a in range(256)]
        self.pairs = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])
        self.tokens = {i: token for token, i in ranks.items()}
        self.pieces = Generations(most // 2)
        self.chunks = Chunks(self.whole, most)

    @classmethod
    def from_file(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> Bpe:
        """path: lines of a token's base64 and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. They share one linked list, in which no pair reaches over the end of
        a pre-token, and one queue: the lowest rank goes first in each of them, whatever the others do."""
        ranks, queue, data = self.ranks, self.queue, b"".join(pieces)
        n, rank_of, buckets, ids = len(data), ranks.get, queue.buckets, list(map(self.bytes.__getitem__, data))
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        code = np.frombuffer(data, "u1").astype("i8")
        first = self.pairs[code << 8 | np.r_[code[1:], 0]]  # the rank at which the part at i merges with the next
        starts = np.cumsum([0, *map(len, pieces)])
        first[starts[1:] - 1] = -1
        edge = bytearray(n + 1)  # where pre-tokens begin
        np.frombuffer(edge, "u1")[starts] = 1
        (some,) = np.nonzero(first >= 0)
        some = some[np.argsort(first[some], kind="stable")]
        of, cuts = np.unique(first[some], return_index=True)
        some = some.tolist()
        for rank, i, j in zip(of.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(some)]):
            queue.open(rank, some[i:j])
        waits = first.tolist()
        while queue.top:
            now, positions = queue.pop()
            for k, i in enumerate(positions):
                if waits[i] != now:
                    continue  # stale: this pair has gone
                j = end[i]
                waits[j] = -1
                end[i] = after = end[j]
                ids[i] = now
                lower = False
                if edge[after]:
                    waits[i] = -1
                else:
                    back[after] = i
                    waits[i] = rank = rank_of(data[i : end[after]], -1)
                    if rank >= 0:
                        lower = rank < now
                        bucket = buckets.get(rank)
                        if bucket is None:
                            queue.open(rank, [i])
                        else:
                            bucket.append(i)
                if not edge[i]:
                    j = back[i]
                    waits[j] = rank = rank_of(data[j:after], -1)
                    if rank >= 0:
                        lower = lower or rank < now
                        bucket = buckets.get(rank)
                        if bucket is None:
                            queue.open(rank, [j])
                        else:
                            bucket.append(j)
                if lower and k + 1 < len(positions):  # the new pair goes before the rest of this bucket
                    queue.open(now, positions[k + 1 :])
                    break
        out, i = [], 0
        for piece in pieces:
            own, until = [], i + len(piece)
            while i < until:
                own.append(ids[i])
                i = end[i]
            out.append(own)
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, pre-token by pre-token, as little-endian unsigned 32-bit numbers."""
        split = [self.split.findall(t) for t in texts]
        known, new = self.pieces.young, self.pieces.lacking({p for pieces in split for p in pieces})
        raw = {p: p.encode() for p in new}
        known.update({p: self.ranks[b].to_bytes(4, "little") for p, b in raw.items() if b in self.ranks})
        raw = {p: b for p, b in raw.items() if p not in known}
        for piece, ids in zip(raw, self.merge(list(raw.values())) if raw else ()):
            known[piece] = np.array(ids, "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        self.pieces.settle(new)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return self.chunks.encode(texts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Generations:
    """What was encoded lately, by short text: entries that weren't asked for since the last turnover go.
    It holds little more than twice `most` texts of at most `longest` characters."""

    def __init__(self, most: int, longest: int = 48):
        self.most, self.longest = most, longest
        self.young, self.old = {}, {}

    def lacking(self, keys: set[str]) -> list[str]:
        """Those that aren't held; the others are in young from now until settle()."""
        young, old = self.young, self.old
        left = [k for k in keys if k not in young]
        young.update({k: old[k] for k in filter(old.__contains__, left)})
        return [k for k in left if k not in old]

    def settle(self, new: list[str]) -> None:
        """new: what was put into young."""
        for k in new:
            if len(k) > self.longest:
                del self.young[k]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Chunks:
    """Encodes batches of texts from the ids of their chunks. The pattern never joins what comes before a
    lone space or line feed with what follows it, so a chunk between two of them encodes by itself: after
    a space (which belongs to it) or, marked by a leading line feed, after a line feed. A text with other
    white space at a chunk's edge is encoded as a whole. whole: ids of each of a list of texts."""

    def __init__(self, whole: Callable[[list[str]], list[bytes]], most: int = 500_000):
        self.whole, self.held = whole, Generations(most)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        wanted = set()
        for parts in split:
            wanted.update(parts[1:])
        known, new = self.held.young, self.held.lacking(wanted)
        apart = [c for c in new if self.apart(c)]
        known.update(dict.fromkeys(new))  # None: its surroundings matter
        known.update(zip(apart, self.whole([c if c[0] == "\n" else f" {c}" for c in apart])))
        out, odd = [], []
        firsts = iter(self.whole([parts[0] for parts in split]))
        for i, parts in enumerate(split):
            first, ids = next(firsts), list(map(known.__getitem__, parts[1:]))
            if not ids or None in ids or parts[0][-1:].isspace():
                odd.append(i)
                out.append(b"")
            else:
                out.append(first + b"".join(ids))
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        self.held.settle(new)
        return out

    @staticmethod
    def apart(chunk: str) -> bool:
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        return bool(body) and not body[0].isspace() and not body[-1].isspace()


@functools.lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> Bpe:
    """One for each Python worker."""
    return Bpe.from_file(path, pattern)


def encode(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """array<int>: the ids of a text by the ranks in the file at path, which every executor has. A
    null or empty text has no ids. Works row by row, so ties and repeated rows are of no account."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path, pattern)
        for texts in (part for batch in batches for part in parts(batch)):
            ids = bpe.encode_batch([t or "" for t in texts.to_pylist()])
            ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype="i4")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return run(text)


def decode(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """binary: the bytes that ids stand for; null ids give none."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(path, pattern)
        for lists in (part for batch in batches for part in parts(batch)):
            lists = lists.fill_null([]) if lists.null_count else lists
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()
            yield pa.array([bpe.decode(ids[i:j].tolist()) for i, j in zip(at[:-1], at[1:])], pa.binary())

    return run(ids)
