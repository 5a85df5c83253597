"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length in (C/(k+1), C/k] belongs to class k, whose bins take exactly k pieces. As documents
may be cut, a document gives whole sequences first, then pieces of the reciprocal lengths C/k, so that
a class's bins are all but full; what remains when a cut would save less than SLACK goes uncut to its
own class. Each worker fills the bins of its own rows, with no shuffle: one open bin for each class.
Bins that never fill are poured at the end into sequences of C, and the last of these is split into
powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.bpe import Chunks
from quern.llm.common import parts

#: Share of the capacity's k-th part that a piece of class k may leave empty.
SLACK = 0.02
#: Shorter pieces aren't cut.
LEAST = 16
#: Chunks that go to the tokenizer as one text.
JOINED = 1024

SCHEMA = "doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cuts(length: int, capacity: int, slack: float = SLACK, least: int = LEAST) -> list[tuple[int, int]]:
    """(class, length) of a document's pieces, in order."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        room = capacity // k
        if room - rest <= slack * room or rest < least:
            out.append((k, rest))
            break
        k += 1  # the largest reciprocal length that fits
        out.append((k, capacity // k))
        rest -= capacity // k
    return out


class Packer:
    """Fills bins from a stream of documents; rows are (doc_id, start, length, doc_tokens, sequence_id,
    offset, ids). It holds less than one bin for each class."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next, self.open = capacity, first_sequence, {}

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for k, length in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, length, len(ids), ids[start : start + length].tobytes()))
            start += length
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, length, tokens, ids in pieces:
            yield doc_id, start, length, tokens, self.next, offset, ids
            offset += length
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        """Pour the bins that stayed open, longest pieces first."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        rest = sum(piece[2] for piece in left)
        room, now = self._room(rest), []
        for doc_id, start, length, tokens, ids in left:
            while length:
                take = min(length, room)
                now.append((doc_id, start, take, tokens, ids[: 4 * take]))
                start, length, ids, room, rest = start + take, length - take, ids[4 * take :], room - take, rest - take
                if not room:
                    yield from self._close(now)
                    room, now = self._room(rest), []

    def _room(self, rest: int) -> int:
        return self.capacity if rest >= self.capacity else 1 << rest.bit_length() - 1 if rest else 0


class Ids:
    """A tokenizer file's ids for a text, then the closing id. A special token's string that stands in a text
    gives that token, as the library does by default, unless `plain`: then it is text like any other."""

    def __init__(self, path: str, closing: int, most: int, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.closing = np.array([closing], "<u4").tobytes()
        line = self._encode(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self.chunks = Chunks(self.whole, most)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts. Chunks that begin with their only space go many at a time, a line feed between them,
        which is a token by itself there; its id tells where each ends."""
        out: list[bytes] = [b""] * len(texts)
        some = [i for i, t in enumerate(texts) if self.line is not None and t[:1] == " " and t[1:2].strip() and t[-1].strip() and "\n" not in t and not any(s in t for s in self.special)]
        left = set(range(len(texts))).difference(some)
        for at in range(0, len(some), JOINED):
            group = some[at : at + JOINED]
            ids = np.array(self._encode(["\n".join([texts[i] for i in group])])[0], "<u4")
            ends = [*np.flatnonzero(ids == self.line).tolist(), len(ids)]
            if len(ends) != len(group):
                left.update(group)
                continue
            raw, begin = ids.tobytes(), 0
            for i, end in zip(group, ends):
                out[i] = raw[4 * begin : 4 * end]
                begin = end + 1
        rest = sorted(left)
        for i, ids in zip(rest, self._encode([texts[i] for i in rest])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids + self.closing, "<u4") for ids in self.chunks.encode(texts)]


@functools.lru_cache(maxsize=2)
def _loaded(path: str, closing: int, most: int, plain: bool) -> Ids:
    return Ids(path, closing, most, plain)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 1, doc_id: str = "doc_id", text: str | Column = "text", cached: int = 1_000_000, plain: bool = False) -> DataFrame:
    """One row for each piece: SCHEMA, ids as little-endian unsigned 32-bit numbers. Every token of
    every row lies in one piece; a null or empty text is the closing id alone; repeated rows and null
    ids are packed like others; other columns are not read. sequence_id is unique: its upper bits are
    the number of the partition. No shuffle; a task that is lost gives the same rows again. A text of any
    length is tokenised as a whole and cut. cached: chunks of texts whose ids a worker remembers. plain: the
    string of a special token in a text is split as text and never becomes the token, which training data
    from untrusted sources may want; else it does, as the tokenizer's library gives it.

    capacity must be a power of two for sequences that need no padding at the end of a partition."""
    kind = docs.schema[doc_id].dataType
    out = SCHEMA.format(kind=kind.simpleString())
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, ready, held = _loaded(tokenizer, closing, cached, plain), Packer(capacity, TaskContext.get().partitionId() << 33), [], 0
        schema = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for docs_ in (part for batch in batches for part in parts(batch)):
            schema = schema or pa.schema([pa.field("doc_id", docs_.schema.field(0).type), *((n, pa.int64()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])
            for key, tokens in zip(docs_.column(0).to_pylist(), ids([t or "" for t in docs_.column(1).to_pylist()])):
                for piece in packer.add(key, tokens):
                    ready.append(piece)
                    held += piece[2]
                    if held >= 1 << 20:
                        yield batch(ready)
                        ready, held = [], 0
        ready += packer.finish()
        if ready:
            yield batch(ready)

    return rows.mapInArrow(run, out)
