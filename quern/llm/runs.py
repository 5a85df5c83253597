"""Periodic runs of words within each text: repeated k-gram masking, then Main-Lorentz on what is left.

A run with smallest period q and at least max(LEAST_WORDS, LEAST_POWER * q) words is equal to itself
shifted by q over all but q of its words: 5 words for q = 1, 6 or more for greater q. So each of its words
lies in a k-gram, k = 5, that stands twice in the document. Words outside of all such k-grams can't join
runs: they are masked, and what survives falls into segments, within which the runs lie whole.

Segments are searched by divide and conquer: a run is found at the middle of the smallest block that holds
it, where for each period q the longest common extension of two places q apart, to the left and to the
right, gives its start and end. All middles of a level, of all segments of a batch of texts, are worked on
at once; extensions come from names of 2^j-grams, equal for equal n-grams, by halving steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from quern.llm.common import parts

LEAST_WORDS, LEAST_POWER = 6, 4
#: Words of a run that are equal to words a period later, at least: k of the masking.
OVERLAP = 5
#: Words of a batch of texts that are searched together (one text may have more), and pairs at a time.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 1 << 17, 1 << 20

RUNS = "array<struct<start: long, length: long, period: long>>"


def mutated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document (by the hash of its id), from one place on, made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _names(pairs: np.ndarray) -> np.ndarray:
    """Dense names from 1 for non-negative numbers, equal for equal ones."""
    order = np.argsort(pairs, kind="stable")
    there = pairs[order]
    out = np.empty(len(pairs), "i8")
    out[order] = np.cumsum(np.r_[1, there[1:] != there[:-1]]) if len(pairs) else 0
    return out


def surviving(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """ids: words as numbers from 1, those of different texts being different; ends: for each place the end
    of its text. Whether each word lies in an OVERLAP-gram that stands twice in its text."""
    n = len(ids)
    kept = np.zeros(n, bool)
    (at,) = np.nonzero(np.arange(n) + OVERLAP <= ends)
    # grams are narrowed word by word: a gram goes as soon as a shorter one is single
    names = ids[at]
    for width in range(1, OVERLAP + 1):
        if width > 1:
            names = _names(names * (n + 1) + ids[at + width - 1])
        twice = np.bincount(names, minlength=1)[names] > 1 if len(names) else np.zeros(0, bool)
        at, names = at[twice], names[twice]
    for k in range(OVERLAP):
        kept[at + k] = True
    return kept


class _Extensions(NamedTuple):
    """levels[j]: names of the 2^j-grams from each place on, equal for equal ones within segments."""

    levels: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, ends: np.ndarray) -> _Extensions:
        longest, place = int((ends - np.arange(len(ids))).max(initial=0)), np.arange(len(ids))
        levels, width = [ids.astype("i4")], 1
        while 2 * width <= longest:
            now, (fits,) = np.zeros(len(ids), "i4"), np.nonzero(place + 2 * width <= ends)
            now[fits] = _names(levels[-1][fits].astype("i8") * (len(ids) + 1) + levels[-1][fits + width])
            levels.append(now)
            width *= 2
        return cls(levels)

    def forward(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal, up to ends (a < b)."""
        done = np.zeros(len(a), "i8")
        for j in range(len(self.levels) - 1, -1, -1):
            names, x, y = self.levels[j], a + done, b + done
            fits = y + (1 << j) <= ends
            done[fits & (names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)])] += 1 << j
        return done

    def backward(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many words before a and before b are equal, down to starts (a < b)."""
        done = np.zeros(len(a), "i8")
        for j in range(len(self.levels) - 1, -1, -1):
            names, x, y = self.levels[j], a - done - (1 << j), b - done - (1 << j)
            fits = x >= starts
            done[fits & (names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)])] += 1 << j
        return done


def _middles(starts: np.ndarray, ends: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The middles of the blocks of 2 * half words in segments (starts, ends), and their segments, some at a time."""
    first, count = starts + half, np.maximum(0, -(-(ends - starts - half) // (2 * half)))
    some = max(1, PAIRS_AT_ONCE // max(1, half // 2))
    total = np.r_[0, np.cumsum(count)]
    for at in range(0, int(total[-1]), some):
        k = np.arange(at, min(at + some, int(total[-1])))
        segment = np.searchsorted(total, k, "right") - 1
        yield first[segment] + (k - total[segment]) * 2 * half, segment


def runs_of(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs (start, end, period) of segments (starts, ends) of ids, by start, then period."""
    none = np.zeros((0, 3), "i8")
    if not len(starts):
        return none
    until = np.zeros(len(ids), "i8")
    for s, e in zip(starts, ends):
        until[s:e] = e
    reach, found, half = _Extensions.of(ids, until), [none], 1
    while half < (ends - starts).max():
        most = 2 * half // LEAST_POWER  # a run within a block has no more words than it
        for middle, segment in _middles(starts, ends, half) if 2 * half >= LEAST_WORDS else ():
            for least in range(1, most + 1, 1 << 16):
                periods = np.arange(least, min(least + (1 << 16), most + 1))
                m, q, of = np.repeat(middle, len(periods)), np.tile(periods, len(middle)), np.repeat(segment, len(periods))
                low, high = starts[of], ends[of]
                for a in (m, m - q):  # the run has q words to the right of the middle, or to its left
                    (fits,) = np.nonzero((a >= low) & (a + q < high))
                    fits = fits[ids[a[fits]] == ids[a[fits] + q[fits]]]
                    x, p = a[fits], q[fits]
                    left, right = reach.backward(x, x + p, low[fits]), reach.forward(x, x + p, high[fits])
                    long = left + right + p >= np.maximum(LEAST_WORDS, LEAST_POWER * p)
                    found.append(np.stack([x - left, x + p + right, p], axis=1)[long])
        half *= 2
    every = np.unique(np.concatenate(found), axis=0)
    if not len(every):
        return none
    # of the periods of one stretch the smallest is its own, the others are its multiples
    every = every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)]]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def find(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text, as words: its runs (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], "i8")
    begin = np.r_[0, np.cumsum(sizes)]
    total = int(begin[-1])
    ids, known = np.empty(total, "i8"), 0
    for t, at in zip(texts, begin):
        own: dict[bytes, int] = {}
        ids[at : at + len(t)] = [own.setdefault(w, len(own)) for w in t]
        ids[at : at + len(t)] += known + 1
        known += len(own)
    ends = np.repeat(begin[1:], sizes)
    kept = surviving(ids, ends)
    (at,) = np.nonzero(kept)
    if not len(at):
        return [np.zeros((0, 3), "i8")] * len(texts)
    own_ids, text = _names(ids[at]), np.searchsorted(begin, at, "right") - 1
    (cut,) = np.nonzero((at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))
    starts, stops = np.r_[0, cut + 1], np.r_[cut + 1, len(at)]
    long = stops - starts >= LEAST_WORDS
    found = runs_of(own_ids, starts[long], stops[long])
    place = at[found[:, 0]] if len(found) else found[:, 0]
    of = np.searchsorted(begin, place, "right") - 1
    whole = np.stack([place - begin[of], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    return np.split(whole, np.searchsorted(of, np.arange(1, len(texts))))


def _batches(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > WORDS_AT_ONCE:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, "i8")
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, n in zip(words, np.cumsum(change).tolist()) if not n])


def periodic(text: Column, doc_id: Column | None = None) -> Column:
    """struct<words, runs by start then period, collapsed> of whole texts; collapsed is the words that are in
    no run after its first period. A null text, or one without words, has no runs and collapses to "".
    With a doc_id, the words of every tenth document are made periodic first; those of a null id stay. Each
    row counts by itself, so that ties and repeated rows need no rule. A text is held whole, and of what
    survives the masking a few numbers a word for each halving."""
    schema = pa.struct([("words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def made(texts: pa.Array, ids: pa.Array | None) -> pa.Array:
        def words() -> Iterator[list[bytes]]:
            for at in range(0, len(texts), 64):
                some = texts.slice(at, 64).cast(pa.binary()).to_pylist()
                known = ids.slice(at, 64).to_pylist() if ids is not None else [None] * len(some)
                for t, i in zip(some, known):
                    yield mutated((t or b"").split(), i)  # of bytes: just the white space of ASCII

        sizes, tables, left = [], [], []
        for group in _batches(words()):
            found = find(group)
            sizes += map(len, group)
            tables += found
            left += map(collapsed, group, found)
        every = np.concatenate([*tables, np.zeros((0, 3), "i8")])
        ends = np.cumsum([0, *map(len, tables)])
        runs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(left, pa.binary()).cast(pa.string())], fields=list(schema))

    @F.arrow_udf(f"struct<words: long, runs: {RUNS}, collapsed: string>")
    def run(texts: pa.Array, *ids: pa.Array) -> pa.Array:
        return made(texts, ids[0] if ids else None)

    return run(text) if doc_id is None else run(text, doc_id)


def longest(runs: Column) -> Column:
    """The run of greatest length; of ties, that of smallest start, then period. Null if there is none."""
    key = lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))
    first = F.array_min(F.transform(runs, key))
    return F.when(F.size(runs) > 0, F.struct(first["start"].alias("start"), (-first["less"]).alias("length"), first["period"].alias("period")))
