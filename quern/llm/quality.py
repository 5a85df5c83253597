"""Quality rules with compression bands.

The base rules count words, symbols, repeated lines and words in repeated 3-word windows. The method
compresses the whole text and each of its chunks of CHUNK bytes with zstandard: a ratio of raw to
compressed bytes above its band means repetitive text, below it incompressible text. The limits depend
on the length, as a short text compresses less. A text goes if it is out of band as a whole or if
chunks that hold over half of its bytes are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, functions as F

from quern.llm.common import each

LEVEL, CHUNK = 3, 4096
#: (bytes, least ratio, greatest ratio): the limits of a text of that size, linear in the logarithm of the
#: size between two entries. Texts under the first size aren't judged; beyond the last its limits hold.
#: The greatest from 256 bytes on is the mean of the documents with quality 1 of sf0.1 that pass the base
#: rules (3,237 rows; 1.51, 1.61, 1.87, 2.03, 2.16, 2.26, 2.35 at 2**8 to 2**14 bytes) and 4 standard
#: deviations (0.07 to 0.03); few have 2**15 or more bytes, so limits widen there. The least is far below
#: their least, for the sake of other scripts: from 3,072 bytes on above that of wrapped base64 (1.33).
BANDS = (
    (64, 0.7, 2.2), (256, 1.05, 1.8), (512, 1.1, 1.86), (1024, 1.15, 2.03), (2048, 1.3, 2.16), (3072, 1.4, 2.23), (4096, 1.5, 2.28),
    (8192, 1.5, 2.4), (16384, 1.5, 2.5), (32768, 1.5, 2.65), (65536, 1.5, 2.9), (1 << 20, 1.5, 4.0),
)
FEWEST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"

VERDICT = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, base_failed: boolean, kept: boolean, ratio: double, odd_chunk_bytes: long>"


def repeated_words(words: list[bytes]) -> int:
    """Words in a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "i8")
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # else three numbers fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def in_band(size: int, ratio: float, bands=BANDS) -> bool:
    if size < bands[0][0]:
        return True
    of, low, high = zip(*bands)
    at = math.log2(size)
    of = [math.log2(x) for x in of]
    return bool(np.interp(at, of, low) <= ratio <= np.interp(at, of, high))


def measure(text: str, zstd: zstandard.ZstdCompressor, bands=BANDS) -> tuple:
    """The fields of VERDICT."""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at just the white space of ASCII
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = repeated_words(words)
    failed = len(words) < FEWEST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
    ratio = len(raw) / len(zstd.compress(raw)) if raw else 1.0
    odd = 0
    if len(raw) > CHUNK:
        for at in range(0, len(raw), CHUNK):
            chunk = raw[at : at + CHUNK]
            odd += len(chunk) * (not in_band(len(chunk), len(chunk) / len(zstd.compress(chunk)), bands))
    passed = in_band(len(raw), ratio, bands) and 2 * odd <= len(raw)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, not failed and passed, ratio, odd


def verdict(text: Column, bands=BANDS) -> Column:
    """VERDICT of each whole text. A null or empty text is one without words, and fails like any under
    FEWEST_WORDS. Each row is judged by itself: repeated rows get equal verdicts, no other column is read,
    and an empty table gives no rows. A text is held as a whole, once as it is and once compressed."""
    names = [f.split(":")[0].strip() for f in VERDICT[7:-1].split(",")]

    @F.arrow_udf(VERDICT)
    def run(texts: pa.Array) -> pa.Array:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        rows = [measure(t or "", zstd, bands) for t in each(texts)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    return run(text)
