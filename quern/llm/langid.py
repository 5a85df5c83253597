"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams within its lower-cased words and their edges, hashed into
BUCKETS. The mean of their embeddings goes through a linear softmax; both are trained by stochastic
gradient descent in numpy. Scores are calibrated on rows kept out of training: a temperature for the
probabilities, and a level below which a prediction is marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import each, hash_level, sampled

BUCKETS, DIM, GRAMS = 1 << 16, 16, (2, 3, 4)
#: Training takes at most so many labelled rows of a language and so many of all languages (but one of
#: each at least), and of a longer text so many characters, in parts from all over it.
ROWS_EACH, ROWS_OF_ALL, MOST_CHARS = 800, 40_000, 20_000
#: Characters of the sample, over all languages: with more of them, less of each text.
CHARS_OF_ALL = 64_000_000
#: At least so many passes over the sample, and so many steps.
EPOCHS, STEPS, RATE, CALIBRATION_SHARE, REJECTED_SHARE = 4, 8_000, 0.5, 0.25, 0.01
UNDETERMINED = "und"
#: Bytes hashed at a time.
AT_ONCE = 1 << 18
#: All ASCII but letters counts as the edge of a word.
EDGES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def subwords(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's subwords, repeats included, in blocks of places where they begin."""
    data = b" " + b" ".join(text.lower().encode().translate(EDGES).split()) + b" "
    for at in range(0, len(data), AT_ONCE):
        raw = np.frombuffer(data[at : at + AT_ONCE + max(GRAMS) - 1], "u1").astype("u4")
        inner = raw == 32
        out = []
        for n in GRAMS:
            size = min(AT_ONCE, len(raw) - n + 1)
            if size < 1:
                continue
            code = np.full(size, n, "u4")
            for i in range(n):
                code = code * np.uint32(0x01000193) ^ raw[i : i + size]
            keep = np.ones(size, bool)
            for i in range(1, n - 1):
                keep &= ~inner[i : i + size]
            out.append((code * np.uint32(0x9E3779B1) >> np.uint32(16))[keep])
        yield np.concatenate(out) if out else np.zeros(0, "u4")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """table: the embeddings times the softmax weights, by bucket and language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for ids in subwords(text):
            total += self.table[ids].sum(0, dtype="f8")
            n += len(ids)
        return total / max(n, 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = self.probabilities(self.logits(text))
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """rows: (language, text)."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0))
    rng = np.random.default_rng(seed)
    bags = [(languages.index(lang), *np.unique(np.concatenate(list(subwords(text))), return_counts=True)) for lang, text in rows]
    bags = [(y, ids, (n / n.sum()).astype("f4")[:, None]) for y, ids, n in bags if len(ids)]
    order = rng.permutation(len(bags))
    kept_out = order[: int(len(bags) * CALIBRATION_SHARE)]
    order = order[len(kept_out) :]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype("f4")
    weights, bias = np.zeros((DIM, len(languages)), "f4"), np.zeros(len(languages), "f4")
    epochs = max(EPOCHS, -(-STEPS // max(len(order), 1)))
    steps, step = epochs * len(order), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            y, ids, share = bags[i]
            rate = RATE * (1 - step / steps)
            mean = (vectors[ids] * share).sum(0)
            z = mean @ weights + bias
            wrong = np.exp(z - z.max())
            wrong /= wrong.sum()
            wrong[y] -= 1
            back = weights @ wrong
            weights -= rate * np.outer(mean, wrong)
            bias -= rate * wrong
            vectors[ids] -= rate * len(ids) ** 0.5 * share * back
            step += 1
    model = Model(languages, vectors @ weights, bias.astype("f8"))
    if len(kept_out):
        _calibrate(model, [bags[i] for i in kept_out])
    return model


def _calibrate(model: Model, bags: list[tuple]) -> None:
    logits = np.array([(model.table[ids] * share).sum(0) + model.bias for _, ids, share in bags])
    truth = np.array([y for y, _, _ in bags])
    rows = np.arange(len(truth))

    def loss(log_t: float) -> float:
        model.temperature = math.exp(log_t)
        return -float(np.log(model.probabilities(logits)[rows, truth] + 1e-12).mean())

    model.temperature = math.exp(min(np.linspace(-2, 2, 41), key=loss))
    p = model.probabilities(logits)
    right = p.argmax(1) == truth
    model.least = float(np.quantile(p[rows, truth][right], REJECTED_SHARE)) if right.any() else 0.0


def training_rows(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, str]]:
    """The bounded sample: of each language, the different rows (by id and text) with the smallest hashes
    among those where learn holds. The hashes that can be among them are chosen by the number of different
    rows, which is estimated over the whole table by partial aggregates, so that no task gets the rows
    of a language."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), text).alias("at"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()  # a row for each class
    if not sizes:
        return []
    each_ = max(1, min(ROWS_EACH, ROWS_OF_ALL // len(sizes)))

    wide = spark.createDataFrame([(r["lang"], hash_level(2 * (each_ + 8) / r["n"])) for r in sizes], "lang string, level long")
    hashes = rows.select("lang", "at").join(F.broadcast(wide), "lang").where("at <= level").select("lang", "at").distinct().collect()  # about twice the sample
    by: dict[str, list[int]] = {}
    for r in sorted(hashes):
        by.setdefault(r["lang"], []).append(r["at"])
    narrow = spark.createDataFrame([(k, v[:each_][-1]) for k, v in by.items()], "lang string, level long")
    most = min(MOST_CHARS, CHARS_OF_ALL // (each_ * len(sizes)))
    found = rows.join(F.broadcast(narrow), "lang").where("at <= level").select("lang", "at", sampled(F.col("text"), most).alias("text")).dropDuplicates(["lang", "at"])
    return sorted((r["lang"], r["text"]) for r in found.select("lang", "text").collect())


def predict(text: Column, model: Model) -> Column:
    """struct<lang, score, rejected> of whole texts. A text that is null or has no letter is "und" with
    score 0 and rejected."""

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [model.predict(t) for t in each(texts)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang", "score", "rejected"])

    return run(text)


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[Column, Model]:
    """The column of predict() after training on the rows of docs where learn holds and lang and text aren't
    null; the model goes along with it. Without such rows, as in an empty table, all is undetermined. Of
    rows that repeat id and text one is learned from; equal hashes stand together, so that ties don't
    depend on the layout; of very long texts sampled() parts are learned from, whole texts are judged.
    Other columns aren't read, whatever their names."""
    model = train(training_rows(docs, learn, text, lang, doc_id))
    return predict(F.col(text), model), model
