"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons (one for each language and kind of insult), patterns, and
lexicon entries mined from a bounded sample of labelled rows (whole words and word beginnings). Mined
entries vote only on rows of a part of the sample, and come from the labels of all other parts. The given
label of a row is one more voter, which may err.

A generative label model is fitted by expectation maximisation: for each voter and class its rate of
firing, for the labels their accuracy in each class, and the share of the classes. A voter that doesn't
fire abstains, as a text of one language or kind of insult can't fire those of others; that all are silent
is a vote of its own, with its rate in each class. Correlations between
voters, given the class, are estimated from what the model leaves over, and a voter counts the less the
more others repeat it. So voters that agree can overrule a label, and decide where there is none. A linear
classifier over hashed words and word beginnings is trained on the posterior labels, so that it also
scores texts on which no voter fires.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import WordCache, each, hash_level, sampled

BUCKETS, STARTS = 1 << 31, (4, 5)
#: The bounds of the training sample: rows of label 1, of label 0, without a label; characters of each.
TOXIC_ROWS, CLEAN_ROWS, OPEN_ROWS, MOST_CHARS = 1500, 3000, 1000, 20_000
MINED, LEAST_RATIO = 120, 15.0
#: Expectation maximisation: log odds up to which all voters together count as silent, rounds, the correlation from which voters repeat each other, what a label's
#: accuracy starts from and how many rows that start counts; parts of the sample for mining.
QUIET, ROUNDS, CORRELATED, FIRST_ACCURACY, FIRST_ROWS, FOLDS = 1.0, 25, 0.3, 0.75, 10, 4
EPOCHS, RATE, DECAY, CALIBRATION_SHARE = 12, 0.5, 1e-4, 0.25

#: Common insults by language and kind, one voter for each.
LEXICONS = {
    "en wit": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools imbecile brainless dimwit halfwit",
    "en worth": "worthless pathetic loser losers useless failure nobody coward lowlife",
    "en filth": "trash scum filth filthy garbage vermin disgusting vile sickening repulsive",
    "en name": "clown clowns jerk jerks creep freak bastard bitch pig swine rat",
    "de wit": "idiot idioten dumm dummkopf blöd blödmann trottel depp schwachkopf hirnlos",
    "de worth": "versager wertlos nutzlos jämmerlich erbärmlich feigling nichtsnutz",
    "de filth": "abschaum ekelhaft widerlich dreck müll ungeziefer",
    "de name": "arschloch mistkerl schwein clown hurensohn",
    "fr wit": "idiot idiote imbécile stupide crétin débile abruti bête",
    "fr worth": "nul nulle minable inutile pathétique raté lâche",
    "fr filth": "ordure dégoûtant répugnant déchet vermine racaille",
    "fr name": "salaud salope connard clown porc bouffon",
    "es wit": "idiota imbécil estúpido estúpida tonto tonta bobo",
    "es worth": "inútil patético patética perdedor cobarde fracasado",
    "es filth": "basura escoria asqueroso asquerosa repugnante alimaña",
    "es name": "cabrón payaso cerdo bastardo",
}
LEXICONS = {kind: x.split() for kind, x in LEXICONS.items()}
#: Patterns, one voter for each.
PATTERNS = {
    "addressed": r"(?i)\b(you|your|du|ihr|tu|vous|tú)\W+(are|re|bist|seid|es|êtes|eres)\W+(such\W+)?(an?|ein|une?|una?)\b",
    "wish": r"(?i)\b(shut up|get lost|go away|drop dead|hate you|halt die klappe|ta gueule|cállate)\b",
    "masked": r"\b\w\*{2,}\w*",
    "wished ill": r"(?i)\b(i hope you|you should|you deserve to|nobody (likes|wants)) (die|rot|suffer|fail|you)\b",
    "all of them": r"(?i)\b(they|you|those people|these people) (all )?(are|re) (all )?(animals|vermin|parasites|criminals|subhuman)\b",
    "shouted": r"\b[A-Z]{3,}(\W+[A-Z]{3,}){4,}\s*!",
    "exclaimed": r"!{3,}",
}
WORDS = re.compile(r"[^\W\d_]+")
VOTES = [re.compile(p) for p in PATTERNS.values()]


def features(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its beginnings."""
    return tuple(zlib.crc32(f.encode()) % BUCKETS for f in (f"={word}", *(f"{word[:n]}-" for n in STARTS if len(word) >= n)))


def words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


@dataclass
class Model:
    """weights: by feature, of those that have any."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.cache = WordCache(lambda word: sum(self.weights.get(f, 0.0) for f in features(word)))

    def __getstate__(self):
        return self.weights, self.bias, self.slope, self.shift

    def __setstate__(self, state):
        self.weights, self.bias, self.slope, self.shift = state
        self.__post_init__()

    def margin(self, text: str | None) -> float:
        return self.bias + math.fsum(map(self.cache.__getitem__, words(text)))

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(text) + self.shift
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def telling(ids: list[np.ndarray], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that rows of high share (of being toxic) have more often than others, by more than
    chance: a likelihood ratio of LEAST_RATIO; with their ratios."""
    some = [np.unique(x) for x in ids]
    found, at = np.unique(np.concatenate([*some, np.zeros(0, "i8")]), return_inverse=True)
    toxic = np.bincount(at, np.repeat(share, list(map(len, some))), len(found))
    both = np.bincount(at, minlength=len(found)).astype("f8")
    rows, all_toxic = len(ids), share.sum()

    def part(a, n, k):  # a of the k of that kind, where n rows have the feature
        return a * np.log(np.maximum(a, 1e-9) * rows / np.maximum(n * k, 1e-9))

    clean, all_clean = both - toxic, rows - all_toxic
    ratio = 2 * (part(toxic, both, all_toxic) + part(clean, both, all_clean) + part(all_toxic - toxic, rows - both, all_toxic) + part(all_clean - clean, rows - both, all_clean))
    good = (toxic * rows > 2 * both * all_toxic) & (ratio >= LEAST_RATIO)
    return found[good], ratio[good]


def mine(ids: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The most telling features of the labelled rows."""
    told = np.flatnonzero(labels >= 0)
    found, ratio = telling([ids[i] for i in told], labels[told].astype("f8"))
    return found[np.lexsort((found, -ratio))][:MINED]


def votes(texts: list[str | None], bags: list[set[str]], ids: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 where a voter fires, else 0, and 1 where it votes at all; the columns are lexicons, patterns, what
    is mined for each part from the rows of the others. Mined voters abstain on the rows they come from."""
    lexicons = [set(x) for x in LEXICONS.values()]
    fixed = np.array([[bool(bag & x) for x in lexicons] + [bool(p.search(text or "")) for p in VOTES] for text, bag in zip(texts, bags)], "f4")
    fires, present = [fixed], [np.ones_like(fixed)]
    for k in range(FOLDS):
        mined = mine(ids, np.where(fold == k, -1, labels))
        fires.append(np.array([np.isin(mined, x) if k == of else np.zeros(len(mined), bool) for x, of in zip(ids, fold)], "f4").reshape(len(ids), -1))
        present.append(np.repeat((fold == k).astype("f4")[:, None], len(mined), 1))
    return np.hstack(fires), np.hstack(present)


@dataclass
class LabelModel:
    """posterior: of label 1, by row; accuracy: of the given labels among rows of class 1 and of class 0;
    rates: of firing of each voter in class 1 and class 0; weight: what correlations leave of a voter."""

    posterior: np.ndarray
    accuracy: tuple[float, float]
    rates: tuple[np.ndarray, np.ndarray]
    weight: np.ndarray


def label_model(v: np.ndarray, labels: np.ndarray, prior: float, present: np.ndarray | None = None) -> LabelModel:
    """v: votes; labels: 1, 0, or -1 for none; prior: the share of class 1 to start from; present: where a
    voter votes (everywhere, if not given). It starts from labels of FIRST_ACCURACY; without any, from the
    number of voters that fire."""
    v = np.asarray(v, "f4")
    seen = np.ones_like(v) if present is None else np.asarray(present, "f4")
    told, ones, zeros = labels >= 0, labels == 1, labels == 0
    right = np.array([FIRST_ACCURACY, FIRST_ACCURACY])
    taught = ones.any() and zeros.any()
    fired = np.where(v.sum(1) >= 2, 0.8, np.where(v.sum(1) == 1, 0.5, prior / 2))
    q = np.where(ones, FIRST_ACCURACY, np.where(zeros, 1 - FIRST_ACCURACY, fired))
    for i in range(ROUNDS):
        share = (q.sum() + prior * FIRST_ROWS) / (len(q) + FIRST_ROWS) if i else prior
        if i:
            right = np.array([(w[hit].sum() + FIRST_ACCURACY * FIRST_ROWS) / (w[told].sum() + FIRST_ROWS) for w, hit in ((q, ones), (1 - q, zeros))])
        of = told if taught and not i else 1.0  # the first rates are those of labelled rows
        rate1, rate0 = (((w * of) @ v + 0.1) / ((w * of) @ seen + 1) for w in (q, 1 - q))  # of firing: the voters' accuracies
        rest = q.astype("f4")[:, None] * (rate1 - rate0).astype("f4")  # in place: the matrix is large
        rest += rate0.astype("f4")
        np.subtract(v, rest, out=rest)
        rest *= seen
        scale = np.sqrt(np.einsum("ij,ij->j", rest, rest, dtype="f8")) + 1e-9
        correlation = np.abs(rest.T @ rest / np.outer(scale, scale))
        np.fill_diagonal(correlation, 1)
        weight = (rate1 > rate0) / (correlation * (correlation > CORRELATED)).sum(0)  # what fires speaks for class 1 or not at all
        z = v @ (weight * np.log(rate1 / rate0))
        silent = z < QUIET
        z += silent * math.log((q @ silent + 1) / (q.sum() + 2) / ((1 - q) @ silent + 1) * ((1 - q).sum() + 2))
        z += np.where(ones, math.log(right[0] / (1 - right[1])), np.where(zeros, math.log((1 - right[0]) / right[1]), 0))
        z += math.log(share / (1 - share))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return LabelModel(q, (float(right[0]), float(right[1])), (rate1, rate0), weight)


def train(rows: list[tuple[str | None, int | None]], prior: float, seed: int = 1) -> Model:
    """rows: (text, label or None); prior: the share of label 1 among labelled rows."""
    if not rows:
        rows, prior = [(word, 1) for x in LEXICONS.values() for word in x] + [("", 0)] * 100, 0.1
    prior = min(max(prior, 0.001), 0.999)
    rng = np.random.default_rng(seed)
    texts = [t for t, _ in rows]
    labels = np.array([-1 if y is None else int(y == 1) for _, y in rows])
    bags, of = [words(t) for t in texts], WordCache(features)
    ids = [np.array([f for w in sorted(bag) for f in of[w]], "i8") for bag in bags]
    kept_out = (rng.random(len(rows)) < CALIBRATION_SHARE) & (labels >= 0) & (len(rows) > 100)
    known = np.where(kept_out, -1, labels)
    fires, present = votes(texts, bags, ids, known, rng.integers(0, FOLDS, len(rows)))
    share = float(np.clip((known == 1).sum() / max((known >= 0).sum(), 1), 0.001, 0.999))
    target = label_model(fires, known, share, present).posterior
    useful, _ = telling(ids, target)
    fixed = {f for x in LEXICONS.values() for word in x for f in of[word][:1]}
    useful = np.union1d(useful, np.array(sorted(fixed), "i8"))
    ids = [np.searchsorted(useful, x[np.isin(x, useful)]) for x in ids]
    w, b = np.zeros(len(useful)), math.log(prior / (1 - prior))
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate, x = RATE * (1 - step / steps), ids[i]
            wrong = 1 / (1 + math.exp(-min(max(b + w[x].sum(), -30.0), 30.0))) - target[i]
            if len(x):
                np.subtract.at(w, x, rate * (wrong / len(x) ** 0.5 + DECAY * w[x]))
            b -= 0.1 * rate * wrong
            step += 1
    model = Model({int(f): float(x) for f, x in zip(useful, w) if x}, b)
    if kept_out.sum() >= 20 and len(set(labels[kept_out])) == 2:
        _calibrate(model, [t for t, k in zip(texts, kept_out) if k], labels[kept_out], prior)
    return model


def _calibrate(model: Model, texts: list[str | None], truth: np.ndarray, prior: float) -> None:
    """Slope and shift by Newton's steps, on rows reweighted to the prior, with smoothed targets."""
    z = np.array([model.margin(t) for t in texts])
    n1 = truth.sum()
    target = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (len(truth) - n1 + 2))
    weight = np.where(truth == 1, prior / n1, (1 - prior) / (len(truth) - n1)) * len(truth)
    x, at = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-2 * (at - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, slope), -1, 1)
    if at[0] > 0:
        model.slope, model.shift = map(float, at)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> tuple[list[tuple[str | None, int | None]], float]:
    """The bounded sample and the share of label 1 among all labelled rows where learn holds. A doc_id that
    is labelled twice counts as toxic if any is. Of each part (label 1, label 0, none) the different rows,
    by id and text, with the smallest hashes; which hashes can be among them is told by the number of
    different rows, estimated over the whole table by partial aggregates."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull()).groupBy(F.struct(F.col(doc_id).alias("id")).alias("of")).agg(F.max(F.col(label)).alias("y"))
    rows = docs.where(learn).select(F.struct(F.col(doc_id).alias("id")).alias("of"), F.xxhash64(F.col(doc_id).cast("string"), text).alias("at"), sampled(F.col(text), MOST_CHARS).alias("text"))
    part = F.when(F.col("y").isNull() | F.col("of.id").isNull(), -1).when(F.col("y") == 1, 1).otherwise(0)
    ids = rows.select("of", "at").join(known, "of", "left").select("at", part.alias("part"))
    most = {1: TOXIC_ROWS, 0: CLEAN_ROWS, -1: OPEN_ROWS}
    sizes = ids.groupBy("part").agg(F.approx_count_distinct("at").alias("n")).collect()
    level = F.lit(None).cast("long")
    for r in sizes:
        level = F.when(F.col("part") == r["part"], hash_level(2 * (most[r["part"]] + 8) / r["n"])).otherwise(level)
    by: dict[int, set[int]] = {1: set(), 0: set(), -1: set()}
    for r in ids.where(F.col("at") <= level).distinct().collect():  # about twice the sample
        by[r["part"]].add(r["at"])
    chosen = [(at, y) for y, found in by.items() for at in sorted(found)[: most[y]]]
    sample = spark.createDataFrame(chosen, "at long, y int")
    found = rows.join(F.broadcast(sample), "at").dropDuplicates(["at", "y"]).select("at", "text", "y").collect()
    share = labels.where(learn & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return [(r["text"], None if r["y"] < 0 else r["y"]) for r in sorted(found)], share if share is not None else 0.1


def score(text: Column, model: Model) -> Column:
    """double from 0 to 1 of whole texts; a null or empty text has the score of one without words."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in each(texts)], pa.float64())

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """learn: a condition on doc_id, for docs and labels alike. Without labelled rows, as in empty tables,
    the lexicons alone are learned. Null and empty texts are texts without words. Of rows that repeat id
    and text one is learned from; ties of hashes don't depend on the layout; of very long texts sampled()
    parts are learned from, whole texts are scored. Rows without an id have no label. Other columns
    aren't read, whatever their names."""
    rows, prior = training_rows(docs, labels, learn, text, doc_id, label)
    return train(rows if any(y is not None for _, y in rows) else [], prior)
