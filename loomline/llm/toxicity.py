"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts (P) and
unlabelled texts (U). With the class prior pi its risk on negatives is read off
the unlabelled texts, E_u[l(-f)] - pi E_p[l(-f)], and kept from going below
zero: where a step would push it there, the step goes the other way.

Features are rates of words and of word beginnings (four to seven letters of a
longer word), lower-cased; the `n_features` that tell P from U best are kept.

Bounds, both parameters: at most `max_positive` confirmed and `max_unlabelled`
unlabelled texts are fitted, those of the smallest hash of their id, so the
choice does not depend on the input's size or order. Scores cover all texts.

Defined results: null or empty text scores as a text without features; a null
doc_id is never learned from and is not held out; repeated rows repeat; without
any confirmed text the score is the prior (0 if there are no labels); an empty
table gives an empty table. Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import keep_rows, materialise

WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (4, 5, 6, 7)
RATE_SCALE = 40.0
KNOWN_WORDS = 500_000


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def word_features(word: str) -> list[str]:
    return [word, *[word[:n] + "+" for n in BEGINNINGS if len(word) > n]]


def text_features(text: str | None) -> dict[str, float]:
    """Each feature's capped rate among the text's words."""
    words = WORDS((text or "").lower())
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for f in word_features(word):
            found[f] += n
    return {f: min(1.0, RATE_SCALE * n / len(words)) for f, n in found.items()}


class FeatureMap:
    """Texts to rows over a fixed list of features; words met before are looked up at once."""

    def __init__(self, features: list[str]) -> None:
        self.index = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(self.index[f] for f in word_features(word) if f in self.index)
        return found

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature indices and capped rates."""
        words = WORDS((text or "").lower())
        known = self.known
        hits: list[int] = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = self._of(w)
            if f:
                hits += f
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0)
        at, n = np.unique(np.array(hits), return_counts=True)
        return at, np.minimum(1.0, RATE_SCALE * n / len(words))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic classifier with least non-negative PU risk (Adam, all rows a step).

    The decay of weights falls with the number of confirmed texts.
    """
    decay = 0.1 / len(positive) if decay is None else decay
    x = [np.hstack([a.astype(float), np.ones((len(a), 1))]) for a in (positive, unlabelled)]
    w = np.zeros(x[0].shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = x[0] @ w, x[1] @ w
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = x[1].T @ sigmoid(zu) / len(zu) - prior * (x[0].T @ sigmoid(zp)) / len(zp)
        up = -prior * (x[0].T @ sigmoid(-zp)) / len(zp)
        g = up + down if negative_risk >= 0 else -down
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class Classifier:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias
        self.map: FeatureMap | None = None

    def __getstate__(self) -> dict:
        return {"features": self.features, "weights": self.weights, "bias": self.bias, "map": None}

    def score(self, text: str | None) -> float:
        if self.map is None:
            self.map = FeatureMap(self.features)
        at, rates = self.map.row(text)
        return float(sigmoid(np.array(self.bias + self.weights[at] @ rates)))


def _sample(docs: DataFrame, confirmed: DataFrame, learn: Column, max_positive: int, max_unlabelled: int) -> DataFrame:
    """kind (1 confirmed, 0 unlabelled) and text of the texts to fit, at most max_positive and max_unlabelled of them, however many rows an id has; equal texts of a kind once."""
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = by_hash(confirmed.select("doc_id").distinct(), max_positive).withColumn("kind", F.lit(1))
    ids = ids.unionByName(by_hash(docs.filter(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct(), max_unlabelled).withColumn("kind", F.lit(0)))
    # ids has at most max_positive + max_unlabelled rows
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("kind", "text").dropDuplicates()
    named = materialise(found.withColumn("name", F.xxhash64("text")))
    first = [named.filter(F.col("kind") == kind).select("kind", "name").distinct().orderBy("name").limit(n) for kind, n in ((1, max_positive), (0, max_unlabelled))]
    return materialise(named.join(F.broadcast(first[0].unionByName(first[1])), ["kind", "name"]).select("kind", "text"))


def _chosen(sample: DataFrame, n_features: int, least: int) -> list[str]:
    """The features whose share of texts differs most between the kinds, in standard errors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        sizes = [0, 0]
        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[kind].update(text_features(text).keys())
                sizes[kind] += 1
        names = ["", *(seen[1] | seen[0])]
        p, u = [[n] + [c[f] for f in names[1:]] for c, n in ((seen[1], sizes[1]), (seen[0], sizes[0]))]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(p, pa.int64()), pa.array(u, pa.int64())], names=["feature", "p", "u"])

    counts = sample.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = materialise(counts)
    total = counts.filter("feature = ''").first()
    if total is None or not total["p"] or not total["u"]:
        return []
    share = (F.col("p") + F.col("u")) / F.lit(total["p"] + total["u"])
    error = F.sqrt(share * (1 - share) * F.lit(1 / total["p"] + 1 / total["u"]) + F.lit(1e-9))
    score = (F.col("p") / total["p"] - F.col("u") / total["u"]) / error
    best = counts.filter((F.col("feature") != "") & (F.col("p") >= least)).orderBy(score.desc(), "feature").limit(n_features)
    return [r["feature"] for r in best.collect()]  # at most n_features rows


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_positive: int = 3000, max_unlabelled: int = 6000, n_features: int = 512, least: int = 3) -> Classifier:
    """A classifier from the rows that `learn` (a condition on doc_id) lets in."""
    known = labels.filter(learn & F.col("doc_id").isNotNull())
    counts = known.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count("toxic").alias("n")).first()
    if not counts["p"]:
        return Classifier([], np.zeros(0), -30.0)
    prior = min(0.99, max(1e-3, counts["p"] / counts["n"]))
    sample = _sample(docs, known.filter("toxic = 1"), learn, max_positive, max_unlabelled)
    features = _chosen(sample, n_features, least)
    if not features:
        return Classifier([], np.zeros(0), float(np.log(prior / (1 - prior))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = FeatureMap(features)
        for b in batches:
            made = [found.row(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["kind", "at", "rate"])

    # at most max_positive + max_unlabelled sparse rows reach the driver
    fitted = sample.mapInArrow(rows, "kind int, at array<long>, rate array<double>").collect()
    dense = {1: [], 0: []}
    for r in sorted(fitted, key=lambda r: (r["kind"], r["at"], r["rate"])):
        line = np.zeros(len(features), np.float32)
        line[r["at"]] = r["rate"]
        dense[r["kind"]].append(line)
    weights, bias = fit_nnpu(np.array(dense[1]), np.array(dense[0]), prior)
    return Classifier(features, weights, bias)


def score_texts(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # at most n_features weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.value.score(t) for t in part.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def keep_below(docs: DataFrame, classifier: Classifier, threshold: float) -> DataFrame:
    """The rows of docs, all columns, whose score lies under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    return keep_rows(docs, "text", lambda: lambda texts: [model.value.score(t) < threshold for t in texts])


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted; learns from rows outside fold 2 of 4."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    classifier = train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    scored = score_texts(docs, classifier)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
