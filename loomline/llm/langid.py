"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased and each run of anything but letters becomes one space. For
every language the n-grams up to four characters give an interpolated
Kneser-Ney model. All languages share one sorted array of n-gram hashes per
order, with a row of log-probabilities per n-gram and a row of back-off weights
per context, so one binary search serves all languages. The prediction is the
language of the lowest cross-entropy per character. A text is rejected if even
that one lies above the language's limit: the calibration texts' mean, plus
their spread for long texts, plus a share that falls with the root of the length.

Bound, a parameter: at most `per_language` texts a language are fitted, those
of the smallest hash of their id; one in five of them only calibrates. Scores
cover all texts whole.

Defined results: null text and text without a letter are `und`, score 0 and
rejected; rows of null language are not learned from; without any learned
language all texts are `und`; equal cross-entropies go to the language that
sorts first; repeated rows repeat; an empty table gives an empty table. Extra
columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import bounded, keep_rows, materialise

ORDER = 4
NOT_LETTERS = re.compile(r"[\W\d_]+")
BATCH_CHARS = 500_000
PAD = " " * (ORDER - 1)
#: Calibration texts that a limit needs.
ENOUGH = 20


def letters_only(text: str | None) -> str:
    """Lower-cased words between single spaces; empty if there is no letter."""
    found = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return found if any(map(str.isalpha, found)) else ""


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given by their characters' columns."""
    h = np.full(columns[0].shape, 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each hash's place in a sorted array, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class KneserNey:
    """Sorted hash arrays and log values of all languages; limits calibrate rejection."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order, from 1
    log_p: list[np.ndarray] = field(default_factory=list)  # (n-grams, languages)
    context_keys: list[np.ndarray] = field(default_factory=list)  # by length of context, from 1
    log_backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # log-probability of an unknown character
    limits: np.ndarray | None = None  # (languages, 3): mean, spread, share by root of length

    @classmethod
    def fit(cls, grams: list[str], counts: np.ndarray, languages: list[str]) -> KneserNey:
        """counts: (n-grams of ORDER characters, languages)."""
        model = cls(languages)
        chars = code_points("".join(grams)).reshape(-1, ORDER)
        by_order = {ORDER: (chars, counts.astype(float))}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
            above, c = by_order[n + 1]
            rows, back = np.unique(above[:, 1:], axis=0, return_inverse=True)
            tally = np.zeros((len(rows), len(languages)))
            np.add.at(tally, back.ravel(), (c > 0).astype(float))
            by_order[n] = (rows, tally)
        alphabet = len(by_order[1][0]) + 1
        model.limits = np.tile([np.log(alphabet), 0.0, 0.0], (len(languages), 1))  # until calibrated
        for n in range(1, ORDER + 1):
            rows, c = by_order[n]
            ones, twos = (c == 1).sum(0), (c == 2).sum(0)
            discount = np.where(ones > 0, ones / np.maximum(1, ones + 2 * twos), 0.5)
            contexts, back = np.unique(rows[:, :-1], axis=0, return_inverse=True) if n > 1 else (rows[:1, :0], np.zeros(len(rows), int))
            back = back.ravel()
            total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, back, c)
            np.add.at(kinds, back, (c > 0).astype(float))
            seen = total > 0
            backoff = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
            direct = np.where(seen[back], np.maximum(c - discount, 0) / np.maximum(total[back], 1), 0.0)
            if n == 1:
                model.floor = np.log(np.maximum(backoff[0], 1e-6) / alphabet)
                lower = np.full((len(rows), len(languages)), 1.0 / alphabet)
                backoff = np.maximum(backoff, 1e-6)
            else:
                below = gram_hash(list(rows[:, 1:].T))
                lower = np.exp(model.log_p[n - 2][find(model.keys[n - 2], below)])
                keys = gram_hash(list(contexts.T))
                o = np.argsort(keys)
                model.context_keys.append(keys[o])
                model.log_backoff.append(np.log(np.maximum(backoff, 1e-9))[o].astype(np.float32))
            keys = gram_hash(list(rows.T))
            o = np.argsort(keys)
            model.keys.append(keys[o])
            model.log_p.append(np.log(np.maximum(direct + backoff[back] * lower, 1e-12))[o].astype(np.float32))
        return model

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each non-empty text (from letters_only) under each language."""
        if not texts:
            return np.zeros((0, len(self.languages)))
        chars = code_points("".join(PAD + t + " " for t in texts))
        sizes = np.array([len(t) + 1 for t in texts])
        skip = np.repeat(np.arange(1, len(texts) + 1) * len(PAD), sizes)
        at = np.arange(len(skip)) + skip  # the predicted characters
        columns = [chars[at - k] for k in range(ORDER - 1, -1, -1)]
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):  # what order n hasn't seen pays the back-off weight and goes to the next
            own = [c[left] for c in columns[ORDER - n :]]
            place = find(self.keys[n - 1], gram_hash(own))
            known = place >= 0
            out[left[known]] += self.log_p[n - 1][place[known]]
            left, own = left[~known], [c[~known] for c in own]
            if not len(left):
                break
            if n > 1:
                place = find(self.context_keys[n - 2], gram_hash(own[:-1]))
                out[left[place >= 0]] += self.log_backoff[n - 2][place[place >= 0]]
            else:
                out[left] += self.floor
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return -np.add.reduceat(out.astype(np.float64), starts, axis=0) / sizes[:, None]

    def own_entropies(self, texts: list[str | None], truth: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts with a letter and a known language: the language's place, the cross-entropy under it, and the length."""
        clean = [(t, self.languages.index(k)) for t, k in zip(map(letters_only, texts), truth, strict=True) if t and k in self.languages]
        own, n = np.array([k for _, k in clean], np.int64), np.array([len(t) + 1 for t, _ in clean], np.int64)
        h = np.concatenate([np.zeros((0, len(self.languages))), *(self.entropies(part) for part in _by_size([t for t, _ in clean]))])
        return own, h[np.arange(len(h)), own], n

    def calibrate(self, own: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
        """Limits by language from what own_entropies gives for held-back texts."""
        if len(x) < ENOUGH:
            return
        counts = np.bincount(own, minlength=len(self.languages))
        means = np.array([np.average(x[own == k], weights=np.minimum(n[own == k], 500)) if counts[k] else 0 for k in range(len(self.languages))])

        def limit(pick: np.ndarray, mean: float) -> tuple[float, float, float]:
            off, size = np.abs(x - means[own])[pick], n[pick]
            spread = np.quantile(off[size >= np.median(size)], 0.99)
            return mean, 5 * spread, 4 * np.quantile(off * np.sqrt(size), 0.9)

        pooled = limit(np.ones(len(x), bool), np.average(x, weights=np.minimum(n, 500)))
        self.limits = np.array([limit(own == k, means[k]) if counts[k] >= ENOUGH else pooled for k in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether rejected, for each text."""
        clean = [letters_only(t) for t in texts]
        some = [i for i, t in enumerate(clean) if t] if self.languages else []
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
        if not some:
            return lang, score, entropy, rejected
        h = np.concatenate([self.entropies(part) for part in _by_size([clean[i] for i in some])])
        n = np.array([len(clean[i]) + 1 for i in some])
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        gap = -(h - low[:, None]) * np.minimum(n, 50)[:, None]
        score[some] = 1 / np.exp(gap).sum(1)
        entropy[some] = low
        mean, spread, share = self.limits[best].T
        rejected[some] = low > mean + spread + share / np.sqrt(n)
        for i, k in zip(some, best, strict=True):
            lang[i] = self.languages[k]
        return lang, score, entropy, rejected


def _by_size(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """lang, text and whether it calibrates: up to per_language texts a language, by hash of the id; equal texts once."""
    usable = docs.select("doc_id", "lang", "text").filter(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialise(usable.groupBy("lang").count())
    # a share of the hash range that holds about twice the texts wanted leaves a bounded rest to rank
    rank = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(2**53))
    near = usable.join(bounded(sizes), "lang").withColumn("_rank", rank).filter(F.col("_rank") * F.col("count") <= 2 * per_language + 50)
    near = near.select("lang", "text", "_rank", "doc_id").groupBy("lang", F.xxhash64("text").alias("_t")).agg(F.min_by("text", F.struct("_rank", "doc_id")).alias("text"), F.min("_rank").alias("_rank"))
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_rank", "_t"))).filter(F.col("_n") <= per_language)
    return materialise(first.select("lang", "text", (F.pmod("_n", F.lit(5)) == 0).alias("calibrates")))


def train(docs: DataFrame, learn: Column, per_language: int = 1500) -> KneserNey:
    """The model of the rows that `learn` lets in."""
    sample = _sample(docs, learn, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                clean = letters_only(text)
                if clean:
                    s = PAD + clean + " "
                    for gram, n in Counter(map("".join, zip(*[s[k:] for k in range(ORDER)], strict=False))).items():
                        found[lang, gram] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    fitted = sample.filter("NOT calibrates").select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    # what reaches the driver is bounded by the sample: n-grams of at most per_language texts a language
    rows = fitted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return KneserNey([])
    langs, grams = np.array(rows["lang"].to_pylist()), rows["gram"].to_pylist()
    languages, column = np.unique(langs, return_inverse=True)
    listed = sorted(set(grams))
    line = {g: i for i, g in enumerate(listed)}
    counts = np.zeros((len(listed), len(languages)))
    counts[[line[g] for g in grams], column] = rows["n"].to_numpy()
    model = KneserNey.fit(listed, counts, [str(x) for x in languages])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 300):
                part = b.slice(k, 300)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shared.value.own_entropies(part.column(1).to_pylist(), part.column(0).to_pylist())], names=["own", "entropy", "size"])

    # texts are measured in tasks; three numbers a calibration text reach the driver
    checked = sample.filter("calibrates").select("lang", "text").mapInArrow(measure, "own long, entropy double, size long").toArrow()
    model.calibrate(*(checked[c].to_numpy() for c in ("own", "entropy", "size")))
    return model


def identify(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitted sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 300):
                part = b.slice(k, 300)
                lang, score, entropy, rejected = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: KneserNey) -> DataFrame:
    """The rows of docs, all columns, that some language's model explains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, "text", lambda: lambda texts: [not r for r in shared.value.predict(texts)[3]])


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected; learns from rows outside fold 0 of 5."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    found = identify(docs, train(docs, part != 0))
    return found.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
