"""Fill-in-the-middle transformation, with both cuts located in a wavelet matrix.

A text's code points are mapped to six classes: white space or line feed, word, the
last of a word, and white space or line feed at the end of the text. The classes of
many texts lie one after the other in one wavelet matrix. Units end where certain
classes stand, so the number of units in any stretch of a text is a sum of ranks
(`UNITS`), and the place where the k-th unit of a text ends is found by bisection on
these ranks, for all texts of a batch at once.

A token is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: it ends with the
last character of a word, or with the text. A line ends with a line feed, or with the
text.

Draws come from the sha256 of seed and doc_id alone, so they don't depend on order,
partitions or other rows.

Defined results: null text is empty text, of form plain; a null doc_id draws as the
text `null`; repeated rows repeat; an empty table gives an empty table. Extra columns
are not carried. Texts are worked on in groups of about CHUNK_CHARS code points, and
Spark sends at most 64 MB of them to Python at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_CHARS = 500_000
#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of code points.
SPACE, NEWLINE, WORD, WORD_END, LAST_SPACE, LAST_NEWLINE = range(6)
LEVELS = 3
#: Classes whose ranks add up to the number of units that have ended.
UNITS = {"token": (WORD_END, LAST_SPACE, LAST_NEWLINE), "line": (NEWLINE, LAST_NEWLINE)}


class WaveletMatrix:
    """Ranks of symbols in a sequence: level by level, zeros of a bit before ones, and running counts of ones every 64 places."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.size, self.levels = len(symbols), levels
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)  # one place more, so that a rank at the end has a word
            padded[: self.size] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64))
            self.zeros.append(self.size - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are this one, for each `at`."""
        low, high = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for level in range(self.levels):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            if (symbol >> (self.levels - 1 - level)) & 1:
                low, high = self.zeros[level] + ones_low, self.zeros[level] + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low

    def ranks(self, symbols: Sequence[int], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that lie one after the other and end at `ends`."""
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    out = np.where(space, np.where(points == 0x0A, NEWLINE, SPACE), WORD).astype(np.uint8)
    last = np.zeros(len(points), bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    after = np.append(space[1:], True)
    out[~space & (after | last)] = WORD_END
    out[space & last] += LAST_SPACE - SPACE
    return out


class UnitIndex:
    """Units of many texts: how many each has, and where its k-th one ends."""

    def __init__(self, texts: list[str], unit: str = "token") -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        kinds = classes(points, self.ends)
        self.matrix, self.symbols = WaveletMatrix(kinds, LEVELS), UNITS[unit]
        self.before = self.matrix.ranks(self.symbols, self.starts)
        self.counts = self.matrix.ranks(self.symbols, self.ends) - self.before
        if unit == "line":  # the text itself ends its last line
            self.counts += (sizes > 0) & ~np.isin(kinds[np.maximum(self.ends - 1, 0)] if len(kinds) else sizes, [NEWLINE, LAST_NEWLINE])

    def cut(self, k: np.ndarray) -> np.ndarray:
        """For each text, how many of its code points lie in its first k units: bisection for the least place whose ranks come to k."""
        low, high = self.starts.copy(), self.ends.copy()
        goal = self.before + k
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.matrix.ranks(self.symbols, middle) >= goal
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low - self.starts


@dataclass(frozen=True)
class Rates:
    """Shares of a hundred: texts that are transformed, and of these the ones with the suffix first."""

    transformed: int = 50
    spm: int = 80
    seed: int = 42


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    name = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return prefix + middle + suffix


def restore(output: str, form: str) -> str:
    """The text that an output came from. A mark can't arise across the border of a part and a mark, as none overlaps itself."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output.removeprefix(first).split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def transform_texts(doc_ids: list[int | None], texts: list[str], rates: Rates = Rates(), unit: str = "token") -> list[tuple]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    index = UnitIndex(texts, unit)
    numbers = np.array([draws(i, rates.seed) for i in doc_ids], np.int64).reshape(-1, 4)
    first, second = numbers[:, 0] % (index.counts + 1), numbers[:, 1] % (index.counts + 1)
    one, two = index.cut(np.minimum(first, second)), index.cut(np.maximum(first, second))
    rows = []
    for text, n, h, i, j in zip(texts, index.counts.tolist(), numbers.tolist(), one.tolist(), two.tolist(), strict=True):
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rates.transformed:
            rows.append((n, "plain", None, None, text))
        else:
            form = "spm" if h[3] % 100 < rates.spm else "psm"
            rows.append((n, form, i, j - i, arrange(form, text[:i], text[i:j], text[j:])))
    return rows


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, about CHUNK_CHARS code points at a time."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def transform(docs: DataFrame, rates: Rates = Rates(), unit: str = "token") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            n, form, prefix, middle, output = zip(*transform_texts(ids, texts, rates, unit), strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def transform_digests(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it; the texts stay in the task."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            n, form, prefix, middle, output = zip(*transform_texts(ids, texts, rates), strict=True)
            restored = [digest(restore(o, f)) for o, f in zip(output, form, strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(list(map(digest, output))), pa.array(restored)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: DuckDB SQL of transform_digests with the default rates. Longs that may be null are doubles here, as pandas makes them of Spark's.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ws, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT for k in range(4)] AS hs FROM t),
k AS (SELECT *, len(ws) AS n, least(hs[1] % (len(ws) + 1), hs[2] % (len(ws) + 1)) AS i, greatest(hs[1] % (len(ws) + 1), hs[2] % (len(ws) + 1)) AS j FROM u),
p AS (SELECT doc_id, text, n::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(ws[1:i], '') AS a, array_to_string(ws[i + 1:j], '') AS b, array_to_string(ws[j + 1:], '') AS c FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', c, '<M>', b) ELSE concat('<S>', c, '<P>', a, '<M>', b) END AS output FROM p),
s AS (SELECT *, CASE form WHEN 'plain' THEN [output] WHEN 'psm' THEN [output[4:instr(output, '<S>') - 1], output[instr(output, '<M>') + 3:], output[instr(output, '<S>') + 3:instr(output, '<M>') - 1]]
        ELSE [output[instr(output, '<P>') + 3:instr(output, '<M>') - 1], output[instr(output, '<M>') + 3:], output[4:instr(output, '<P>') - 1]] END AS parts FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::DOUBLE AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::DOUBLE AS middle_chars,
    sha256(output) AS output_sha256, sha256(array_to_string(parts, '')) AS restored_sha256 FROM s
"""
