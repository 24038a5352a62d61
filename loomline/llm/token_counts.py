"""Exact token counts of every prefix of a text, by prefix dynamic programming.

`count[i]` is the number of tokens that the tokenizer gives for the first i code
points of a text, taken as a text of its own. One table a text then answers how
many tokens a prefix has, how much of the text fits a budget of tokens and where
to truncate, without encoding anything again; an append fills in new entries only.

Within a piece (one match of the tokenizer's pattern) the last token of each byte
prefix is known from `bpe.PrefixBPE`, and the count of a prefix is one more than
that of the prefix before its last token. Counts of pieces add up, as merges never
cross pieces. A few prefixes split otherwise than the whole text does: a run of
white space that the text goes on after, a contraction cut short, a special token
cut short. Their last pieces, three at most, are counted on their own.

Files: byte-level BPE in the tokenizers library's format. Letters, numbers and white
space are what the library takes for them: where its Unicode tables differ from
Python's, a code point is asked for once.

Defined results: null text is empty text, with a count of 0 and one table entry;
special tokens inside a text count as one, as the library's default has it;
repeated rows repeat; an empty table gives an empty table; doc_id may be null.
Extra columns are not carried. Spark sends at most 64 MB of texts to Python at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.bpe import PrefixBPE

#: Pieces that a worker keeps, by an estimate of their bytes.
CACHE_BYTES = 96_000_000
#: The pattern of byte-level pre-tokenization, which the tokenizers library has built in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points from here on may be of another class in the library's Unicode tables.
UNSURE = regex.compile("[԰-\U0010ffff]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(token: str, alphabet: dict[str, int]) -> bytes:
    return bytes(alphabet[c] for c in token)


class Pieces:
    """Cuts texts as the library's pre-tokenizer does."""

    #: One character of each class that the pattern has no other rule for.
    STAND_INS = (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]"), ("\t", r"\s"))

    def __init__(self, tokenizer) -> None:
        self.cut_as_library = tokenizer.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(PATTERN)
        self.kinds = [(sign, regex.compile(kind)) for sign, kind in self.STAND_INS]
        self.asked: dict[str, str | None] = {}

    def _kind(self, c: str) -> str:
        for sign in "a1!":
            if len(self.cut_as_library(sign + c)) == 1:
                return sign
        return "\t"

    def _differs(self, c: str) -> str | None:
        """The stand-in of a code point that the library takes for another class than Python does."""
        if c not in self.asked:
            found = self._kind(c)
            own = next(sign for sign, kind in self.kinds if kind.fullmatch(c))
            self.asked[c] = None if found == own else found
        return self.asked[c]

    def cut(self, text: str) -> list[str]:
        if UNSURE.search(text):
            other = {ord(c): sign for c in set(UNSURE.findall(text)) if (sign := self._differs(c))}
            if other:
                return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(other))]
        return self.pattern.findall(text)


class PrefixCounter:
    """Counts tokens of texts by one byte-level BPE file; tables of pieces are kept up to a number of bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer") or cut["type"] != "ByteLevel" or cut.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE file")
        alphabet = byte_alphabet()
        ranks = {bytes([b]): b for b in range(256)}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(token_bytes(a + b, alphabet), 256 + rank)
        self.bpe = PrefixBPE(ranks)
        tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(tokenizer)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.longest_special = len(added[0]) if added else 0
        self.cache_bytes, self.held = cache_bytes, 0
        self.known: dict[str, tuple[int, bytes | np.ndarray]] = {}

    def _prefixes(self, piece: str) -> list[int]:
        """The count of each prefix of a piece, in code points."""
        raw = piece.encode()
        last: list[int] = []
        self.bpe.extend(raw, last)
        tokens, counts = self.bpe.tokens, [0]
        for end, token in enumerate(last, 1):
            counts.append(counts[end - len(tokens[token])] + 1)
        if len(raw) > len(piece):
            counts = [counts[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]
        if len(piece) == 3 and piece[0] == "'":  # a contraction cut short is a mark and a letter
            apart = self.pieces.cut(piece[:2])
            counts[2] = sum(self._prefixes(p)[-1] for p in apart) if len(apart) == 2 else counts[2]
        return counts[1:]

    def learn(self, pieces: list[str]) -> None:
        """Makes sure that the tables of these pieces are known."""
        new = set(pieces).difference(self.known)
        if self.held > self.cache_bytes:
            self.known, self.held, new = {}, 0, set(pieces)
        for p in new:
            counts = self._prefixes(p)
            # all but the longest pieces have counts of one byte
            self.known[p] = (counts[-1], bytes(counts) if max(counts) < 256 else np.array(counts, np.int32))
            self.held += 250 + 5 * len(p)

    def cut(self, text: str) -> tuple[list[str], set[int]]:
        """The pieces of a text, and which of them are special tokens."""
        if self.special is None or not self.special.search(text):
            return self.pieces.cut(text), set()
        found: list[str] = []
        special: set[int] = set()
        at = 0
        for m in self.special.finditer(text):
            found += self.pieces.cut(text[at : m.start()])
            special.add(len(found))
            found.append(m[0])
            at = m.end()
        return found + self.pieces.cut(text[at:]), special

    def count(self, text: str) -> int:
        pieces, special = self.cut(text)
        self.learn([p for k, p in enumerate(pieces) if k not in special])
        return sum(1 if k in special else self.known[p][0] for k, p in enumerate(pieces))


class TokenTable:
    """A text with the token count of each of its prefixes."""

    def __init__(self, counter: PrefixCounter, text: str = "") -> None:
        self.counter, self.text = counter, ""
        self._starts, self._totals = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self._pieces: list[str] = []
        self._special: set[int] = set()
        self.append(text)

    def append(self, more: str) -> None:
        """Goes on with the text; pieces that what follows can't change stay as they are."""
        keep = max(0, len(self._pieces) - 3)
        # what was text before may be the beginning of a special token, and the piece before that may then end elsewhere
        while keep and len(self.text) - self._starts[min(keep + 2, len(self._pieces))] < self.counter.longest_special:
            keep -= 1
        rest = self.text[int(self._starts[keep]) :] + more
        self.text += more
        pieces, special = self.counter.cut(rest)
        self._special = {k for k in self._special if k < keep} | {k + keep for k in special}
        self._pieces = self._pieces[:keep] + pieces
        self.counter.learn([p for k, p in enumerate(pieces) if k not in special])
        known = self.counter.known
        totals = [1 if k in special else known[p][0] for k, p in enumerate(pieces)]
        after = lambda old, new: np.concatenate([old[: keep + 1], old[keep] + np.cumsum(new, dtype=np.int64)])
        self._starts, self._totals = after(self._starts, list(map(len, pieces))), after(self._totals, totals)

    @property
    def n_tokens(self) -> int:
        return int(self._totals[-1])

    def _alone(self, k: int, end: int) -> int:
        """The count of the prefix that ends at code point `end`, counted anew from piece k on."""
        return int(self._totals[k]) + self.counter.count(self.text[int(self._starts[k]) : end])

    def _tail(self, k: int) -> int:
        """The piece from which a prefix that ends within special token k splits otherwise."""
        first = k
        while first and first - 1 not in self._special and self._starts[first] >= self._starts[k] - 1:
            first -= 1
        return first

    def _counts(self, low: int, high: int) -> np.ndarray:
        """The counts of the prefixes that end in pieces low to high - 1."""
        parts = []
        self.counter.learn([p for k, p in enumerate(self._pieces[low:high], low) if k not in self._special])
        tables = [None if k in self._special else self.counter.known[self._pieces[k]][1] for k in range(low, high)]
        for k, table in enumerate(tables, low):
            piece, base, start = self._pieces[k], int(self._totals[k]), int(self._starts[k])
            if table is None:
                first = self._tail(k)
                parts.append(np.array([*(self._alone(first, start + j) for j in range(1, len(piece))), base + 1], np.int32))
                continue
            counts = base + (np.frombuffer(table, np.uint8) if isinstance(table, bytes) else table).astype(np.int32)
            if piece[0].isspace() and k and k - 1 not in self._special and self._pieces[k - 1].isspace():
                counts[0] = self._alone(k - 1, start + 1)  # there the run before does not stop short
            parts.append(counts)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def counts(self) -> np.ndarray:
        """counts()[i] is the token count of the first i code points."""
        return np.concatenate([np.zeros(1, np.int32), self._counts(0, len(self._pieces))])

    def of_prefix(self, end: int) -> int:
        """The token count of the first `end` code points."""
        if not end:
            return 0
        k = int(np.searchsorted(self._starts, end)) - 1
        return int(self._counts(k, k + 1)[end - 1 - int(self._starts[k])])

    def longest_prefix(self, budget: int) -> int:
        """The most code points from the start that have at most `budget` tokens."""
        if budget >= self.n_tokens:
            return len(self.text)
        if budget <= 0:
            return 0
        # a prefix that ends in piece k has more tokens than all pieces up to k - 3
        k = int(np.searchsorted(self._totals, budget, "left"))
        low, high = max(0, k - 2), min(len(self._pieces), k + 5)
        while True:
            fits = np.flatnonzero(self._counts(low, high) <= budget)
            if len(fits) or not low:
                return int(self._starts[low]) + (int(fits[-1]) + 1 if len(fits) else 0)
            low, high = max(0, low - 4), low


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One per Python worker, kept from task to task."""
    return PrefixCounter(path)


def _mapped(docs: DataFrame, schema: str, make, path: str, kinds: list) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                rows = [make(TokenTable(counter, t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def count_documents(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and kept_chars: the code points of the longest prefix of at most `limit` tokens."""

    def make(table: TokenTable) -> tuple:
        n = table.n_tokens
        return len(table.text.encode()), n, n > limit, table.longest_prefix(limit)

    return _mapped(docs, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long", make, path, [pa.int64(), pa.int64(), pa.bool_(), pa.int64()])


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts: the token count of each prefix, from that of no code points on. Written once, it answers what follows."""
    return _mapped(docs, "doc_id long, counts array<int>", lambda table: (table.counts(),), path, [pa.list_(pa.int32())])


def tokens_of_prefix(chars: Column, counts: str = "counts") -> Column:
    """How many tokens the first `chars` code points have, read off a stored table; null past the end."""
    return F.try_element_at(counts, (chars + 1).cast("int"))


def chars_within(budget: Column, counts: str = "counts") -> Column:
    """The code points of the longest prefix of at most `budget` tokens, read off a stored table."""
    places = F.sequence(F.lit(0), F.size(counts) - 1)
    return F.array_max(F.filter(places, lambda i: F.get(counts, i) <= budget))
