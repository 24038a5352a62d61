"""Byte-level BPE by prefix dynamic programming.

For a fixed table of ranks, the encoding of a byte string ends in one certain
token, and what precedes it is the encoding of the rest. So one token per prefix
(the last one) stores the encodings of all prefixes at once: a text grows by
filling in the new prefixes only, and after an edit the old table holds again as
soon as it has agreed with the new one over a whole longest token's length.

A token may follow another only if merging their joined bytes by rank gives
exactly the two; that is read off the parts at their edges once per pair and
remembered.

Defined results: null text is empty text, with no ids; repeated rows repeat; an
empty table gives an empty table. Extra columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

CACHE_PIECES = 1_000_000
KNOWN_PAIRS = 1_000_000
NEVER = float("inf")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: tokens that merging can produce, with their last merge; others only occur as whole pieces
        self.last_merge = {token: parts for token in ranks if len(parts := self._parts(token, 2)) <= 2 and b"".join(parts) == token and (len(parts) == 1 or self._joins(parts))}
        self.reachable = {token: ranks[token] for token in self.last_merge}
        self.endings = {token[i:] for token in self.reachable for i in range(len(token))}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[bytes, bool], list[tuple[bytes, float, float]]] = {}

    def _joins(self, parts: list[bytes]) -> bool:
        return parts[0] + parts[1] in self.ranks

    def _parts(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until `stop` parts are left or none merges."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [self.ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
        while len(parts) > stop and pair:
            lowest = min(pair)
            if lowest == NEVER:
                break
            at = pair.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = self.ranks.get(parts[at] + parts[at + 1], NEVER)
            if at:
                pair[at - 1] = self.ranks.get(parts[at - 1] + parts[at], NEVER)
        return parts

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by definition."""
        return [self.ranks[p] for p in self._parts(piece)]

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, float, float]]:
        """The parts that stand at one edge of a token while it is merged: part, when it forms, when it is used up."""
        found = self.spines.get((token, right))
        if found is None:
            found, until, part = [], NEVER, token
            while True:
                parts = self.last_merge[part]
                formed = self.ranks[part] if len(parts) == 2 else -1
                found.append((part, formed, until))
                if len(parts) == 1:
                    break
                until, part = formed, parts[1 if right else 0]
            self.spines[token, right] = found
        return found

    def _crosses(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes merges over their border: some part at the edge of
        either stands there together with one of the other, and the two merge before either is used up."""
        for b, b_formed, b_until in self._spine(right, False):
            for a, a_formed, a_until in self._spine(left, True):
                rank = self.ranks.get(a + b)
                if rank is not None and rank < a_until and rank <= b_until and b_formed < a_until and a_formed <= b_until:
                    return True
        return False

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = not self._crosses(self.tokens[left], self.tokens[right])
        return known

    def extend(self, piece: bytes, last: list[int], stop: int | None = None) -> None:
        """Fill in the last token of each prefix from len(last) on; last[i] belongs to piece[:i + 1]."""
        reachable, endings, pairs, follows = self.reachable, self.endings, self.pairs, self.follows
        for end in range(len(last) + 1, (len(piece) if stop is None else stop) + 1):
            start = end - 1
            while start and piece[start - 1 : end] in endings:
                start -= 1
            while start < end:
                token = reachable.get(piece[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start - 1]
                    good = pairs.get(before << 32 | token)
                    if good or good is None and follows(before, token):
                        break
                start += 1
            else:
                raise ValueError("the ranks lack a byte")
            last.append(token)

    def walk(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens stores for its longest prefix."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        last: list[int] = []
        self.extend(piece, last)
        return self.walk(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """A byte string with its table of last tokens, for appends and edits without encoding all of it again."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b"") -> None:
        self.bpe, self.data, self.last, self.computed = bpe, b"", [], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.computed += len(more)
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        agreed = 0
        while len(self.last) < len(self.data):
            self.bpe.extend(self.data, self.last, len(self.last) + 1)
            self.computed += 1
            at = len(self.last) - 1
            # a table entry depends on the longest token's length of bytes and entries before it
            agreed = agreed + 1 if at >= start + len(new) and self.last[at] == old[at - shift] else 0
            if agreed >= self.bpe.longest:
                self.last += old[at - shift + 1 :]
                break

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class TextEncoder:
    """Whole texts: each match of the pattern is a piece of its own; known pieces are kept up to a limit."""

    def __init__(self, bpe: PrefixBPE, pattern: str, limit: int = CACHE_PIECES) -> None:
        import regex

        self.bpe, self.split, self.limit = bpe, regex.compile(pattern).findall, limit
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        known = self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = tuple(self.bpe.encode_piece(p.encode()))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))


@lru_cache(maxsize=1)
def _encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """One per Python worker, kept from task to task."""
    return TextEncoder(PrefixBPE(load_ranks(ranks_path)), pattern)


def encode_column(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary), for every whole text."""
    return _mapped(docs, ranks_path, pattern, "doc_id long, ids array<int>, decoded binary", lambda ids, raw: (ids, raw), [pa.list_(pa.int32()), pa.binary()])


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; the ids themselves stay in the task."""

    def digest(ids: list[int], raw: bytes) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _mapped(docs, ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, schema: str, made, kinds: list) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        bpe = encoder.bpe
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows = []
                for text in part.column(1).to_pylist():
                    ids = encoder.encode(text or "")
                    rows.append(made(ids, bpe.decode(ids)))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
