"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in the corpus.

Both encodings of a text are cut where tokens of both end: a dictionary from each
cumulative end to its index for either side, their keys intersected as hash sets,
and the sorted common keys slice both lists of ids into groups. Within a group every
pair of tokens whose byte ranges overlap is a link; the links of a group follow from
its ids alone and are kept for groups that have come up before.

A text is encoded by stretches, which begin where tokens of both sides begin whatever
stands before: with one single space between plain characters, with a line feed after
one, or with a mark after a letter. A's pattern never joins these; that B's pieces don't
is read off its model, and a model that has other pieces is given longer stretches.
Stretches go through the tokenizers and sentencepiece libraries and are kept, as most
come up again. A's file is byte-level BPE and encodes a space and the text; B's model
adds that space itself, so a stretch that begins otherwise is given to it behind a
letter, whose token is then left out.

Counts of id pairs over the corpus reach each document block by block. A block is some
documents of one task with about BLOCK_PLACES stretches: its
distinct pairs are rows of a table that is summed up by pair, joined with the sums and
brought back together by block, where they become scores of stretches and then of
documents; documents themselves are not shuffled pair by pair. A pair that every block
holds has one row a block, and as the blocks are a written table, adaptive execution
can split it. A block is written as small slices and brought together by one group,
so that no step holds more than a block of a task at once.

Defined results: a text that is null or empty, or whose tokens of either side do not
spell a space and the text, has no tokens: its numbers are 0 and its groups are the
empty text. Repeated rows count each; doc_id may be null or repeat, as rows are known
by their block and place; an empty table gives an empty table. Extra columns are not
carried. Spark sends at most 64 MB of texts to Python at once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import materialise
from loomline.llm.token_counts import byte_alphabet, token_bytes

BLOCK_PLACES = 400_000
#: Stretches that a worker keeps, by an estimate of their bytes.
CACHE_BYTES = 200_000_000
#: Texts whose new stretches go to a tokenizer at once.
AT_ONCE = 200
#: Characters that a space or a line feed may stand beside, letters, and marks that A never joins to a letter before them.
PLAIN, LETTER, MARKS = "[!-~¡-ɏ]", "[A-Za-zÀ-ÖØ-öø-ɏ]", ".,;:!?&$#%*"


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_model: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        alphabet = byte_alphabet()
        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.bytes_a = {i: token_bytes(token, alphabet) for token, i in spec["model"]["vocab"].items() if i not in special} | special
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a = [len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)]
        self.sizes_b = list(map(len, self.bytes_b))
        if spec.get("normalizer"):
            raise ValueError("a side that rewrites texts doesn't spell them")
        self.lead = self.b.piece_to_id("▁a")
        self.cuts = self._cuts()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _cuts(self) -> re.Pattern | None:
        """Where a text may be cut, as far as B's pieces allow it."""
        pieces = [x.decode("utf-8", "replace") for x in self.bytes_b]
        if any(" " in p.lstrip(" ") for p in pieces) or self.bytes_b[self.lead] != b" a":
            return None
        rules = [f"(?<={PLAIN})(?= {PLAIN})"]
        if not any("\n" in p and len(p) > 1 for p in pieces):
            rules.append(f"(?<={PLAIN})(?=\n)")
        joined = {p[m.start() + 1] for p in pieces for m in re.finditer(f"{LETTER}[{re.escape(MARKS)}]", p)}
        marks = "".join(c for c in MARKS if c not in joined)
        if marks:
            rules.append(f"(?<={LETTER})(?=[{re.escape(marks)}])")
        # what stands behind is looked at only where a cut may be
        return re.compile(f"(?=[ \n{re.escape(marks)}])(?:{'|'.join(rules)})")

    def encode(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of A and B for stretches; None where B doesn't spell the stretch. A, byte-level and without a normalizer, always does."""
        left = self.a.encode_batch_fast(stretches, add_special_tokens=False)
        right, spell, lead = self.b.encode([t[1:] if t[0] == " " else "a" + t for t in stretches], num_threads=1), self.bytes_b, [self.lead]
        found = []
        for t, x, b in zip(stretches, left, right, strict=True):
            if t[0] != " ":
                b = b[1:] if b[:1] == lead else []
            found.append((x.ids, b) if b"".join([spell[i] for i in b]) == t.encode() else None)
        return found


def common_cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The byte offsets where tokens of both sides end, in order, and how many tokens of A and of B end up to each."""
    index_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    shared = sorted(index_a.keys() & index_b.keys())
    return shared, list(map(index_a.__getitem__, shared)), list(map(index_b.__getitem__, shared))


def expand_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the stretches of bytes that no token ends within, and the token of A and of B that each lies in: the links of all slices, in order."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


Known = tuple[int, int, int, str, list[int]]
#: In the place of stretches that B doesn't spell.
UNSPELT: Known = (0, 0, 0, "", [])


class Aligner:
    """Stretches with what is known of each: n_a, n_b, number of groups, their text, and its links as a << 32 | b; None if it can't be spelt."""

    def __init__(self, sides: Sides, limit: int = CACHE_BYTES) -> None:
        self.sides, self.limit, self.held = sides, limit, 0
        self.known: dict[str, Known | None] = {}
        self.older: dict[str, Known | None] = {}
        self.size_a, self.size_b = np.array(sides.sizes_a, np.int64), np.array(sides.sizes_b, np.int64)
        self.names = list(map(str, range(max(len(sides.sizes_a), len(sides.sizes_b)))))

    def cut(self, text: str) -> list[str]:
        """The stretches of a space and the text."""
        return self.sides.cuts.split(" " + text) if self.sides.cuts else [" " + text]

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> list[Known]:
        """Groups and links of stretches, all of them at once: they lie one after the other, and both sides end where each ends."""
        if not encoded:
            return []
        ids_a, ids_b = list(chain.from_iterable([a for a, _ in encoded])), list(chain.from_iterable([b for _, b in encoded]))
        array_a, array_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[array_a]), np.cumsum(self.size_b[array_b])
        shared, stops_a, stops_b = common_cuts(ends_a.tolist(), ends_b.tolist())
        a, b = [self.names[i] for i in ids_a], [self.names[i] for i in ids_b]
        groups = [
            f"{a[i]}|{b[j]}" if x - i == 1 == y - j else f"{','.join(a[i:x])}|{','.join(b[j:y])}"
            for i, x, j, y in zip(chain([0], stops_a), stops_a, chain([0], stops_b), stops_b)
        ]
        ends, of_a, of_b = expand_links(ends_a, ends_b)
        links = (array_a[of_a] << 32 | array_b[of_b]).tolist()
        whole = ends_a[np.cumsum([len(x) for x, _ in encoded]) - 1]  # where each stretch ends
        at, cut = np.searchsorted(shared, whole, "right").tolist(), np.searchsorted(ends, whole, "right").tolist()
        return [
            (len(x), len(y), stop - start, ";".join(groups[start:stop]), links[low:high])
            for (x, y), start, stop, low, high in zip(encoded, chain([0], at), at, chain([0], cut), cut)
        ]

    def learn(self, stretches: set[str]) -> None:
        """Makes sure that these are known. When the store is half full it becomes the older one, from which what comes up again is taken over."""
        if self.held > self.limit // 2:
            self.older, self.known, self.held = self.known, {}, 0
        new = stretches.difference(self.known)
        again = new.intersection(self.older)
        for t in again:
            self.known[t] = self.older[t]
        fresh = list(new.difference(again))
        encoded = self.sides.encode(fresh)
        self.known.update(dict.fromkeys(fresh))
        self.known.update(zip([t for t, x in zip(fresh, encoded) if x], self.align([x for x in encoded if x]), strict=True))
        self.held += 300 * len(new) + 30 * sum(map(len, new))


def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of x up to each end from the one before."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])


@lru_cache(maxsize=1)
def _aligner(byte_bpe: str, piece_model: str) -> Aligner:
    """One per Python worker, kept from task to task."""
    return Aligner(Sides(byte_bpe, piece_model))


BLOCK = "block long, slice int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, stops binary, places binary, link_stops binary, links binary, first int, pairs array<long>, totals array<long>"
#: About as many bytes are in a slice of a block. Readers and writers of Parquet hold thousands of rows at once, so rows are small.
SLICE_BYTES = 8192


def slices(doc_ids: list[int | None], numbers: list[np.ndarray], groups: list[str], binaries: list[np.ndarray], pairs: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    """A block as rows of BLOCK: each of its columns is cut into as many slices, of equal length."""
    count = -(-(120 * len(doc_ids) + sum(x.nbytes for x in binaries) + 16 * len(pairs)) // SLICE_BYTES) or 1
    cuts = lambda n: np.arange(count + 1, dtype=np.int64) * n // count
    listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts(len(x)), pa.int32()), x)
    columns = [pa.array([int.from_bytes(os.urandom(8)) >> 1] * count), pa.array(range(count), pa.int32()), listed(pa.array(doc_ids, pa.int64()))]
    columns += [*[listed(pa.array(x)) for x in numbers], listed(pa.array(groups, pa.string()))]
    for x in binaries:
        at = cuts(len(x)).tolist()
        columns.append(pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()))
    columns += [pa.array(cuts(len(pairs))[:-1], pa.int32()), listed(pa.array(pairs)), listed(pa.array(totals))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])


def align_blocks(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Blocks of aligned documents, as a written table of slices.

    Put together in order, `pairs` are the block's distinct pairs and `totals` how many links hold them. Stretch
    s of the block has the pairs at link_stops[s - 1] to link_stops[s] of `links`, and
    document k the stretches at stops[k - 1] to stops[k] of `places`. `first` is the place
    of a slice's first pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_bpe, piece_model)
        gc.freeze()  # what is kept makes no cycles and need not be searched for any
        gc.disable()
        rows: list[tuple] = []
        places: list[int] = []
        stops: list[int] = []
        number: dict[str, int] = {}
        own = [UNSPELT]

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x[4]) for x in own], np.int64)
            codes = np.fromiter(chain.from_iterable([x[4] for x in own]), np.int64, int(sizes.sum()))
            pairs, at = np.unique(codes, return_inverse=True)
            stretch, ends = np.array(places, np.int64), np.array(stops, np.int64)
            totals = np.bincount(at, np.repeat(np.bincount(stretch, minlength=len(own)), sizes), len(pairs)).astype(np.int64)
            numbers = [sums(np.array([x[k] for x in own], np.int64)[stretch], ends) for k in range(3)]
            binaries = [ends.astype("<i8"), stretch.astype("<i4"), np.cumsum(sizes).astype("<i8"), at.astype("<i4")]
            return slices([r[0] for r in rows], numbers, [r[1] for r in rows], binaries, pairs, totals)

        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = b.slice(k, AT_ONCE)
                cut = [aligner.cut(t) if t else [] for t in part.column(1).to_pylist()]
                distinct = set(chain.from_iterable(cut))
                aligner.learn(distinct)
                for t in distinct.difference(number):
                    found = aligner.known[t]
                    number[t] = len(own) if found else 0
                    if found:
                        own.append(found)
                texts = [x[3] for x in own]
                for doc_id, stretches in zip(part.column(0).to_pylist(), cut, strict=True):
                    at = [number[t] for t in stretches]
                    if not at or 0 in at:
                        rows.append((doc_id, ""))
                    else:
                        places += at
                        rows.append((doc_id, hashlib.sha256(";".join([texts[i] for i in at]).encode()).hexdigest()))
                    stops.append(len(places))
                if len(places) > BLOCK_PLACES:
                    yield block()
                    rows, places, stops, number, own = [], [], [], {}, [UNSPELT]
        if rows:
            yield block()
        gc.enable()

    return materialise(docs.select("doc_id", "text").mapInArrow(run, BLOCK))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, n (links corpus-wide) and best (whether no pair of the same b has more), as a written table.

    Rows are as many as distinct pairs, at most the product of the vocabularies; those of
    one b are at most A's vocabulary.
    """
    each = blocks.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select("x.pairs", "x.totals")
    summed = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("n"))
    named = summed.select("pair", F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")
    return materialise(named.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))))


def scores(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document of the blocks."""
    each = blocks.select("block", "first", F.posexplode("pairs").alias("place", "pair")).withColumn("place", F.col("first") + F.col("place"))
    met = each.join(counts.select("pair", "n", "best"), "pair").select(F.col("block").alias("of"), "place", "n", "best")

    def score_block(rows: pa.Table, back: pa.Table) -> pa.Table:
        rows, back = rows.sort_by("slice"), back.sort_by("place")
        number = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)
        n, best = back["n"].to_numpy(), back["best"].to_numpy().astype(np.int64)
        stops, places, link_stops, links = number("stops", "<i8"), number("places", "<i4"), number("link_stops", "<i8"), number("links", "<i4")
        # sums over the links of each stretch, then over the stretches of each document
        score = lambda x: sums(sums(x, link_stops)[places], stops)
        columns = {c: pc.list_flatten(rows[c]) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        made = {"n_links": score(np.ones(len(links), np.int64)), "n_best": score(best[links]), "count_sum": score(n[links])}
        columns |= {c: pa.array(x.astype(np.int64)) for c, x in made.items()}
        return pa.table({c: columns[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    # a group is one block: about BLOCK_PLACES stretches and their distinct pairs
    own = blocks.drop("first", "pairs", "totals").groupBy("block")
    return own.cogroup(met.groupBy("of")).applyInArrow(score_block, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """Align, count, and score every document by the counts."""
    blocks = align_blocks(docs, byte_bpe, piece_model)
    return scores(blocks, pair_counts(blocks))
