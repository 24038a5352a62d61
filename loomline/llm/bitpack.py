"""Token ids in fixed-width bit-packed segments, with random access.

Every task writes one binary file of segments, under a name of its own, and
returns a row for each segment: the file, where the segment starts in it, and the
doc_ids it holds. These rows are the manifest, a Parquet table that Spark commits;
so files of lost or repeated attempts are named nowhere and never read. Layout of a
segment, little-endian:

    magic 'LBP1' | width u32 | block u32 | documents u32 | ids u64
    document ends, u64 each (ids of the segment up to and with it)
    block offsets, u64 each (byte offset of the block in the body)
    body: every block holds up to `block` ids of `width` bits, padded to a byte

`width` is the least that holds the vocabulary's largest id. A block is a whole
number of bytes, so any id range is read from storage by its blocks alone.

Defined results: null text is the end id alone; repeated rows are repeated; an
empty table gives no segments and an empty result. A null doc_id sorts first;
rows that share a doc_id stand in order of a hash of their texts, and may lie in
several files. Extra columns are not carried.

The folder must be one that all tasks can open through pyarrow's file systems.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import shared_folder

MAGIC = b"LBP1"
HEAD = struct.Struct("<4sIIIQ")
BLOCK = 4096
SEGMENT_IDS = 1 << 20
#: Segments that a task reads, about 2 MB each.
READ_SEGMENTS = 16
#: Words of a generation in a worker's store, and bytes of the longest chunks that are kept.
CACHE_WORDS = 300_000
LONG = 100
#: Bytes of text that are encoded at once.
SLICE = 4_000_000


def vocabulary_size(tokenizer_path: str) -> int:
    """One more than the largest id of a tokenizer file, added tokens included."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that size; at least 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids of `width` bits each, least bit first, padded to a byte."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, width: int, count: int) -> np.ndarray:
    """The first `count` ids of a packed run, as uint32."""
    if width == 16:
        return np.frombuffer(packed, "<u2", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros((count, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def write_segment(documents: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    """The file image of some documents' ids."""
    ends = np.cumsum([len(d) for d in documents], dtype="<u8") if documents else np.zeros(0, "<u8")
    ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    blocks = [pack(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")[:-1]
    return b"".join([HEAD.pack(MAGIC, width, block, len(documents), len(ids)), ends.tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Segment:
    """Reads a segment of an open file from byte `at` on; ids(start, stop) reads and unpacks only the blocks of that range."""

    def __init__(self, file: pa.NativeFile, at: int = 0) -> None:
        magic, self.width, self.block, documents, self.size = HEAD.unpack(file.read_at(HEAD.size, at))
        if magic != MAGIC:
            raise ValueError("not a packed segment")
        self.file = file
        blocks = -(-self.size // self.block)
        numbers = np.frombuffer(file.read_at(8 * (documents + blocks), at + HEAD.size), "<u8").astype(np.int64)
        self.ends, self.offsets = numbers[:documents], numbers[documents:]
        self.body = at + HEAD.size + 8 * len(numbers)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.size:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        counts = [min(self.block, self.size - k * self.block) for k in range(first, last + 1)]
        starts = (self.offsets[first : last + 1] - self.offsets[first]).tolist()
        raw = self.file.read_at(starts[-1] + (counts[-1] * self.width + 7) // 8, self.body + int(self.offsets[first]))
        out = [unpack(raw[at : at + (n * self.width + 7) // 8], self.width, n) for at, n in zip(starts, counts, strict=True)]
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _runs(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of those sizes that make up ids, the runs `which`, one after the other, and where each begins; last where all end."""
    stops = np.append(0, np.cumsum(sizes[which]))
    shift = (np.cumsum(sizes) - sizes)[which] - stops[:-1]
    kind = np.int32 if max(stops[-1], len(ids)) < 1 << 31 else np.int64
    return ids[np.repeat(shift.astype(kind), sizes[which]) + np.arange(stops[-1], dtype=kind)], stops


class WordEncoder:
    """Encodes through the tokenizers library, each distinct chunk between ASCII white space once a slice.

    The tokenizer drops white space and none of its rules looks across it, so the
    ids of a text are those of its chunks in turn. Most chunks are letters and
    perhaps marks behind them, which the tokenizer splits there anyway; of those
    the letters are lower-cased and go to the same model many at a time, without
    the normalizer, which leaves them as they are; each word's last token bears
    the end-of-word suffix. Marks and all other chunks go through the whole tokenizer.

    Letters are kept in two generations: when there are more than `limit`, they become
    the earlier one, from which what comes up again is taken over. Chunks of over LONG
    bytes are never kept. Results don't depend on it.
    """

    #: letters that normalization only lower-cases, and marks that never join them
    PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.words_only = Tokenizer.from_str(json.dumps(spec))
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.limit = limit

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        lines = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.words_only.encode_batch_fast(lines, add_special_tokens=False)])
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _recall(self, words: list[str]) -> list[bytes]:
        """The ids of lower-cased letters, each given once."""
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if missing:
            again = list(map(self.earlier.get, missing))
            new = [w for w, ids in zip(missing, again, strict=True) if ids is None]
            learnt = iter(self._letters(new) if new else [])
            self.known.update((w, next(learnt) if ids is None else ids) for w, ids in zip(missing, again, strict=True))
            found = list(map(self.known.__getitem__, words))
        if len(self.known) > self.limit:
            self.earlier, self.known = self.known, {}
        return found

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8; null: none), one after the other, and where each text's end."""
        words = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        chunks = words.flatten().dictionary_encode()
        distinct = chunks.dictionary
        apart = pc.extract_regex(pc.if_else(pc.less_equal(pc.binary_length(distinct), LONG), distinct, None), self.PLAIN)
        letters = pc.utf8_lower(pc.struct_field(apart, "letters")).dictionary_encode()
        marks = pc.struct_field(apart, "marks").dictionary_encode()
        plain = letters.indices.is_valid().to_numpy(zero_copy_only=False)
        strings = lambda a: a.to_numpy(zero_copy_only=False).tolist()
        pieces = [*self._recall(strings(letters.dictionary)), *self._whole([*strings(marks.dictionary), *strings(distinct.filter(pa.array(~plain)))]), b""]
        # a chunk is letters and marks, or one piece of its own and an empty one
        n_letters, n_plain = len(letters.dictionary), len(letters.dictionary) + len(marks.dictionary)
        index = lambda a: a.indices.fill_null(0).to_numpy().astype(np.int64)
        first = np.where(plain, index(letters), n_plain + np.cumsum(~plain) - 1)
        second = np.where(plain, n_letters + index(marks), len(pieces) - 1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        ids, stops = _runs(np.frombuffer(b"".join(pieces), "<u4"), sizes, np.column_stack([first, second]).ravel())
        ids, stops = _runs(ids, np.diff(stops[::2]), chunks.indices.to_numpy())
        return ids, stops[words.offsets.to_numpy()[1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        ids, ends = self.encode_flat(pa.array(texts, pa.binary()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One per Python worker, kept from task to task."""
    return WordEncoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and ids (the end id last) of rows (key, raw text), in groups."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = _encoder(tokenizer_path)
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            ids, ends = encoder.encode_flat(b.column(1).slice(i, j - i))
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, j - i + 1)
            yield b.column(0).slice(i, j - i).to_pylist(), np.split(ids, ends[:-1])


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (uint32, the end id last), for every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _encoded(batches, tokenizer_path, end_id):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def open_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder that write_packed filled."""
    return spark.read.parquet(f"{folder}/manifest")


def write_packed(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes segments in ascending doc_id order and returns their manifest: part, segment, file, at, n_ids, doc_ids.

    Without a folder, a new one in the shared folder is taken. Texts are dealt out
    by ranges of doc_id before they are encoded: they are smaller than their ids,
    and nothing is encoded twice.
    """
    width = bits_for(vocabulary)
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[np.ndarray] = []
        size = segment = 0
        out = None
        name = f"{folder}/segments/{uuid.uuid4().hex}.bin"

        def put() -> pa.RecordBatch:
            nonlocal out
            if out is None:
                files, path = _open(name)
                files.create_dir(path.rpartition("/")[0])
                out = files.open_output_stream(path)
            at = out.tell()
            out.write(write_segment(held, width))
            columns = [pa.array([segment], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["segment", "file", "at", "n_ids", "doc_ids"])

        for some, encoded in _encoded(batches, tokenizer_path, end_id):
            for key, ids in zip(some, encoded, strict=True):
                keys.append(key)
                held.append(ids)
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield put()
                    keys, held, size, segment = [], [], 0, segment + 1
        last = [put()] if keys else []
        if out is not None:
            out.close()
        yield from last

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    # rows that share an id are spread by their texts, equal ones by where they were read
    order = [F.col("doc_id"), F.xxhash64("raw").alias("mix"), F.monotonically_increasing_id().alias("row")]
    ordered = slim.select(*order, "raw").repartitionByRange("doc_id", "mix", "row").sortWithinPartitions("doc_id", "mix", "row").select("doc_id", "raw")
    packed = ordered.mapInArrow(gather, "segment long, file string, at long, n_ids long, doc_ids array<long>")
    packed.withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/manifest")
    return open_packed(docs.sparkSession, folder)


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the packed files."""
    # one row per part (a range partition), whatever the input's size
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = manifest.select("part", "segment", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    starts = sizes.join(F.broadcast(parts), "part").select("part", "segment", (F.col("part_start") + F.col("before")).alias("segment_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                files, path = _open(row["file"])
                with files.open_input_file(path) as file:
                    s = Segment(file, row["at"])
                    ids = s.ids(0, s.size).astype("<u4")
                at = np.concatenate([[0], s.ends])
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                n = len(crcs)
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["segment_start"] + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "segment"])

    # the manifest is small beside the files it names: its rows are dealt out by number, not by size
    tasks = max(1, -(-manifest.count() // READ_SEGMENTS))
    dealt = manifest.join(starts, ["part", "segment"]).select("part", "segment", "file", "at", "doc_ids", "segment_start").repartition(tasks, "part", "segment")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, segment long")


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (uint32) of some documents; of the files only those documents' blocks are read."""
    wanted = sorted(set(doc_ids))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = set(wanted)
        for b in batches:
            for row in b.to_pylist():
                files, path = _open(row["file"])
                found = [k for k, key in enumerate(row["doc_ids"]) if key in sought]
                with files.open_input_file(path) as file:
                    s = Segment(file, row["at"])
                    ids = [s.document(k).tobytes() for k in found]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in found], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    holding = manifest.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)).cast("long") for i in wanted])))
    return holding.select("file", "at", "doc_ids").mapInArrow(read, "doc_id long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int = 1) -> DataFrame:
    """Encode, write packed, read back."""
    return read_packed(write_packed(docs, tokenizer_path, vocabulary, end_id))
