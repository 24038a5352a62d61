import random
import shutil
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomline.llm import bitpack, queries
from loomline.llm.common import documents

PATH = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_tokenizers_library(spark):
    got = queries.op8_bit_packed_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected([(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()])


def test_edge_rows(odd_docs, no_docs):
    got = bitpack.pack_documents(odd_docs, PATH, 49408).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == expected([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert bitpack.pack_documents(no_docs, PATH, 49408).collect() == []


@pytest.mark.parametrize("vocabulary", [2, 3, 257, 32000, 49408, 50257, 1 << 20, 1 << 32])
def test_round_trip_and_random_access(vocabulary):
    rnd = np.random.default_rng(vocabulary % 97)
    width = bitpack.bits_for(vocabulary)
    docs = [rnd.integers(0, vocabulary, n).astype("<u4") for n in (0, 1, 77, 5000, 0, 4096, 9)]
    s = bitpack.Segment(pa.BufferReader(b"before" + bitpack.write_segment(docs, width, 256)), 6)
    flat = np.concatenate(docs)
    assert s.width == width and (s.ids(0, s.size) == flat).all()
    for k, d in enumerate(docs):
        assert (s.document(k) == d).all()
    for _ in range(40):
        i, j = sorted(rnd.integers(0, len(flat) + 1, 2))
        assert (s.ids(int(i), int(j)) == flat[i:j]).all()


def test_small_word_store_changes_nothing():
    texts = [b"alpha beta gamma", b"", b"beta delta", b"alpha alpha"]
    assert bitpack.WordEncoder(PATH, 2).encode(texts) == bitpack.WordEncoder(PATH).encode(texts)


def test_ids_too_large_are_refused():
    with pytest.raises(ValueError):
        bitpack.write_segment([np.array([300], "<u4")], 8)


def test_word_paths_equal_the_whole_tokenizer():
    words = "Don't abc. ABC,, (x) l'été ÉCOLE!? naïve ß İstanbul été ΑΣ 12ab a1 a--b a-b. 's x's <|endoftext|> abc<|endoftext|> 漢字 ªº ÿ … a b \x01 _a_ ñ".split(" ")
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    e = bitpack.WordEncoder(PATH)
    for text in [*words, " ".join(words), "  ".join(reversed(words))]:
        assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_a_worker_loads_the_tokenizer_once_and_asks_for_each_word_once(tmp_path, monkeypatch):
    path = shutil.copy(PATH, tmp_path / "tokenizer.json")  # one that no other test has loaded
    loads, asked = [], []

    class Watching(bitpack.WordEncoder):
        def __init__(self, *given):
            loads.append(given)
            super().__init__(*given)

        def _letters(self, words):
            asked.extend(words)
            return super()._letters(words)

    monkeypatch.setattr(bitpack, "WordEncoder", Watching)
    rows = pa.record_batch([pa.array([1, 2]), pa.array([b"Alpha beta, (gamma)", b"alpha! BETA Alpha,"])], names=["doc_id", "raw"])
    for _ in range(2):  # two tasks of a worker
        got = [bytes(x) for _, ids in bitpack._encoded(iter([rows]), str(path), 1) for x in ids]
    assert len(loads) == 1 and sorted(asked) == ["alpha", "beta"]
    t = Tokenizer.from_file(PATH)
    assert got == [np.array(t.encode(x.decode(), add_special_tokens=False).ids + [1], "<u4").tobytes() for x in rows.column(1).to_pylist()]


def test_slices_long_chunks_and_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(bitpack, "SLICE", 40)
    monkeypatch.setattr(bitpack, "LONG", 6)
    rnd = random.Random(4)
    words = ["alpha", "Beta,", "été", "ÉTÉ!", "longerword", "LONGERWORD...", "(x)", "12", "\u00a0a", "e\u0301", "H\u0331a", "<|endoftext|>", "漢字", "a"]
    texts = [None if k % 9 == 4 else rnd.choice(["", " ", "\t\x0b"]) + "".join(w + rnd.choice([" ", "\n\n", "\x0c\r"]) for w in rnd.choices(words, k=k % 13)) for k in range(120)]
    monkeypatch.setattr(bitpack, "_encoder", lambda path: bitpack.WordEncoder(path, 2))
    rows = pa.record_batch([pa.array(range(len(texts))), pa.array([x if x is None else x.encode() for x in texts], pa.binary())], names=["doc_id", "raw"])
    got = [(key, x.tolist()) for keys, ids in bitpack._encoded(iter([rows, rows.slice(7, 0), rows.slice(50, 9)]), PATH, 1) for key, x in zip(keys, ids, strict=True)]
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    wanted = [(k, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for k, x in enumerate(texts)]
    assert got == wanted + wanted[50:59]


def test_documents_are_read_from_storage_by_id(spark, odd_docs):
    assert bitpack.vocabulary_size(PATH) == 49408
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stored = bitpack.write_packed(docs, PATH, bitpack.vocabulary_size(PATH), 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = sorted(texts)[3:60:7]
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bitpack.read_documents(stored, [*some, -5]).collect()}
    assert got == {k: [*t.encode(texts[k] or "", add_special_tokens=False).ids, 1] for k in some}
    assert bitpack.read_documents(bitpack.write_packed(odd_docs, PATH, 49408, 1), [5]).count() == 2


class Watched:
    """An open file that notes how many bytes were asked of it."""

    def __init__(self, file):
        self.file, self.asked = file, 0

    def read_at(self, size, at):
        self.asked += size
        return self.file.read_at(size, at)


def test_files_are_read_by_block(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = bitpack.write_packed(docs, PATH, 49408, 1, f"file://{tmp_path}/ids")
    assert bitpack.open_packed(spark, f"file://{tmp_path}/ids").count() == whole.count() > 0
    named = {r["file"].removeprefix("file://") for r in whole.collect()}
    assert named == {str(p) for p in (tmp_path / "ids/segments").iterdir()}
    row = max(whole.collect(), key=lambda r: r["n_ids"])
    with pa.OSFile(row["file"].removeprefix("file://")) as file:
        s = bitpack.Segment(Watched(file), row["at"])
        s.file.asked = 0
        middle = s.size // 2
        s.ids(middle, middle + 1)
        assert s.file.asked == bitpack.BLOCK * 2 < 2 * s.size
    # a file that no manifest names, as a lost attempt leaves behind, changes nothing
    (tmp_path / "ids/segments/lost.bin").write_bytes(b"half")
    assert bitpack.read_packed(whole).count() == docs.count()


def test_one_id_of_many_rows_lies_in_several_files(spark):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "concat('word ', id % 1000) AS text").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = bitpack.write_packed(docs, PATH, 49408, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert stored.select("file").distinct().count() > 1
    got = [r for r in bitpack.read_packed(stored).orderBy("start").collect()]
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert len(got) == 4000 and [r["start"] for r in got] == [0, *ends[:-1]]
