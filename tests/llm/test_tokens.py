"""Token counts of prefixes, fill-in-the-middle and tokenizer alignment: against the libraries and plain loops."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import alignment, fim, queries, token_counts

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: What splits otherwise in a prefix than in the whole: spaces, contractions, special tokens, code points of disputed class.
BITS = [" ", "  ", "\n", "\n\n", "\t", "a", "the", " word", "'re", "'ve", "'ll", "'s", "'", "!", "!!", "1", "23", "<|endoftext|>", "<|endof", "|>", "é", "日本", "　", "\U00010940", "՘", "😀", "don't", "x" * 40, " " * 17, "\r\n", "\x1c", "\x85", "İ"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(BYTE_BPE)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    return ["", *("".join(rnd.choices(BITS, k=rnd.randint(1, 12))) for _ in range(400))]


def test_every_prefix_has_the_count_of_the_library(counter, library, texts):
    rnd = random.Random(5)
    for text in texts:
        table = token_counts.TokenTable(counter, text)
        wanted = [library(text[:i]) for i in range(len(text) + 1)]
        assert table.counts().tolist() == wanted, text
        i = rnd.randint(0, len(text))
        assert table.of_prefix(i) == wanted[i]
        for budget in (-1, 0, 1, 2, 4, 9):
            assert table.longest_prefix(budget) == max([i for i, n in enumerate(wanted) if n <= budget], default=0), (text, budget)
        grown = token_counts.TokenTable(counter, text[:i])
        grown.append(text[i:])
        assert grown.counts().tolist() == wanted and grown.n_tokens == wanted[-1], text


def test_a_small_store_of_pieces_gives_the_same_counts(library, texts):
    small = token_counts.PrefixCounter(BYTE_BPE, cache_bytes=2000)
    for text in texts[:100]:
        assert token_counts.TokenTable(small, text).counts()[-1] == library(text)


def test_an_append_counts_only_what_is_new(counter):
    table = token_counts.TokenTable(counter, "some words of a text " * 5000)
    seen = []
    cut = counter.cut
    counter.cut = lambda text: seen.append(len(text)) or cut(text)
    try:
        table.append("and more")
    finally:
        del counter.cut
    assert max(seen) < 60


def test_count_documents(spark, library, odd_docs, no_docs):
    whole = queries.QUERIES["op11_prefix_token_counts"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(whole) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"].fillna("")):
        row, n = whole.loc[doc_id], library(text)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 512)
        assert library(text[: row["kept_chars"]]) <= 512 and (n > 512 or row["kept_chars"] == len(text))
    odd = token_counts.count_documents(odd_docs, BYTE_BPE, 512).collect()
    assert len(odd) == odd_docs.count() and {r["n_tokens"] for r in odd if r["doc_id"] in (2, 3)} == {0}
    assert next(r for r in odd if r["doc_id"] == 6)["n_tokens"] == library(next(r for r in odd_docs.collect() if r["doc_id"] == 6)["text"])
    assert token_counts.count_documents(no_docs, BYTE_BPE, 512).count() == 0


def test_stored_tables_answer_without_encoding(spark, odd_docs, library):
    stored = token_counts.prefix_tables(odd_docs, BYTE_BPE)
    asked = stored.select("doc_id", token_counts.chars_within(F.lit(5)).alias("chars"), token_counts.tokens_of_prefix(F.lit(7)).alias("n"), token_counts.tokens_of_prefix(F.lit(10**6)).alias("past")).collect()
    by_id = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in asked:
        text = by_id[r["doc_id"]]
        assert r["chars"] == max(i for i in range(min(len(text), 60) + 1) if library(text[:i]) <= 5) and r["past"] is None
        assert r["n"] == (library(text[:7]) if len(text) >= 7 else None)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_wavelet_ranks():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rnd.integers(0, 6, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols, fim.LEVELS)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]


@pytest.mark.parametrize(("unit", "pattern"), [("token", TOKEN), ("line", re.compile(r"[^\n]*\n|[^\n]+"))])
def test_cuts_end_units(unit, pattern):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("ab \n\té\x00\x85日", k=rnd.randint(0, 30))) for _ in range(500)]
    index = fim.UnitIndex(texts, unit)
    units = [pattern.findall(t) for t in texts]
    assert index.counts.tolist() == list(map(len, units))
    for share in (0, 0.3, 0.7, 1):
        k = np.array([round(share * len(u)) for u in units])
        assert index.cut(k).tolist() == [len("".join(u[:n])) for u, n in zip(units, k, strict=True)]


def by_the_contract(doc_id, text):
    """One document, in plain code."""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 80:
        return len(units), "spm", len(a), len(b), sha("<S>" + c + "<P>" + a + "<M>" + b), sha(text)
    return len(units), "psm", len(a), len(b), sha("<P>" + a + "<S>" + c + "<M>" + b), sha(text)


def test_transform(spark, odd_docs, no_docs):
    more = [(100 + i, t) for i, t in enumerate(["<P> a <S>", "<M>", "a<", "<<<", "x <P", " ", "\n\n", "P> a <S b M>"] * 12)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = sorted(map(tuple, fim.transform_digests(docs).collect()), key=repr)
    assert rows == sorted(((r["doc_id"], *by_the_contract(r["doc_id"], r["text"] or "")) for r in docs.collect()), key=repr)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    full = fim.transform(docs).collect()
    assert sorted(sha(r["output"]) for r in full) == sorted(r[5] for r in rows)
    assert fim.transform_digests(no_docs).count() == fim.transform(no_docs).count() == 0
    lines = fim.transform(docs, fim.Rates(100, 0), "line").collect()
    assert all(fim.restore(r["output"], r["form"]) in {x["text"] or "" for x in docs.collect()} for r in lines)


def test_transform_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine = queries.QUERIES["op12_fill_in_middle"](spark, SF)
    names = sorted(mine.columns)
    assert sorted(map(tuple, mine.select(names).collect())) == sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({fim.ORACLE})").fetchall())


def aligned_by_loops(rows):
    """doc_id and text of each row to its results, from byte ranges and nothing else."""
    a_side = Tokenizer.from_file(BYTE_BPE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sides = alignment.Sides(BYTE_BPE, PIECES)
    done, counts = [], Counter()

    def ranges(tokens):
        at = 0
        for t in tokens:
            yield at, at + len(t)
            at += len(t)

    for doc_id, text in rows:
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        bytes_a, bytes_b = [sides.bytes_a[i] for i in a], [sides.bytes_b[i] for i in b]
        if not text or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
            done.append((doc_id, [], [], [], ""))
            continue
        spans_a, spans_b = list(ranges(bytes_a)), list(ranges(bytes_b))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans_a) for j, (u, v) in enumerate(spans_b) if s < v and u < e]
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        of = lambda ids, spans, low, high: ",".join(str(i) for i, (s, e) in zip(ids, spans, strict=True) if low <= s and e <= high)
        groups = [f"{of(a, spans_a, low, high)}|{of(b, spans_b, low, high)}" for low, high in zip([0, *cuts], cuts)]
        counts.update(links)
        done.append((doc_id, a, b, links, ";".join(groups)))
    best: dict = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (doc_id, len(a), len(b), groups.count("|") if a else 0, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha(groups) if a else "")
        for doc_id, a, b, links, groups in done
    ]


def test_alignment_equals_loops(spark, odd_docs, no_docs, monkeypatch):
    rnd = random.Random(8)
    bits = BITS + ["▁", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "\x00", " the", "ing", " ", " ", " (", ". ", "\xad", " é", ".", "&&", "×", "×.", "c.", "ä?", "$$$", "a\n", "Z"]
    made = ["".join(rnd.choices(bits, k=rnd.randint(0, 12))) for _ in range(1500)]
    docs = odd_docs.filter("doc_id IS NULL OR doc_id <> 4").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(made, 50)), "doc_id long, text string"))
    wanted = sorted(map(repr, aligned_by_loops([(r["doc_id"], r["text"] or "") for r in docs.collect()])))
    assert sorted(repr(tuple(r)) for r in alignment.align_documents(docs, BYTE_BPE, PIECES).collect()) == wanted
    assert any("0, 0, 0, 0, 0, 0, ''" in w for w in wanted)
    monkeypatch.setattr(alignment, "BLOCK_PLACES", 30)  # many blocks
    assert sorted(repr(tuple(r)) for r in alignment.align_documents(docs.repartition(3), BYTE_BPE, PIECES).collect()) == wanted
    assert alignment.align_documents(no_docs, BYTE_BPE, PIECES).count() == 0
    with_long = {r["doc_id"]: r for r in alignment.align_documents(odd_docs, BYTE_BPE, PIECES).collect()}
    assert with_long[4]["n_a"] > 20000 and with_long[3]["groups_sha256"] == ""


def test_cuts_and_links_of_ends():
    rnd = random.Random(2)
    for _ in range(300):
        total = rnd.randint(1, 12)
        ends = lambda: [*sorted(rnd.sample(range(1, total), rnd.randint(0, total - 1))), total]
        a, b = ends(), ends()
        start = lambda x, k: x[k - 1] if k else 0
        wanted = [(i, j) for i in range(len(a)) for j in range(len(b)) if start(a, i) < b[j] and start(b, j) < a[i]]
        _, of_a, of_b = alignment.expand_links(np.array(a), np.array(b))
        assert list(zip(of_a.tolist(), of_b.tolist())) == wanted
        shared, up_a, up_b = alignment.common_cuts(a, b)
        assert shared == sorted(set(a) & set(b)) and [a[k - 1] for k in up_a] == [b[k - 1] for k in up_b] == shared


def test_alignment_query(spark):
    docs = [(r["doc_id"], (r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [d for d in docs if len(d[1]) < 3000]
    found = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_tokenizer_alignment"](spark, SF).collect()}
    assert len(found) == len(docs)
    wanted = {w[0]: w for w in aligned_by_loops(short)}
    for doc_id, w in wanted.items():  # counts depend on all documents; the rest is each document's own
        assert found[doc_id][1:5] == w[1:5] and found[doc_id][7] == w[7] and found[doc_id][6] >= w[6]


def test_alignment_writes_small_rows(spark):
    """Readers hold thousands of rows at once, so no row is a whole block; the rows of a block make it up again."""
    texts = [f"word{i % 700} stands{i % 31} by number {i}, {'ab ' * (i % 50)}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = alignment.align_blocks(docs, BYTE_BPE, PIECES)
    rows = blocks.toArrow()
    assert rows.num_rows > 20 and rows.nbytes / rows.num_rows < 2 * alignment.SLICE_BYTES
    assert max(rows.slice(k, 1).nbytes for k in range(rows.num_rows)) < 4 * alignment.SLICE_BYTES
    got = {r["doc_id"]: r for r in alignment.scores(blocks, alignment.pair_counts(blocks)).collect()}
    assert sorted(got) == list(range(3000))
    links = sum(r["n_links"] for r in got.values())
    assert links == alignment.pair_counts(blocks).selectExpr("sum(n)").first()[0] > 0
