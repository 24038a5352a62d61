import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from loomline.llm import bpe, queries
from loomline.llm.common import documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def engine():
    return bpe.PrefixBPE(bpe.load_ranks(PATH))


def test_query_equals_the_tiktoken_library(spark, reference):
    got = {r["doc_id"]: r for r in queries.op2_prefix_bpe(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = reference.encode_ordinary(text or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_edge_rows(odd_docs, no_docs, reference):
    rows = bpe.encode_column(odd_docs, PATH, P.PATTERN).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"], tuple(r["ids"])) for r in rows if r["doc_id"]) == sorted(
        (False, r["doc_id"], tuple(reference.encode_ordinary(r["text"] or ""))) for r in odd_docs.collect() if r["doc_id"]
    )
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for t in texts)
    assert bpe.encode_digests(no_docs, PATH, P.PATTERN).collect() == []


def test_random_pieces_equal_merging(engine):
    rnd = random.Random(5)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdethen éñß漢🙂 ") for _ in range(rnd.randint(1, 40))).encode()
        expected = [engine.ranks[piece]] if piece in engine.ranks else engine.merge(piece)
        assert engine.encode_piece(piece) == expected


def test_pairs_equal_merging(engine):
    rnd = random.Random(7)
    ids = list(engine.reachable.values())
    common = [i for i in ids if i < 3000]
    for k in range(20000):
        a, b = rnd.choice(common if k % 2 else ids), rnd.choice(common if k % 3 else ids)
        assert engine.follows(a, b) == (engine.merge(engine.tokens[a] + engine.tokens[b]) == [a, b]), (engine.tokens[a], engine.tokens[b])


def test_reachable_tokens_encode_to_themselves(engine):
    assert engine.reachable == {t: r for t, r in engine.ranks.items() if engine.merge(t) == [r]}


def test_appends_and_edits_equal_encoding_anew(engine):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("thenandi ") for _ in range(n)).encode()
    for _ in range(20):
        text = bpe.EditableText(engine, word(200))
        for _ in range(6):
            text.append(word(rnd.randint(0, 10)))
            i = rnd.randint(0, len(text.data))
            text.replace(i, min(len(text.data), i + rnd.randint(0, 8)), word(rnd.randint(0, 8)))
            assert text.ids() == engine.merge(text.data)


def test_edits_stop_early(engine):
    data = b"the quick brown fox " * 2000
    text = bpe.EditableText(engine, data)
    before = text.computed
    text.replace(100, 103, b"cat")
    assert text.computed - before < 20 * engine.longest
    assert text.ids() == bpe.EditableText(engine, text.data).ids()
