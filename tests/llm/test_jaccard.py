import random

import numpy as np
import pytest

from loomline.llm import jaccard


def brute_force(rows):
    """doc_id -> (set size, least doc_id reachable), over all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key is None, key, len(sets[i]), least.get(root(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def noisy_texts(seed, n):
    """Bases with copies of growing distance, chains of links, and a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rnd.choice([1, 3, 6, 9, 14, 30, 60, 120]))]
        if rnd.random() < 0.4:
            at = rnd.randint(0, len(base))
            base = base[:at] + passage + base[at:]
        for _ in range(rnd.choice([1, 1, 2, 8])):
            out.append(" ".join(base) if rnd.random() < 0.8 else " ".join(base).upper())
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                base[rnd.randrange(len(base))] = word()
            if rnd.random() < 0.3:
                base = base + [word() for _ in range(rnd.randint(1, 6))]
    return out[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = noisy_texts(seed, 500)
    rows = [(i * 7 % 503, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.link_components(df)) == brute_force(rows)


def test_edge_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(jaccard.link_components(odd_docs)) == brute_force(rows)
    assert jaccard.link_components(no_docs).collect() == []


def test_sets_without_cover_are_compared_with_their_band(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "segments_of", lambda band: 1)
    some = np.arange(1, 21).astype(np.uint64)
    _, _, uncovered = jaccard.Signatures(some[:0], np.zeros(0)).of(some)
    own = int(np.searchsorted(jaccard.BAND_STARTS, 20, "right")) - 1
    assert own in uncovered
    nodes = spark.createDataFrame([(1, 20, 1, 0, 0, 0, 7), (2, 20, 2, 0, 0, 0, 0), (3, 21, 3, 0, 0, 0, 6), (4, 900, 4, 0, 0, 0, 7), (5, 20, 5, -1, 0, 0, 7)], "node long, n long, doc_id long, s0 long, s1 long, s2 long, s3 long")
    members = spark.createDataFrame([(own, 1, 4)], "key long, node long, role byte")
    assert sorted(tuple(r) for r in jaccard._uncovered(members, nodes).collect()) == [(1, 2), (1, 3)]


def test_every_link_shares_a_bucket_with_fitting_roles():
    """The pigeonhole argument on sets at the limit, with and without frequent elements."""
    rnd = np.random.default_rng(4)
    universe = np.sort(rnd.integers(0, 2**64, 4000, np.uint64))
    for trial in range(400):
        y = int(rnd.choice([1, 2, 3, 4, 5, 7, 8, 12, 20, 40, 90, 200, 500]))
        a = np.sort(rnd.choice(universe, y, replace=False))
        drop = int(rnd.integers(0, y // 4 + 1))
        b = np.union1d(rnd.permutation(a)[drop:], rnd.choice(universe, int(rnd.integers(0, y // 7 + 1))))
        if not jaccard.linked(a, b):
            continue
        hot = universe[::3] if trial % 2 else universe[:0]
        sides = []
        for s in (a, b):
            keys, roles, uncovered = jaccard.Signatures(hot, np.full(len(hot), 1000)).of(s)
            sides.append({(int(k), 1) for ks, r in zip(keys, roles, strict=True) for k in ks if r & 1} | {(int(k), 2) for ks, r in zip(keys, roles, strict=True) for k in ks if r & 2})
            if uncovered:
                break
        else:
            small, large = (0, 1) if len(a) <= len(b) else (1, 0)
            assert any((k, 1) in sides[small] for k, r in sides[large] if r == 2), (len(a), len(b))


def test_hashes_follow_words_not_spacing():
    s = jaccard.Shingler()
    one, two, none, short = s.sets([b"A b  c\td e f", b"a B c d e\nf", b" \n", b"x y"])
    assert (one == two).all() and len(one) == 2 and len(none) == 0 and len(short) == 1
    assert jaccard.fingerprint(one) == jaccard.fingerprint(two) != jaccard.fingerprint(short)
    many = [b"word%d " % i * 3 for i in range(50)]
    assert all((x == y).all() for x, y in zip(s.sets(many), [jaccard.Shingler().sets([m])[0] for m in many], strict=True))


def test_sketches_never_differ_more_than_sets():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 2**64, int(rnd.integers(1, 300)), np.uint64))
        b = np.union1d(a[int(rnd.integers(0, len(a))) :], rnd.integers(0, 2**64, int(rnd.integers(0, 60)), np.uint64))
        apart = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (jaccard.sketch(a[::-1]) == jaccard.sketch(a)).all()


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def test_links_equal_brute_force(spark, odd_docs, no_docs):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in rnd.sample(range(80), 40)]  # a group in which most pairs already lie in one component
    texts = noisy_texts(3, 300) + near + near[:7]
    rows = [(i * 7 % 503, t) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for _, t in rows]
    linked = lambda x, y: bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted((key, len(x), sum(linked(x, y) for y in sets) - bool(x)) for (key, _), x in zip(rows, sets, strict=True))
    assert sorted(map(tuple, jaccard.count_links(df).collect())) == expected

    by_set = {}
    for (key, _), x in zip(rows, sets, strict=True):
        by_set.setdefault(x, []).append(key)
    classes = [(min(ids), len(ids), x) for x, ids in by_set.items() if x]
    wanted = {frozenset({(a, m), (b, n)}) for i, (a, m, x) in enumerate(classes) for b, n, y in classes[:i] if linked(x, y)}
    got_pairs = jaccard.link_pairs(df).collect()
    assert {frozenset({(r["doc_a"], r["copies_a"]), (r["doc_b"], r["copies_b"])}) for r in got_pairs} == wanted and len(got_pairs) == len(wanted)

    odd = [shingle_set(r["text"]) for r in odd_docs.collect()]
    counts = sorted(sum(linked(x, y) for y in odd) - bool(x) for x in odd)
    assert sorted(r["n_links"] for r in jaccard.count_links(odd_docs).collect()) == counts
    assert jaccard.count_links(no_docs).collect() == [] and jaccard.link_pairs(no_docs).collect() == []


def candidates_of(spark, monkeypatch, texts):
    """Pairs that link_components verifies."""
    seen = []
    links = jaccard._Verifier.links

    def counted(self, pairs):
        pairs = jaccard.materialise(pairs)
        seen.append(pairs.count())
        return links(self, pairs)

    with monkeypatch.context() as m:
        m.setattr(jaccard._Verifier, "links", counted)
        rows = [(i, t) for i, t in enumerate(texts)]
        assert got(jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)
    return sum(seen)


def test_candidates_follow_the_size_of_hot_groups(spark, monkeypatch):
    """A group of near copies at all distances around the limit, and holders of a long common passage."""
    rnd = random.Random(8)
    base, passage = [f"w{i}" for i in range(150)], [f"p{i}" for i in range(120)]

    def group(n):
        near = [" ".join(f"x{i}_{k}" if k in edits else w for k, w in enumerate(base)) for i in range(n) for edits in [set(rnd.sample(range(150), rnd.randint(1, 7)))]]
        return near + [" ".join(passage + [f"h{i}_{k}" for k in range(rnd.randint(30, 60))]) for i in range(n)]

    few, many = candidates_of(spark, monkeypatch, group(60)), candidates_of(spark, monkeypatch, group(240))
    assert many <= 6 * few + 200 and many < 240 * 12


def test_rows_without_ids_meet_their_own_texts_only(spark):
    rows = [(None, t) for t in noisy_texts(6, 60)] + [(7, t) for t in noisy_texts(7, 60)]
    assert got(jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)
