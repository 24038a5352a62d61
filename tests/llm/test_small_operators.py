"""Sharding, line frequency, WARC, media, packing, toxicity and language ID on small inputs."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import jaccard, langid, line_frequency, media, packing, queries, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    expected = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(expected.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(str).values.tolist()))
    assert rows(mine.toPandas()) == rows(expected)


# sharding


def test_shards_are_gapless_and_grow_only_into_the_new_one(spark):
    rows = queries.op1_hash_tree_sharding(spark, SF).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 8 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_weights_decide_shares_and_changes_stay_inside_changed_subtrees(spark):
    before = sharding.Topology({"a": {"a1": {0: 1.0, 1: 3.0}, "a2": {2: 2.0}}, "b": {"b1": {3: 2.0}, "b2": {4: 2.0}}})
    after = sharding.Topology({"a": {"a1": {0: 1.0, 1: 6.0}, "a2": {2: 2.0}}, "b": {"b1": {3: 2.0}, "b2": {4: 2.0}}})
    df = sharding.place(sharding.place(spark.range(20000).withColumnRenamed("id", "doc_id"), "doc_id", before, "x"), "doc_id", after, "y")
    moved = {(r["x"], r["y"]): r["count"] for r in df.groupBy("x", "y").count().collect()}
    shares = np.array([sum(n for (x, _), n in moved.items() if x == s) for s in range(5)]) / 20000
    assert np.abs(shares - np.array([0.1, 0.3, 0.2, 0.2, 0.2])).max() < 0.02
    region = lambda s: s in (3, 4)
    assert not any(x != y and region(x) and region(y) for x, y in moved)  # nothing moves inside the unchanged region
    assert not any(x != y and region(y) for x, y in moved)  # or into it, as only the other one gained weight


def test_sharding_edge_rows(odd_docs, no_docs):
    tree = sharding.Topology.even(8)
    rows = sharding.shard_documents(odd_docs, tree).collect()
    assert len(rows) == odd_docs.count() and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1 and all(r["grown_shard"] is None for r in rows)
    assert sharding.shard_documents(no_docs, tree).collect() == []
    with pytest.raises(ValueError):
        sharding.Topology({"a": {"b": {0: 0.0}}})


def test_descent_equals_brute_force(spark):
    tree = sharding.Topology({"a": {"a0": {0: 1.0, 1: 3.0}, "a1": {2: 0.5}}, "b": {"b0": {3: 2.0}}})

    def draw(node, key, weight):
        seed = xxhash.xxh64_intdigest(node.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed) if key is not None else seed
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def shard(key):
        total = lambda racks: sum(sum(x.values()) for x in racks.values())
        region = min(tree.regions, key=lambda r: draw(r, key, total(tree.regions[r])))
        racks = tree.regions[region]
        rack = min(racks, key=lambda k: draw(k, key, sum(racks[k].values())))
        return min(racks[rack], key=lambda x: draw(str(x), key, racks[rack][x]))

    keys = [None, -1, 0, *range(1, 2000, 3), 2**60 + 1]
    rows = sharding.place(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", tree, "shard").collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {k: shard(k) for k in keys}


# line frequency


def test_line_rules_on_edge_rows(odd_docs, no_docs):
    rows = line_frequency.quality_by_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[4]["n_repeat_words"] == 20000 and not by[4]["kept"]
    assert by[1]["kept"] and by[5]["kept"]
    assert line_frequency.quality_by_lines(no_docs).collect() == []


def test_frequent_lines_are_removed_by_host(spark):
    own = "one%d two three four five six seven eight nine ten%d"
    docs = [(i, f"{own % (i, i)}\nSHARED   line of the host", "h") for i in range(6)]
    docs += [(10, "shared line of the host\n" * 3 + own % (10, 10), "other"), (11, "shared line of the host", "h"), (12, "shared line of the host\nshared Line of the host eleven words are now here for sure", "h")]
    rows = {r["doc_id"]: r for r in line_frequency.quality_by_lines(spark.createDataFrame(docs, "doc_id long, text string, source string"), 5).collect()}
    assert [rows[i]["removed_words"] for i in (0, 10, 11, 12)] == [5, 0, 5, 5]
    assert rows[0]["kept"] and rows[12]["kept"] and not rows[11]["kept"]


@pytest.mark.parametrize("name", ["op4_line_frequency"])
def test_oracle_with_repeated_rows(spark, name):
    """Copies of a row that share id, host and text get what the row gets alone."""
    text = "shared line of the host\none two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text + "\nShared line of the host", "h")] * 3 + [(1, text, "h")] * 4 + [(2, text, "h"), (3, text, None), (3, text, None), (None, text, "h"), (None, text, "h")] + [(10 + i, f"shared line of the host\nown{i} " + "w " * 12, "h") for i in range(25)] + [(4, None, "h")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    show = lambda found: sorted(found, key=str)
    got = [tuple(r) for r in line_frequency.quality_by_lines(df).collect()]
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert show(got) == show(con.execute(line_frequency.ORACLE).fetchall())
    assert {(r[8], r[7]) for r in got if r[0] in (1, 2)} == {(5, True)} and {r[8] for r in got if r[0] == 5} == {10} and len(got) == len(rows)


# WARC


def raw(kind, mark, url, when, http):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {mark}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {when}\r\n\r\n{http}".encode()


def test_revisits_find_the_latest_earlier_response(spark):
    ok = lambda etag, body: f"HTTP/1.1 200 OK\r\nETag: {etag}\r\nServer: one\r\nX-Long: a\r\n b\r\n\r\n{body}"
    not_modified = lambda etag: f"HTTP/1.1 304 Not Modified\r\nETag: {etag}\r\nServer: two\r\nExpires: soon\r\n\r\n"
    rows = [
        raw("response", "a", "http://Host.org:80/x/?utm_source=1#f", "2024-01-01T00:00:00Z", ok("1", "first")),
        raw("response", "b", "https://host.org/x", "2024-01-02T00:00:00Z", ok("2", "second")),
        raw("revisit", "c", "https://host.org/x/", "2024-01-03T00:00:00Z", not_modified("2")),
        raw("revisit", "d", "https://host.org/x", "2024-01-01T12:00:00Z", not_modified("1")),
        raw("revisit", "e", "https://host.org/x", "2024-01-04T00:00:00Z", not_modified("1")),
        raw("revisit", "f", "https://host.org/x", "2023-01-04T00:00:00Z", not_modified("1")),
        raw("revisit", "g", "https://host.org/x", "never", not_modified("1")),
        raw("revisit", "h", "https://host.org/x", "2024-01-05T00:00:00Z", "HTTP/1.1 304 Not Modified\r\n\r\n"),
        b"", b"garbage", None,
    ]
    df = spark.createDataFrame([(r,) for r in rows], "raw binary")
    got = {r["record_id"]: r for r in warc.resolve_revisits(warc.parse_records(df)).collect()}
    assert {k: (r["status"], r["refers_to"]) for k, r in got.items()} == {
        "c": ("resolved", "b"), "d": ("resolved", "a"), "e": ("validators-differ", None), "f": ("no-earlier-response", None), "g": ("unaddressed", None), "h": ("no-validator", None),
    }
    assert got["c"]["headers"] == "etag: 2\nexpires: soon\nserver: one\nx-long: a b"
    assert got["c"]["digest"] == "sha256:" + hashlib.sha256(b"second").hexdigest()
    assert warc.resolve_revisits(warc.parse_records(df.limit(0))).collect() == []


def test_responses_without_a_time_or_url_resolve_nothing(spark):
    ok, again = "HTTP/1.1 200 OK\r\nETag: 1\r\n\r\nbody", "HTTP/1.1 304 Not Modified\r\nETag: 1\r\n\r\n"
    rows = [raw("response", "a", "http://h/x", "never", ok), raw("revisit", "b", "http://h/x", "2024-01-03T00:00:00Z", again), b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: c\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n\r\n" + ok.encode()]
    rows.append(b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: d\r\nWARC-Date: 2024-01-04T00:00:00Z\r\n\r\n" + again.encode())
    got = warc.resolve_revisits(warc.parse_records(spark.createDataFrame([(r,) for r in rows], "raw binary"))).collect()
    assert {r["record_id"]: r["status"] for r in got} == {"b": "no-earlier-response", "d": "unaddressed"}


def test_hot_url_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(str(i).zfill(4), "response" if i % 50 == 7 else "revisit", "http://h/p" if i % 3 else f"http://h/{i % 11}", i, 200 if i % 50 == 7 else 304, "t") for i in range(900)]
        df = spark.createDataFrame(rows, "record_id string, kind string, url string, captured_at long, http_status int, etag string").selectExpr(
            "record_id", "kind", "url", "timestamp_seconds(captured_at) captured_at", "http_status", "etag", "string(null) last_modified", "string(null) digest", "map('etag', etag) headers"
        )
        got = {r["record_id"]: r["source"]["record_id"] if r["source"] else None for r in warc.last_full_response(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    latest = {}
    for mark, kind, url, *_ in rows:
        assert got[mark] == latest.get(url)
        if kind == "response":
            latest[url] = mark


# media


def test_media_round_trip(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_interleaved_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.pad(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload)) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.to_pgm(payload)).hexdigest() and r["media_bytes"] == len(media.to_pgm(payload))


def test_media_edge_rows(odd_docs, no_docs):
    rows = media.document_media(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r["payload_bytes"] for r in rows if r["doc_id"] in (2, 3)} == {64}
    assert media.document_media(no_docs).collect() == []


def test_pages_interleave_text_and_media():
    items = media.interleave('<p>One &amp; two</p><script>no</script><figure><img src="sha256:d1" alt="old"><figcaption>New <b>cap</b></figcaption></figure>tail<img src="d2" alt="two">')
    assert [(i["position"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [(0, "text", "One & two", None), (1, "media", "d1", "New cap"), (2, "text", "tail", None), (3, "media", "d2", "two")]
    assert media.interleave(None) == [] == media.interleave("")


def test_malformed_html():
    shown = lambda html: [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in media.interleave(html)]
    for odd in ("<![foo[x]]>", "<![ ", "<!", "</", "<img src=", "<![CDATA[x", "&#xZZ;", "<figcaption>", "</figure></figcaption>"):
        media.interleave(odd)
        assert ("text", "after", None) in shown(f"{odd}>\"'><p></p>after") or "after" in str(shown(f"{odd}>\"'><p></p>after"))
    assert shown('<figure><figcaption>Cap</figcaption><img src="a"><img src="b" alt="x"></figure>z') == [("media", "a", "Cap"), ("media", "b", "Cap"), ("text", "z", None)]
    assert shown('<figure><img src="a"><figcaption>Cap</figure>tail') == [("media", "a", "Cap"), ("text", "tail", None)]
    assert shown('<figure><img src="a"><figcaption>Cap <p>tail</p>more') == [("media", "a", "Cap"), ("text", "tail", None), ("text", "more", None)]
    assert shown('<figure><img src="a"><figcaption><p>Cap</p></figcaption></figure>t') == [("media", "a", "Cap"), ("text", "t", None)]


def test_page_sequences_equal_the_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r["page_id"]: r for r in queries.op6_page_sequences(spark, SF).collect()}
    for p in pages.collect():
        items = media.interleave(p["html"])
        words = sum(len(i["text"].split(" ")) for i in items if i["kind"] == "text")
        lines = "\n".join("|".join((i["kind"], i["text"] or i["digest"] or "", i["caption"] or "")) for i in items)
        r = rows[p["page_id"]]
        assert (r["n_text"] + r["n_media"], r["n_words"], r["sequence_sha256"]) == (len(items), words, hashlib.sha256(lines.encode()).hexdigest())
    odd = spark.createDataFrame([(None, "<p>x"), (1, None), (2, ""), (2, "")], "page_id long, html string")
    assert sorted((r["n_text"], r["n_words"]) for r in media.page_sequences(odd).collect()) == [(0, 0)] * 3 + [(1, 1)]


def test_unknown_digests_keep_their_place(spark):
    pages = spark.createDataFrame([(1, '<img src="x"><p>a</p><img src="y">'), (2, None)], "id long, html string")
    store = spark.createDataFrame([("y", "Y")], "digest string, body string")
    rows = media.resolve(media.references(media.parse_pages(pages, "id", "html")), store).orderBy("position").collect()
    assert [(r["page_key"], r["position"], r["body"]) for r in rows] == [(1, 0, None), (1, 2, "Y")]


# packing


def slow_best_fit(lengths, sources, clusters, capacity):
    bins, where = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and c not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        where.append(i)
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return where


def test_best_fit_equals_a_search_of_all_bins():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        n = 120
        lengths = sorted(rnd.integers(0, 100, n).tolist(), reverse=True)
        sources = [None if x == 9 else int(x) for x in rnd.choice(10, n, p=[0.33, *[0.67 / 9] * 9])]
        clusters = rnd.integers(0, 60, n).tolist()
        assert packing.best_fit(lengths, sources, clusters, 100)[0] == slow_best_fit(lengths, sources, clusters, 100)


def test_packing_places_everything_without_conflict(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, capacity in ((docs, 512), (odd_docs, 2048)):
        rows = packing.pack_documents(df, capacity, 50).collect()
        words = sorted(len((r["text"] or "").encode().split()) for r in df.collect())
        assert sum(r["length"] for r in rows) == sum(words)
        assert sum(r["piece"] == 0 for r in rows) == df.count()
        bins = {}
        for r in rows:
            bins.setdefault(r["bin"], []).append(r)
        for held in bins.values():
            used = sum(r["length"] for r in held)
            assert used <= capacity and all(r["residual"] == capacity - used for r in held)
            named = [r["source"] for r in held if r["source"] is not None]
            assert len(set(named)) == len(named) and len({r["cluster"] for r in held}) == len(held)
            spans = sorted((r["start"], r["start"] + r["length"]) for r in held)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert packing.pack_documents(no_docs).collect() == []


def test_ids_beside_a_null_id_stay_whole(spark):
    rows = [(2**60 + 1, "a b", "s"), (None, "c d", "t"), (2**60 + 3, "e", None)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows} and {r["bin"] for r in packed} == {0}


def test_near_copies_share_no_bin(spark, odd_docs, no_docs, tmp_path):
    words = [f"w{i}" for i in range(60)]
    near = [(k, " ".join(words[:k] + ["other"] + words[k + 1 :]), f"s{k}") for k in range(30)]
    alone = [(100 + k, " ".join(f"x{k}y{i}" for i in range(60)), f"t{k}") for k in range(30)]
    folder = str(tmp_path)
    spark.createDataFrame(near + alone + [(7, "other words", "z"), (8, "", "q"), (9, None, None)], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    rows = queries.op10_best_fit_packing(spark, folder).collect()
    bins, clusters = {r["doc_id"]: r["bin"] for r in rows if r["source"] and r["source"][0] == "s"}, {r["cluster"] for r in rows if r["source"] and r["source"][0] == "s"}
    assert len(bins) == 30 == len(set(bins.values())) and len(clusters) == 1
    assert len({r["cluster"] for r in rows if r["doc_id"] >= 100}) == 30 and len(rows) == 63
    for docs in (odd_docs, no_docs):
        for packed in (packing.pack_near_copies_apart(docs), packing.pack_documents(jaccard.with_clusters(docs.drop("_cluster"), "_cluster"), cluster="_cluster")):
            assert packed.filter("piece = 0").count() == docs.count()


def test_clusters_of_a_group_equal_brute_force(spark):
    """Bins hold no two linked documents, and the clusters of each group are the components of all its pairs."""
    rnd = random.Random(6)
    rows = []
    for k in range(40):
        words = [f"v{rnd.randint(0, 5000)}" for _ in range(rnd.randint(3, 120))]
        for c in range(rnd.randint(1, 12)):
            changed = [w if rnd.random() > 0.02 else f"z{rnd.randint(0, 5000)}" for w in words]
            rows.append((len(rows), " ".join(changed[: len(changed) - c % 3]), f"s{len(rows)}"))
    rows += [(len(rows) + k, " ".join(f"long{i}" for i in range(400)), f"l{k}") for k in range(3)]
    packed = packing.pack_near_copies_apart(spark.createDataFrame(rows, "doc_id long, text string, source string"), 150, 60).collect()

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, _ in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0
    by_group, by_bin = {}, {}
    for r in packed:
        if r["length"] < 150:
            by_group.setdefault(r["bin"] >> 32, []).append(r)
        by_bin.setdefault(r["bin"], []).append(r["doc_id"])
    assert len(by_group) > 3 and not any(alike(a, b) for held in by_bin.values() for k, a in enumerate(held) for b in held[:k])
    for held in by_group.values():
        ids = sorted({r["doc_id"] for r in held})
        label = {i: i for i in ids}
        for _ in ids:
            for a in ids:
                for b in ids:
                    if label[a] != label[b] and alike(a, b):
                        label[a] = label[b] = min(label[a], label[b])
        cluster = {r["doc_id"]: r["cluster"] for r in held}
        assert all((cluster[a] == cluster[b]) == (label[a] == label[b]) for a in ids for b in ids)


# toxicity


def test_pu_risk_learns_from_positives_and_unlabelled_only():
    rnd = np.random.default_rng(1)
    toxic, clean = rnd.normal(1, 1, (400, 5)), rnd.normal(-1, 1, (1600, 5))
    w, b = toxicity.fit_nnpu(toxic[:200], np.vstack([toxic[200:], clean[:800]]), 0.2)
    assert (clean[800:] @ w + b < 0).mean() > 0.95 and (toxic @ w + b > 0).mean() > 0.9


def test_the_sample_is_bounded_in_rows_where_ids_repeat(spark):
    docs = spark.range(40_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    learn, confirmed = F.col("doc_id") >= 0, spark.createDataFrame([(0,), (1,)], "doc_id long")
    counts = {r["kind"]: r["count"] for r in toxicity._sample(docs, confirmed, learn, 300, 600).groupBy("kind").count().collect()}
    assert counts == {1: 300, 0: 600}
    few = docs.limit(50).withColumn("doc_id", F.monotonically_increasing_id())
    assert toxicity._sample(few, confirmed, learn, 300, 600).filter("kind = 0").count() == 50


@pytest.mark.parametrize(("prior", "shift"), [(0.2, 1.0), (0.7, 2.0)])
def test_pu_fit_equals_steps_along_numeric_gradients(prior, shift):
    rnd = np.random.default_rng(5)
    positive, unlabelled = rnd.normal(shift, 1, (6, 2)), rnd.normal(-0.5, 1, (9, 2))
    loss = lambda z: math.log1p(math.exp(-z))
    dot = lambda w, x: sum(a * b for a, b in zip(w, [*x, 1.0], strict=True))
    mean = lambda w, rows, sign: sum(loss(sign * dot(w, x)) for x in rows) / len(rows)
    negative = lambda w: mean(w, unlabelled, -1) - prior * mean(w, positive, -1)
    decay, steps, below = 0.02, 60, 0
    w, m, v = np.array([0, 0, math.log(prior / (1 - prior))]), np.zeros(3), np.zeros(3)
    for t in range(1, steps + 1):
        over = negative(w) >= 0
        below += not over
        risk = (lambda u: prior * mean(u, positive, 1) + negative(u)) if over else (lambda u: -negative(u))
        g = np.array([(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(3) * 1e-5]) + decay * np.append(w[:2], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got, bias = toxicity.fit_nnpu(positive, unlabelled, prior, steps=steps, decay=decay)
    assert np.allclose([*got, bias], w, atol=1e-4) and below < steps and (below or prior > 0.5)  # the small prior takes both kinds of steps


def test_toxicity_scores_equal_a_loop():
    features = sorted({f for w in "you are a horrible stupid person horrid".split() for f in toxicity.word_features(w)})
    weights = np.linspace(-3, 4, len(features))
    model = toxicity.Classifier(features, weights, -0.5)
    for text in ("You are horrible, HORRIBLE and stupid", "a person", "nothing known xyzzy", "", None, "horrid " * 300):
        words = toxicity.WORDS((text or "").lower())
        z = -0.5
        for k, f in enumerate(features):
            n = sum(list(toxicity.word_features(w)).count(f) for w in words)
            z += weights[k] * min(1.0, toxicity.RATE_SCALE * n / len(words)) if n else 0
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op3_nnpu_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[k]["predicted"], v) for k, v in labels.items() if rows[k]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in rows.items())
    assert np.mean([p for p, v in held if v == 1]) >= 0.6 and np.mean([p for p, v in held if v == 0]) <= 0.08


def test_toxicity_edge_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (4, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.predict(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.predict(no_docs, labels).collect() == []


# language ID


def test_models_are_distributions():
    grams = {}
    text = langid.PAD + "the cat sat on the mat and the dog " * 3
    for i in range(len(text) - 3):
        grams[text[i : i + 4]] = grams.get(text[i : i + 4], 0) + 1
    listed = sorted(grams)
    model = langid.KneserNey.fit(listed, np.array([[grams[g]] for g in listed]), ["x"])
    alphabet = sorted(set(text))
    for context in ("   ", "the", "he ", "qqq", "cat"):
        h = []
        for c in alphabet:
            columns = [np.array([ord(x)], np.uint64) for x in context + c]
            total, n = 0.0, 4
            while n:
                at = langid.find(model.keys[n - 1], langid.gram_hash(columns[4 - n :]))[0]
                if at >= 0:
                    total += model.log_p[n - 1][at][0]
                    break
                if n > 1:
                    back = langid.find(model.context_keys[n - 2], langid.gram_hash(columns[4 - n : -1]))[0]
                    total += model.log_backoff[n - 2][back][0] if back >= 0 else 0
                n -= 1
            h.append(np.exp(total))
        assert 0.9 < sum(h) < 1.0001


def test_entropies_equal_brute_force():
    known = {"x": ["the cat sat on the mat", "the dog and the cat", "then they sat"], "y": ["le chat est là", "la table et le chien", "été"]}
    counts = {k: Counter((langid.PAD + t + " ")[i : i + 4] for t in texts for i in range(len(t) + 1)) for k, texts in known.items()}
    listed = sorted(set().union(*counts.values()))
    model = langid.KneserNey.fit(listed, np.array([[counts[k][g] for k in known] for g in listed]), list(known))
    alphabet = len({g[-1] for g in listed}) + 1
    tables = {}
    for k in known:
        tables[k] = {4: {g: c for g, c in counts[k].items() if c}}
        for n in (3, 2, 1):
            tables[k][n] = Counter(g[1:] for g in tables[k][n + 1])

    def probability(k, gram):
        n = len(gram)
        if not n:
            return 1 / alphabet
        table = tables[k][n]
        ones, twos = (sum(c == m for c in table.values()) for m in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        lower = probability(k, gram[1:])
        if not after:
            return lower
        return max(table.get(gram, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * lower

    texts = ["the cat", "le chat", "zebra ωμ", "tea"]
    got = model.entropies(texts)
    for i, t in enumerate(texts):
        padded = langid.PAD + t + " "
        for j, k in enumerate(known):
            wanted = -sum(math.log(probability(k, padded[a : a + 4])) for a in range(len(t) + 1)) / (len(t) + 1)
            assert got[i, j] == pytest.approx(wanted, abs=1e-4)
    assert [model.predict([t])[0][0] for t in texts[:2]] == ["x", "y"]


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_kneser_ney_language(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98 and np.mean([r["rejected"] for r in rows]) < 0.02
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_language_edge_rows(odd_docs, no_docs):
    rows = langid.predict(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3)} == {"und"} and all(r["lang_pred"] in ("en", "fr", "und") for r in rows)
    assert langid.predict(no_docs).collect() == []


def test_nonsense_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, docs.doc_id % 5 != 0)
    lang, score, entropy, rejected = model.predict(["zxqj vkwq qzzx jjkq xqzv " * 20, "123 456 ...", None])
    assert rejected.all() and lang[1:] == ["und", "und"] and score[1] == 0


def test_rare_languages_and_small_tables_reject_nonsense(spark):
    nonsense = ["asdkjh qwe lkjasd zmxnc poi qwlekj " * 10, "zxqj vkwq qzzx jjkq xqzv " * 20]
    rare = [(-1, "hej och välkommen till den svenska texten som är kort", "sv"), (-2, "det här är en annan text på svenska", "sv")]
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    for docs in (big.unionByName(spark.createDataFrame(rare, big.schema)), small, small.limit(12)):
        model = langid.train(docs, docs.doc_id.isNotNull())
        assert model.predict(nonsense)[3].all() and np.isfinite(model.limits).all()
        own = model.predict([r["text"] for r in docs.collect() if r["lang"] != "sv"])[3]
        assert own.mean() < 0.05
