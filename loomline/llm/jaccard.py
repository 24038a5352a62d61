"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A text's set is its distinct five-word shingles, as 64-bit hashes. Sets are dealt
into bands by size. Each band cuts the hash universe into segments; if two sets
of sizes x <= y reach the threshold, they differ in at most H = (x + y) / 7
elements, so for any allocation p of 0, 1 or 2 to segments with a sum over H
there is a segment where they differ in fewer than p elements: they agree there
(p = 1) or one has one element more (p = 2). The smaller set is indexed: the
hash of each non-empty segment's subset, and in the first eighth of the segments
also of each subset less one element. The larger set probes with the allocation
of least cost, where the cost of a segment is how often its rarest shingle occurs
(frequent shingles are counted beforehand; the counts steer costs only).

A probing member of a bucket makes candidates with all others, but for those that
a sketch rules out: 256 parities of the set, by ranges of the universe, which
differ in no more places than the sets do in elements. Sets that already belong
together need no more comparison, so buckets are worked off in rounds of stars:
every set against one member that probes, in the largest bucket it lies in. In the
first round that member is the one whose buckets hold most rows in all. In a group
of near copies it lies in the middle, so that nearly all of the group are linked
with it at once, and what is left grows as the group does and not as its square;
the next round takes another member. Last come all pairs of a probing and an
indexed member that still lie in different components, where a sketch of 1,024
parities rules out holders of a common passage whose rests differ. No pair that may
be linked is left unconnected and unverified. That gives link_components, which
computes no more than connectivity; link_pairs and count_links verify all
candidates, also those within a component, and give every link.

Equal sets are one node. In a chunk of a task a crowded bucket sends on one member
only, and its other rows are spread, so that no bucket meets in one task.

Defined results: null text and text without words have an empty set and are
linked with nothing (component_id is their own doc_id); fewer than five words
are one shingle; null doc_ids never name a component that has another id;
repeated rows are linked with each other; an empty table gives an empty table.
Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import bounded, materialise, record_batches, unused

SHINGLE = 5
CHUNK_BYTES = 1_000_000
CHUNK_ROWS = 500_000
HOT_IN_CHUNK = 16
#: Rows of whole texts that go to Python at once.
BATCH_ROWS = 500
MAX_HOT = 500_000
STAR_ROUNDS = 2
#: Longs of a set's sketch, 64 parities each, and of the finer one for the last round.
SKETCH = [f"s{i}" for i in range(4)]
FINE = [f"f{i}" for i in range(16)]
#: One segment in so many also indexes its one-deletion neighbourhood.
OPEN_SHARE = 8
#: Roles: bit 1 indexed, bit 2 probing.
PROBES = "(role & 2) > 0"

U = np.uint64
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(0, 2**64, 256, U)
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Size bands: (least, greatest) size; a band and at most the one below hold all partners that are not larger.
BANDS: list[tuple[int, int]] = []
_low = 1
while _low < 2**31:
    BANDS.append((_low, 2 * _low - 1))
    _low = BANDS[-1][1] + 1
BAND_STARTS = np.array([b[0] for b in BANDS])


def segments_of(band: int) -> int:
    """Segments of a band.

    Enough of them must be non-empty to carry an allocation. Small sets get so
    many that next to every element has its own; the largest sets of other bands
    have 2.5 or 3 elements a segment.
    """
    top = BANDS[band][1]
    return 512 if top <= 127 else round(top / (2.5 if top <= 511 else 3))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct shingle hashes of many texts at once, in numpy."""

    def __init__(self) -> None:
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            one = np.ones(self.size, U)
            one[1:] = BASE
            self.up = np.cumprod(one)
            one[1:] = INVERSE
            self.down = np.cumprod(one)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Each text's sorted set."""
        out: list[np.ndarray] = []
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append((t or b"").lower())  # A-Z only, as bytes
            size += len(part[-1])
            if size > CHUNK_BYTES:
                out += self._chunk(part)
                part, size = [], 0
        return out + self._chunk(part)

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self._powers(len(raw) + 1)
        word = ~IS_SPACE[raw]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_VALUE[raw] * self.up[: len(raw)])])
        words = mix((total[stop] - total[start]) * self.down[start] + (stop - start).astype(U))
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
        last = np.append(first[1:], len(start))
        five = np.zeros(0, U)
        if len(words) >= SHINGLE:
            five = words[: len(words) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                five = mix(five * BASE + words[k : len(words) - SHINGLE + 1 + k])
        found = []
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            if j - i >= SHINGLE:
                found.append(np.unique(five[i : j - SHINGLE + 1]))
            elif j > i:
                h = words[i : i + 1].copy() ^ U(j - i)
                for k in range(i + 1, j):
                    h = mix(h * BASE + words[k : k + 1])
                found.append(h)
            else:
                found.append(np.zeros(0, U))
        return found


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s + BASE).sum(dtype=U) ^ U(len(s))], U))
    return int(h.view(np.int64)[0])


def sketch(s: np.ndarray, longs: int = len(SKETCH)) -> np.ndarray:
    """The parity of a set's number of elements in each of equal ranges of the universe, as signed 64-bit numbers."""
    bits = 64 * longs
    odd = np.bincount((s >> U(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(a: str, b: str, parts: list[str] = SKETCH) -> Column:
    """Whether sizes and sketches of two sets, in columns of these prefixes, leave room for a link: they then differ in at most (x + y) / 7 elements."""
    x, y = F.col(a + "n"), F.col(b + "n")
    apart = sum(F.bit_count(F.col(a + k).bitwiseXOR(F.col(b + k))) for k in parts)
    return (4 * F.least(x, y) >= 3 * F.greatest(x, y)) & (7 * apart <= x + y)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test of two sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= 75 * (len(a) + len(b) - common)


class Signatures:
    """Bucket keys of sets; hot: sorted shingle hashes and their counts, for the costs only."""

    def __init__(self, hot_keys: np.ndarray, hot_counts: np.ndarray) -> None:
        self.hot_keys, self.hot_counts = hot_keys, hot_counts

    def _counts(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hot_keys):
            return np.ones(len(s))
        at = np.minimum(np.searchsorted(self.hot_keys, s), len(self.hot_keys) - 1)
        return np.where(self.hot_keys[at] == s, self.hot_counts[at], 1).astype(float)

    def of(self, s: np.ndarray) -> tuple[list[np.ndarray], list[int], list[int]]:
        """Arrays of keys with the role of each (1 indexed, 2 probing, 3 both), and the bands that no allocation covers."""
        size, counts = len(s), self._counts(s)
        own = int(np.searchsorted(BAND_STARTS, size, "right")) - 1
        keys, roles, uncovered = [], [], []
        for band in range(own, -1, -1):
            if 4 * BANDS[band][1] < 3 * size:
                break
            m = segments_of(band)
            salted = mix(s ^ mix(np.array([band + 1], U)))
            segment = (salted % U(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            segment, value, weight = segment[order], mix(salted[order] + BASE), counts[order]
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            number, name = np.diff(np.append(starts, size)), segment[starts]
            sums = np.add.reduceat(value, starts)
            place = mix(name.astype(U) + U(band << 32) + BASE)
            exact = mix(sums ^ place)
            cost = np.minimum.reduceat(weight, starts)
            open_ = (name < m // OPEN_SHARE) & (number >= 2)  # segments whose one-deletion neighbourhood is indexed
            need = (size + min(BANDS[band][1], size)) // 7 + 1
            units = np.concatenate([cost - 1e-3 * np.minimum(number, 500), (cost * (number + 1) + np.maximum.reduceat(weight, starts))[open_]])
            if len(units) < need:
                uncovered.append(band)
                chosen = np.zeros(0, np.int64)
            else:
                chosen = np.argsort(units, kind="stable")[:need]
            once = np.zeros(len(starts), bool)
            once[chosen[chosen < len(starts)]] = True
            twice = np.zeros(len(starts), bool)
            twice[np.flatnonzero(open_)[chosen[chosen >= len(starts)] - len(starts)]] = True
            if band == own:
                keys += [exact[once], exact[~once]]
                roles += [3, 1]
            else:
                keys.append(exact[once])
                roles.append(2)
            group = np.repeat(np.arange(len(starts)), number)
            if band == own and open_.any():
                mine = open_[group]
                keys.append(_less(exact_less(sums, value[mine], place, group[mine])))
                roles.append(1)
            if twice.any():
                mine = twice[group]
                keys += [exact_less(sums, value[mine], place, group[mine]), _less(exact[twice])]
                roles += [2, 2]
        return keys, roles, uncovered


def exact_less(sums: np.ndarray, value: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each element the hash of its segment's subset without it."""
    return mix((sums[group] - value) ^ place[group])


def _less(keys: np.ndarray) -> np.ndarray:
    """The keys of indexed one-deletion subsets, apart from those of whole subsets."""
    return mix(keys ^ U(0xD1B54A32D192ED03))


def shingle_table(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, set size, fingerprint, hash of the text and sketches of every document; kind 1: shingles frequent in a chunk, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n >= HOT_IN_CHUNK].view(np.int64), n[n >= HOT_IN_CHUNK]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h), pa.array(n.astype(np.int64)), *[pa.nulls(len(h), pa.int64())] * (2 + len(SKETCH + FINE))], names=names)

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = shingler.sets(part.column(1).to_pylist())
                parities = np.array([np.concatenate([sketch(s), sketch(s, len(FINE))]) for s in sets]).reshape(-1, len(SKETCH + FINE)).T
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, np.int32)), part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), part.column(2), *map(pa.array, parities)], names=names)
                held += sets
                size += sum(map(len, sets))
                if size > 6 * CHUNK_ROWS:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    names = ["kind", "a", "n", "node", "text_key", *SKETCH, *FINE]
    return materialise(docs.select("doc_id", F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("key")).mapInArrow(run, "kind int, " + ", ".join(f"{name} long" for name in names[1:])))


def _buckets(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """key, node, role of the members of buckets with two or more nodes; role 4 names a band that a node's probes don't cover."""
    # at most MAX_HOT counts
    top = hot.orderBy(F.desc("n"), "a").limit(MAX_HOT).toArrow()
    keys, counts = top["a"].to_numpy().astype(np.int64).view(U), top["n"].to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], counts[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signatures = Shingler(), Signatures(*shared.value)
        held: tuple[list, list, list] = ([], [], [])
        seen: set[int] = set()
        size = 0

        def chunk() -> pa.RecordBatch:
            key, node, role = np.concatenate(held[0]).view(np.int64), np.concatenate(held[1]), np.concatenate(held[2])
            order = np.argsort(key)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            number = np.diff(np.append(starts, len(key)))
            crowded = np.empty(len(key), bool)
            crowded[order] = np.repeat(number >= 4, number)
            salt = np.where(crowded | (role == 4), 1 + (node & 0x7FFF), 0).astype(np.int32)
            first = order[starts[number >= 4]]  # of a crowded bucket one member, with all its roles, goes on to meet those of other chunks
            all_roles = np.bitwise_or.reduceat(role[order], starts)[number >= 4]
            columns = [np.append(key, key[first]), np.append(node, node[first]), np.append(role, all_roles), np.append(salt, np.zeros(len(first), np.int32))]
            # rows stay in the order of their texts, so that a shuffle block repeats each node and packs well
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "role", "salt"])

        for b in batches:
            for k in range(0, b.num_rows, 500):
                for s in shingler.sets(b.column(0).slice(k, 500).to_pylist()):
                    if not len(s) or (name := fingerprint(s)) in seen:
                        continue
                    seen.add(name)
                    found, roles, uncovered = signatures.of(s)
                    found = [*found, np.array(uncovered, U)]
                    held[0].extend(found)
                    n = sum(map(len, found))
                    held[1].append(np.full(n, name, np.int64))
                    held[2].append(np.repeat(np.array([*roles, 4], np.int8), [len(f) for f in found]))
                    size += n
                    if size > CHUNK_ROWS:
                        yield chunk()
                        held, seen, size = ([], [], []), set(), 0
        if size:
            yield chunk()

    rows = docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(run, "key long, node long, role byte, salt int")
    bucket = Window.partitionBy("key", "salt")
    rows = rows.withColumn("_low", F.min("node").over(bucket)).withColumn("_high", F.max("node").over(bucket)).withColumn("_probed", F.max(F.expr(PROBES)).over(bucket))
    return materialise(rows.filter((F.col("salt") > 0) | ((F.col("_low") < F.col("_high")) & F.col("_probed"))).select("key", "node", "role"))


def _open(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold two or more components and a probing member, with the number of rows of the bucket as `size`."""
    wanted = buckets.drop("size").groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.max(F.expr(PROBES)).alias("_probed"), F.count("*").alias("size"))
    return materialise(buckets.drop("size").join(materialise(wanted.filter("_low < _high AND _probed").select("key", "size")), "key"))


class _Verifier:
    """Exact tests of candidate pairs over whole texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame) -> None:
        self.docs, self.nodes = docs, nodes

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) of nodes that are linked."""
        wanted = materialise(pairs)
        ends = wanted.select(F.col("a").alias("node")).distinct().unionByName(wanted.select(F.col("b").alias("node")).distinct()).distinct()
        ids = bounded(materialise(ends.join(self.nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "node")))
        rows = self.docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("raw"))
        # one row a node, also where ids or whole rows repeat; written, so that Spark can split the pairs of a hub
        texts = materialise(rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("node", "raw").dropDuplicates(["node"]))
        both = wanted.join(texts.select(F.col("node").alias("b"), F.col("raw").alias("raw_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("raw").alias("raw_a")), "a")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            hub: tuple = (None, None, None)
            for x in batches:
                for k in range(0, x.num_rows, 200):
                    part = x.slice(k, 200)
                    a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                    raws = part.column(2).to_pylist()
                    right = shingler.sets(part.column(3).to_pylist())
                    good = []
                    for i in range(len(a)):
                        if hub[0] != a[i] or hub[1] != raws[i]:
                            hub = (a[i], raws[i], shingler.sets([raws[i]])[0])
                        # the hash of a text may be that of another: the names must be right
                        good.append(linked(hub[2], right[i]) and fingerprint(right[i]) == b[i] and fingerprint(hub[2]) == a[i])
                    yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return both.select("a", "b", "raw_a", "raw_b").mapInArrow(verify, "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of the edges (a, b): least labels with pointer jumping.

    Each round passes labels along edges, then to each label's own label; tables
    are written each round, and rounds end when no label changes.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        passed = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("component").alias("m")).withColumnRenamed("b", "node")
        lower = materialise(labels.join(passed, "node").select("node", F.least("component", "m").alias("next"), F.col("component").alias("old")))
        jump = lower.join(lower.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left")
        nxt = materialise(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "old"))
        changed = not nxt.filter("component <> old").isEmpty()
        labels = nxt.select("node", "component")
        if not changed:
            return labels


def link_components(docs: DataFrame, set_name: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document and, if named, the fingerprint of its set."""
    with record_batches(docs.sparkSession, BATCH_ROWS):
        named = _named(*_components(docs))
    return named.withColumnRenamed("node", set_name) if set_name else named.drop("node")


def link_pairs(docs: DataFrame) -> DataFrame:
    """a, b, doc_a, doc_b, copies_a, copies_b of every two linked sets, a < b, each with its least doc_id and number of rows."""
    with record_batches(docs.sparkSession, BATCH_ROWS):
        _, nodes, members = _prepared(docs)
        return _pairs(docs, nodes, members)


def count_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and n_links of every document: how many other rows it is linked with, copies included."""
    with record_batches(docs.sparkSession, BATCH_ROWS):
        own, nodes, members = _prepared(docs)
        pairs = _pairs(docs, nodes, members)
    ends = pairs.select(F.col("a").alias("node"), F.col("copies_b").alias("n_links")).unionByName(pairs.select(F.col("b").alias("node"), F.col("copies_a").alias("n_links")))
    others = nodes.join(ends.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")
    counted = materialise(others.select("node", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    full = own.filter("n > 0").join(counted, "node").select("doc_id", F.col("n").alias("n_shingles"), "n_links")
    return full.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links")))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all documents, the nodes and the members of buckets."""
    table = shingle_table(docs)
    own = table.filter("kind = 0").select(F.col("a").alias("doc_id"), "n", "node", "text_key", *SKETCH, *FINE)
    row = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))  # the row that stands for the node: one with an id, if there is any
    nodes = materialise(own.filter("n > 0").groupBy("node").agg(row.alias("row"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", *SKETCH, *FINE)]).select("node", "row.doc_id", "row.text_key", "copies", "n", *SKETCH, *FINE))
    hot = table.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n"))
    return own, nodes, _buckets(docs, hot)


def _pairs(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """link_pairs: all that probe against all that are indexed in their buckets, verified."""
    marks = ["node", "n", *SKETCH]
    buckets = materialise(members.filter("role < 4").groupBy("key", "node").agg(F.bit_or("role").alias("role")).join(nodes.select(*marks), "node"))
    side = lambda prefix: [F.col(c).alias(prefix + c) for c in marks]
    left = buckets.filter(PROBES).select("key", *side("p_"))
    right = materialise(buckets.filter("(role & 1) > 0").select("key", *side("i_")))
    met = left.join(right, "key").filter((F.col("p_node") != F.col("i_node")) & may_link("p_", "i_")).select("p_node", "i_node")
    rest = _uncovered(members, nodes).select(F.col("a").alias("p_node"), F.col("b").alias("i_node"))
    wanted = met.unionByName(rest).select(F.least("p_node", "i_node").alias("a"), F.greatest("p_node", "i_node").alias("b")).distinct()
    found = _Verifier(docs, nodes).links(wanted)
    named = lambda end: nodes.select(F.col("node").alias(end), F.col("doc_id").alias("doc_" + end), F.col("copies").alias("copies_" + end))
    return materialise(found.join(named("a"), "a").join(named("b"), "b").select("a", "b", "doc_a", "doc_b", "copies_a", "copies_b"))


def with_clusters(docs: DataFrame, name: str) -> DataFrame:
    """docs with the column `name`: a number for each component of linked documents, null where the set is empty. Other columns stay as they are, whatever their names."""
    with record_batches(docs.sparkSession, BATCH_ROWS):
        _, nodes, labels = _components(docs)
    if labels is None:
        return with_sets(docs, name)
    own, node, component = unused(docs, "_set", "_node", "_component")
    named = with_sets(docs, own)
    ids = bounded(labels.select(F.col("node").alias(node), F.col("component").alias(component)))
    return named.join(ids, named[own] == ids[node], "left").withColumn(name, F.coalesce(component, own)).drop(own, node, component)


def with_sets(docs: DataFrame, name: str) -> DataFrame:
    """docs with the column `name`: the fingerprint of the set of `text`, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(k, BATCH_ROWS)
                sets = shingler.sets(part.column("text").cast(pa.binary()).to_pylist())
                found = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sets of all documents, the nodes, and the components of nodes that are linked with others."""
    own, nodes, members = _prepared(docs)
    verifier = _Verifier(docs, nodes)
    buckets = materialise(members.filter("role < 4").groupBy("key", "node").agg(F.bit_or("role").alias("role")).withColumn("component", F.col("node")))
    edges = labels = None

    def take(pairs: DataFrame) -> None:
        nonlocal edges, labels
        found = materialise(verifier.links(pairs))
        edges = found if edges is None else edges.unionByName(found)
        labels = connected_components(edges)

    marks = ["n", "central", *SKETCH]
    named = lambda prefix: [F.col(c).alias(prefix + c) for c in ("node", "component", *marks)]
    for turn in range(STAR_ROUNDS + 1):
        if labels is not None:
            buckets = materialise(buckets.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        buckets = _open(buckets)
        if buckets.isEmpty():
            break
        if not turn:
            # the more rows the buckets of a set hold in all, the nearer it lies to the middle of its group
            central = materialise(buckets.groupBy("node").agg(F.sum("size").alias("central")))
            buckets = materialise(buckets.join(nodes.join(central, "node").select("node", *marks), "node"))
        if turn < STAR_ROUNDS:  # every set against one member that probes of its largest bucket: first the one most in the middle, then another
            first = -F.col("central") if not turn else F.lit(0)
            by = F.struct(~F.expr(PROBES), first, F.xxhash64("node", F.lit(turn)), "node", "component", *marks)
            hubs = materialise(buckets.groupBy("key").agg(F.min(by).alias("_hub"), F.first("size").alias("_size")).select("key", "_size", *[F.col("_hub")[c].alias("h_" + c) for c in ("node", "component", *marks)]))
            met = buckets.select("key", *named("m_")).join(hubs, "key").filter((F.col("m_component") != F.col("h_component")) & may_link("m_", "h_"))
            take(met.groupBy(F.col("m_node").alias("b")).agg(F.max_by("h_node", F.struct("_size", "key")).alias("a")).select("a", "b"))
        else:  # what probes against what is indexed, where they still lie in different components
            fine = nodes.select("node", "n", *FINE)
            slim = buckets.select("key", "node", "component", "role")
            side = lambda prefix: [F.col(c).alias(prefix + c) for c in ("node", "component", "n", *FINE)]
            left = slim.filter(PROBES).join(fine, "node").select("key", *side("p_"))
            right = materialise(slim.filter("(role & 1) > 0").join(fine, "node").select("key", *side("i_")))
            met = left.join(right, (left["key"] == right["key"]) & (F.col("p_component") != F.col("i_component")) & may_link("p_", "i_", FINE))
            take(met.select(F.least("p_node", "i_node").alias("a"), F.greatest("p_node", "i_node").alias("b")).distinct())
    rest = materialise(_uncovered(members, nodes))
    if not rest.isEmpty():
        take(rest)
    return own, nodes, labels


def _uncovered(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of each node whose probes could not cover a band with all nodes of that band that it may be linked with (next to none, but exact)."""
    starts = F.array(*[F.lit(int(b)) for b in BAND_STARTS])
    banded = nodes.withColumn("key", (F.size(F.filter(starts, lambda b: b <= F.col("n"))) - 1).cast("long"))
    marks = ["node", "n", *SKETCH]
    open_ = members.filter("role = 4").select("key", "node").distinct().join(nodes, "node").select("key", *[F.col(c).alias("a_" + c) for c in marks])
    met = open_.join(banded.select("key", *[F.col(c).alias("b_" + c) for c in marks]), "key").filter((F.col("a_node") != F.col("b_node")) & may_link("a_", "b_"))
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _named(own: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Every document with the least doc_id of its component, and its set."""
    joined = nodes.select("node", "doc_id")
    if labels is not None:
        joined = joined.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        joined = joined.withColumn("component", F.col("node"))
    joined = materialise(joined)
    least = materialise(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = materialise(joined.join(least, "component").select("node", "component_id"))
    full = own.filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node")
    return full.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node"))


#: DuckDB SQL of link_components: all pairs that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_ >= 75 * (p.n + q.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS least_ FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least_, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""
