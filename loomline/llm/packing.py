"""Conflict-constrained best-fit packing of documents into fixed-length bins.

Longest first, each piece goes to the tightest bin that fits and is compatible.
Bins stand in order of their residual and carry two bitmaps: the sources and the
duplicate clusters they hold. The successor search starts at the least residual
that fits and goes on until a bin shares neither the piece's source nor its
cluster; only if there is none a bin is opened.

Documents longer than a bin are cut into full bins and a rest. Pieces are dealt
into groups by hash, so that a source or cluster that holds a third of all rows
is spread evenly; bins never cross groups, and the number of groups follows the
number of pieces, so a group has about `group_size` pieces at any scale.

Duplicate clusters are, in `pack_near_copies_apart`, the components of op7's links (five
words, a similarity of 0.75) among the documents of a group: bins never cross groups, so
only links inside a group can keep pieces apart. A group's sets come to its task with
the pieces that may share a bin (those that fill one share it with no words), sketches
rule out most pairs as one numpy block, and the rest are tested exactly unless they
already belong together. Two documents that only a third one in another group links are
not one cluster. In `pack_documents` clusters are a column that the caller names; where
it is null, or none is named, texts of equal lower-cased words are one cluster.

Defined results: null or empty text is a piece of length 0 that is packed like
any other; a null id is kept, a null source conflicts with nothing; repeated rows are packed once
each, in different bins as they share a cluster; an empty table gives an empty
table. Extra columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import SPACES, materialise
from loomline.llm.jaccard import FINE, Shingler, fingerprint, linked, sketch

SKETCH_LONGS = len(FINE)
CAPACITY = 2048
GROUP_SIZE = 2000


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Each item's bin and the offset it starts at; items are taken in the order given."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[list[int]] = []  # by bin: source bitmap, cluster bitmap
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            h = held[open_bins[at][1]]
            if not (h[0] & s or h[1] & c):
                break
            at += 1
        residual, b = open_bins.pop(at) if at < len(open_bins) else (capacity, len(held))
        if b == len(held):
            held.append([0, 0])
        held[b][0] |= s
        held[b][1] |= c
        insort(open_bins, (residual - length, b))
        bins.append(b)
        offsets.append(capacity - residual)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster, piece and length; lengths count words, clusters are those of the column or texts of equal lower-cased words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), f"[{SPACES}]+", " "))
    equal = F.xxhash64(plain)
    measured = docs.select("doc_id", "source", (F.coalesce(cluster, equal) if cluster else equal).alias("cluster"), F.regexp_count(text, F.lit(f"[^{SPACES}]+")).alias("n"))
    count = F.greatest(F.ceil(F.col("n") / capacity).cast("int"), F.lit(1))
    cut = measured.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return cut.select("doc_id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))


def cluster_sets(names: list[int], sketches: np.ndarray, sets: list[np.ndarray]) -> dict[int, int]:
    """The least name of each named set's component of links among these sets."""
    order = sorted(range(len(names)), key=lambda k: (len(sets[k]), names[k]))
    sizes = np.array([len(sets[k]) for k in order])
    rows = sketches[order]
    head = list(range(len(order)))

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = k = head[head[k]]
        return k

    for i, k in enumerate(order):
        last = int(np.searchsorted(sizes, sizes[i] * 4 // 3, "right"))
        apart = np.bitwise_count(rows[i] ^ rows[i + 1 : last]).sum(1, dtype=np.int64)
        for j in (np.flatnonzero(7 * apart <= sizes[i] + sizes[i + 1 : last]) + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b and linked(sets[k], sets[order[j]]):
                head[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, k in enumerate(order):
        least[find(i)] = min(names[k], least.get(find(i), names[k]))
    return {names[k]: least[find(i)] for i, k in enumerate(order)}


def _words() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACES}]+"))


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n (words), cluster (a name of the text's set), sketch and set of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = shingler.sets(part.column(3).to_pylist())
                made = [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([sketch(s, SKETCH_LONGS).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], names=["doc_id", "source", "n", "cluster", "sketch", "set"])

    return docs.select("doc_id", "source", _words().alias("n"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, source string, n int, cluster long, sketch binary, set binary")


def pack_near_copies_apart(docs: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """pack_documents with the clusters of near copies that lie in one group; `cluster` is the least name of a component's sets."""
    count = lambda n: F.greatest(F.ceil(n / capacity).cast("int"), F.lit(1))
    # sets are as large as texts, so they are written once, to be dealt out; the pieces are counted beforehand
    n_pieces = docs.agg(F.coalesce(F.sum(count(_words())), F.lit(0))).first()[0]
    cut = _measured(docs).withColumn("piece", F.explode(F.sequence(F.lit(0), count(F.col("n")) - 1)))
    length = F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int")
    full = length == capacity  # shares its bin with pieces of no words only, so its set stays behind
    held = cut.withColumn("length", length).withColumns({c: F.when(~full, F.col(c)) for c in ("sketch", "set")})
    return _packed(held.drop("n"), n_pieces, capacity, group_size)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, length, source, cluster, bin (global), start (offset in the bin) and residual (of the closed bin)."""
    cut = materialise(pieces(docs, capacity, cluster))
    return _packed(cut, cut.count(), capacity, group_size)


def _packed(cut: DataFrame, n_pieces: int, capacity: int, group_size: int) -> DataFrame:
    groups = max(1, -(-n_pieces // group_size))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source"), F.lit(groups)))

    def clustered(items: pa.Table) -> pa.Table:
        known = items.select(["cluster", "sketch", "set"]).filter(pc.is_valid(items["set"])).group_by("cluster", use_threads=False).aggregate([("sketch", "first"), ("set", "first")])
        sketches = np.array([np.frombuffer(x, np.uint64) for x in known["sketch_first"].to_pylist()]).reshape(-1, SKETCH_LONGS)
        names = cluster_sets(known["cluster"].to_pylist(), sketches, [np.frombuffer(x, np.uint64) for x in known["set_first"].to_pylist()])
        found = pa.array([names.get(c, c) for c in items["cluster"].to_pylist()], pa.int64())
        return items.set_column(items.schema.get_field_index("cluster"), "cluster", found)

    def pack(items: pa.Table) -> pa.Table:
        group = items.column("group")[0].as_py()
        if "set" in items.schema.names:
            items = clustered(items)
        items = items.select(["doc_id", "piece", "length", "source", "cluster"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        lengths, sources, clusters = (items.column(c).to_pylist() for c in ("length", "source", "cluster"))
        bins, starts = best_fit(lengths, sources, clusters, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)[bins]
        for name, values, kind in (("bin", [(group << 32) + b for b in bins], pa.int64()), ("start", starts, pa.int32()), ("residual", capacity - filled, pa.int32())):
            items = items.append_column(name, pa.array(values, kind))
        return items

    # Arrow columns, as pandas would turn the ids of a group with a null id into doubles
    return dealt.groupBy("group").applyInArrow(pack, "doc_id long, piece int, length int, source string, cluster long, bin long, start int, residual int")
