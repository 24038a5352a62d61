"""Exact search for the most similar vector, leaving out what pivots rule out.

Angles obey the triangle inequality: two vectors at least as similar as a threshold,
whose angle is therefore at most some limit, see every pivot under angles that differ
by no more than that limit. Past vectors are dealt into boxes, by their nearest pivot
and the angle to it, and a box knows the least and the greatest angle of its vectors to
each pivot. Neighbouring boxes make up shares of about equal size. A new vector goes to
the shares only that have a box that it may reach; there it is held against those boxes
only, and in a box against the runs of neighbouring vectors only that it may reach. What
is left out can't reach the threshold; nothing depends on chance but the work.

A vector is sent once to each share at most, and a past one once to each part of the new
ones. Both are SHARES in number, however many vectors there are, until a share would have
more than HELD numbers; so what is shuffled grows with the vectors, not with their square.
The comparisons of vectors that rule out nothing remain those of all pairs.

Pivots are picked from a sample of SAMPLE past vectors, each the farthest from those
before it, so that clusters get pivots of their own. Boxes are at most CELLS x RINGS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.scratch import written

SAMPLE = 2048
PIVOTS = 64
CELLS = 64
RINGS = 16
#: Vectors of one side that are compared at once, and neighbours that are left out or compared together.
BLOCK = 1024
RUN = 64
#: Shares of the past vectors and parts of the new ones, and numbers in one of them from which on there are more.
SHARES = 8
HELD = 8_000_000
#: Radians that angles, which are kept as floats, may be off.
SLACK = 1e-4


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Lists of `size` numbers each, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(rows) @ pivots.T, -1, 1)).astype(np.float32)


def choose_pivots(vectors: DataFrame, key: str, size: int, count: int) -> np.ndarray:
    """Unit vectors, each the farthest of the sample from those chosen before."""
    sample = vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").toArrow()
    rows = unit(matrix(sample["v"], size))
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def _sized(df: DataFrame, key: str, size: int, exact: bool) -> DataFrame:
    """Vectors of that size (exact) or their beginnings, as doubles; those without a direction have no similarity, and without a batch none is lesser."""
    wanted = F.size("v") == size if exact else F.size("v") >= size
    some = df.filter(F.col("v").isNotNull() & F.col("batch").isNotNull() & wanted).withColumn("v", F.transform(F.slice("v", 1, size), lambda x: x.cast("double")))
    return some.filter(F.exists("v", lambda x: x != 0))


def search(new: DataFrame, past: DataFrame, threshold: float) -> DataFrame:
    """Links of new (new_id, v, batch) to the most similar past one (past_id, created_at, v, batch) of a lesser batch in each block.

    Columns new_id, past_id, similarity, created_at; and a row for each block with
    `compared`, the pairs whose similarity it computed, and nothing else. Vectors are
    compared over the length of the new one; there is a search for each such length.
    """
    sizes = [r["n"] for r in new.filter("size(v) > 0").select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    schema = "new_id long, past_id long, similarity double, created_at string, compared long"
    found = new.sparkSession.createDataFrame([], schema)
    for size in sizes:
        found = found.unionByName(_search(_sized(new, "new_id", size, True), _sized(past, "past_id", size, False), threshold, size, schema))
    return found


def _search(new: DataFrame, past: DataFrame, threshold: float, size: int, schema: str) -> DataFrame:
    past = written(past)
    n_past = past.count()
    if not n_past:
        return new.sparkSession.createDataFrame([], schema)
    pivots = choose_pivots(past, "past_id", size, PIVOTS)
    limit = min(math.acos(max(-1.0, min(1.0, threshold))), math.pi / 2) + SLACK  # similarities of zero or less never count
    blocks = max(1, n_past // BLOCK)
    cells = min(CELLS, len(pivots), blocks)
    width = max(limit, math.pi / max(1, min(RINGS, blocks // cells)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seen = angles(matrix(b.column("v"), size), pivots)
                cell = seen[:, :cells].argmin(1)
                ring = (seen[np.arange(len(seen)), cell] / width).astype(np.int64)
                box = pa.array(cell * 64 + ring, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(seen), pa.list_(pa.float32())), box], names=[*b.schema.names, "seen", "box"])

    marked = written(past.mapInArrow(mark, "past_id long, created_at string, v array<double>, batch long, seen array<float>, box long"))
    edges = [f(F.col("seen")[k]).alias(f"{name}{k}") for k in range(len(pivots)) for name, f in (("low", F.min), ("high", F.max))]
    # at most CELLS x RINGS rows
    boxes = marked.groupBy("box").agg(F.count("*").alias("n"), F.min("batch").alias("first"), *edges).orderBy("box").toPandas()
    names, first = boxes["box"].to_numpy(), boxes["first"].to_numpy()
    low, high = (boxes[[f"{side}{k}" for k in range(len(pivots))]].to_numpy() for side in ("low", "high"))
    # a box lies in the shares that its rows, one box after the other, come to lie in
    shares = _shares(n_past, size)
    upto = boxes["n"].cumsum().to_numpy()
    begin, end = (upto - boxes["n"].to_numpy()) * shares // n_past, (upto - 1) * shares // n_past
    holds = (np.arange(shares) >= begin[:, None]) & (np.arange(shares) <= end[:, None])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                seen = angles(matrix(part.column("v"), size), pivots)
                batch = part.column("batch").to_numpy(zero_copy_only=False)
                open_ = ((seen[:, None, :] >= low - limit) & (seen[:, None, :] <= high + limit)).all(2) & (batch[:, None] > first)
                asked = open_.astype(np.float32) @ holds.astype(np.float32) > 0
                ends = np.append(0, np.cumsum(asked.sum(1)))
                shares_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(asked)[1], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, shares_of], names=[*part.schema.names, "_shares"])

    met = written(new.mapInArrow(reach, "new_id long, v array<double>, batch long, _shares array<long>"))
    wanted = met.withColumn("_share", F.explode("_shares")).drop("_shares")
    most = wanted.groupBy("_share").count().agg(F.max("count")).first()[0]
    if not most:
        return new.sparkSession.createDataFrame([], schema)
    parts = _shares(most, size)
    spans = new.sparkSession.createDataFrame(list(zip(names.tolist(), begin.tolist(), (end - begin + 1).tolist())), "box long, _begin long, _span long")
    left = wanted.withColumn("_part", F.pmod(F.xxhash64("new_id"), F.lit(parts)))
    right = marked.drop("seen").join(F.broadcast(spans), "box").withColumn("_share", F.col("_begin") + F.pmod(F.xxhash64("past_id"), F.col("_span"))).drop("_begin", "_span")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, compared = [], 0
        if a.num_rows and b.num_rows:
            a = a.sort_by("batch")
            b = b.sort_by([("created_at", "descending"), ("past_id", "ascending")])  # of equals the first counts
            x, y = unit(matrix(a["v"], size)), unit(matrix(b["v"], size))
            best, at, top = np.zeros(len(x)), np.full(len(x), len(y)), np.zeros(len(x))  # a similarity of zero never counts
            seen_x, seen_y = angles(x, pivots), angles(y, pivots)
            batch_x, batch_y = a["batch"].to_numpy(), b["batch"].to_numpy()
            for own in _boxes(b["box"].to_numpy(), batch_y):
                least, greatest, box_y, box_batch = seen_y[own].min(0), seen_y[own].max(0), y[own], batch_y[own]
                runs = None
                # new vectors are in order of their batches
                for k in range(int(np.searchsorted(batch_x, box_batch[0], "right")), len(x), BLOCK):
                    some = np.arange(k, min(k + BLOCK, len(x)))
                    seen = seen_x[some]
                    upto = int(np.searchsorted(box_batch, batch_x[some[-1]]))
                    if (seen.min(0) >= greatest - limit).all() and (seen.max(0) <= least + limit).all():
                        s = x[some] @ box_y[:upto].T  # no run can be left out
                        compared += s.size
                    else:
                        some = some[((seen >= least - limit) & (seen <= greatest + limit)).all(1)]
                        if not len(some):
                            continue
                        if runs is None:
                            order = np.lexsort(np.argsort(seen_y[own], axis=1)[:, :4].T[::-1])  # neighbours have the same nearest pivots
                            runs = [(r, seen_y[own[r]].min(0) - limit, seen_y[own[r]].max(0) + limit, box_batch[r].min()) for r in (order[i : i + RUN] for i in range(0, len(order), RUN))]
                        s, upto, seen = np.zeros((len(some), len(own))), len(own), seen_x[some]
                        for run, from_, to, early in runs:
                            near = np.flatnonzero(((seen >= from_) & (seen <= to)).all(1) & (batch_x[some] > early))
                            compared += len(near) * len(run)
                            s[np.ix_(near, run)] = x[some[near]] @ box_y[run].T
                    lesser = int(np.searchsorted(box_batch[:upto], batch_x[some[0]]))  # in batches before all of these
                    s[:, lesser:][box_batch[None, lesser:upto] >= batch_x[some][:, None]] = 0
                    # only rows that get to the best so far are looked at
                    better = np.flatnonzero(s.max(1) >= np.maximum(best[some], threshold) - 1e-11)
                    close = s[better]
                    rounded = np.where(close >= threshold, np.round(close, 12), 0)
                    peak = rounded.max(1)
                    column = np.where(rounded == peak[:, None], own[:upto], len(y)).argmin(1)
                    place, held = own[column], some[better]
                    wins = np.flatnonzero((peak > best[held]) | (peak == best[held]) & (place < at[held]))
                    won = held[wins]
                    best[won], at[won], top[won] = peak[wins], place[wins], s[better[wins], column[wins]]
            good = np.flatnonzero((top >= threshold) & (top > 0))
            rows = [a["new_id"].take(pa.array(good)), b["past_id"].take(pa.array(at[good])), pa.array(top[good]), b["created_at"].take(pa.array(at[good]))]
        links = pa.table([*rows, pa.nulls(len(rows[0]), pa.int64())] if rows else [pa.array([], t) for t in kinds], names=columns)
        return pa.concat_tables([links, pa.table([*(pa.nulls(1, t) for t in kinds[:-1]), pa.array([compared], pa.int64())], names=columns)])

    columns = ["new_id", "past_id", "similarity", "created_at", "compared"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64()]
    keys = ["_share", "_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def _shares(rows: int, size: int) -> int:
    """How many shares of `rows` vectors there are: one a BLOCK, SHARES at most, and more only if they would be too large for a task."""
    return max(1, min(SHARES, -(-rows // BLOCK)), -(-rows * size // HELD))


def _boxes(box: np.ndarray, batch: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each box's rows in order of their batches, BLOCK of them at most."""
    order = np.lexsort((batch, box))
    for own in np.split(order, np.flatnonzero(np.diff(box[order])) + 1):
        for k in range(0, len(own), BLOCK):
            yield own[k : k + BLOCK]
