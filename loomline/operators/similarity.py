"""Vectors: cosine similarity, greedy de-duplication and links to earlier items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import pruned
from loomline.operators.asking import Asking, ask
from loomline.operators.ranges import rank_within
from loomline.sources.scratch import written

DEDUPE_AT = 0.95
RECUR_AT = 0.90
BLOCK = 1024
#: As many new vectors at most are sent to all tasks; more are dealt to what they may reach.
LITTLE = 4 * BLOCK
#: Rows of a batch that one task de-duplicates; of larger ones a round gives HEAD open rows, in whole chunks, to a task.
LOCAL = 4096
HEAD = 4096
CHUNK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Over a's length; 0 for an empty vector or a zero norm, null where b is shorter."""
    b = F.slice(b, 1, F.size(a))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(b) < F.size(a), None).when((F.size(a) == 0) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def valid_vector(v: object) -> list[float] | None:
    """v if it is a list of finite numbers, else None."""
    if not isinstance(v, (list, tuple, np.ndarray)) or any(isinstance(x, (bool, np.bool_)) or not isinstance(x, (int, float, np.integer, np.floating)) for x in v):
        return None
    found = [float(x) for x in v]
    return found if found and np.isfinite(found).all() else None


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float] | None]], text: str = "text", how: Asking = Asking()) -> DataFrame:
    """Adds `embedding`; a provider that fails, or answers anything but a list of finite numbers, leaves null. Equal texts are asked once."""

    def one(asked: str) -> list[float]:
        found = provider([asked])
        vector = valid_vector(found[0]) if len(found) == 1 else None
        if vector is None:
            raise ValueError("no vector")
        return vector

    answered = ask(rows.withColumn("question", F.to_json(F.array(text))).withColumn("question", F.when(F.col(text).isNotNull(), F.expr("substr(question, 2, length(question) - 2)"))), one, "vectors", how)
    return answered.withColumn("embedding", F.from_json("answer", "array<double>")).drop("question", "answer")


def _unit_rows(vectors: list) -> np.ndarray:
    """Vectors as rows of length one, shorter ones filled up with zeros."""
    size = max(map(len, vectors), default=0)
    unit = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        n = np.linalg.norm(np.asarray(v, float))
        unit[k, : len(v)] = np.asarray(v, float) / n if n else 0
    return unit


def leader_of(unit: np.ndarray, threshold: float) -> np.ndarray:
    """For rows in order the row that leads each: the first that leads itself and is at least `threshold` similar to it."""
    leader = np.full(len(unit), -1)
    for k in range(len(unit)):
        if leader[k] < 0:
            free = np.flatnonzero(leader[k + 1 :] < 0) + k + 1
            leader[k] = k
            leader[free[unit[free] @ unit[k] >= threshold]] = k
    return leader


def leaders(pos: list[int], scores: list[float], vectors: list, threshold: float) -> list[int]:
    """Greedy leader clustering: indices of the survivors, in the order of their leaders.

    In order of position each item not yet taken leads and takes the later items
    at least `threshold` similar to it. The strictly greatest score survives, the
    earlier on ties. Items without a vector stay as they are.
    """
    order = sorted(range(len(pos)), key=pos.__getitem__)
    have = [i for i in order if vectors[i] is not None]
    led = dict(zip(have, leader_of(_unit_rows([vectors[i] for i in have]), threshold).tolist(), strict=True))
    best: dict[int, int] = {}
    for i in order:
        head = have[led[i]] if i in led else i
        if head not in best or scores[i] > scores[best[head]]:
            best[head] = i
    return list(best.values())


def greedy_dedupe(items: DataFrame, batch: str, threshold: float = DEDUPE_AT, pos: str = "pos") -> DataFrame:
    """Within each batch one survivor per leader; `place` is the leader's rank in the batch.

    A batch (the insights of one day of one session) of up to LOCAL rows is one group;
    batches run side by side. The leaders of larger ones are found in rounds.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", place int"

    def run(group: pa.Table) -> pa.Table:
        vectors = [v or None for v in group.column("embedding").to_pylist()]
        kept = leaders(group.column(pos).to_pylist(), group.column("significance_score").to_pylist(), vectors, threshold)
        return group.take(kept).append_column("place", pa.array(range(len(kept)), pa.int32()))

    large = written(items.groupBy(F.col(batch).alias("_large")).count().filter(F.col("count") > LOCAL).select("_large"))
    # Arrow columns, as pandas would turn the ids of a batch with a null id into doubles
    if large.isEmpty():
        return items.groupBy(batch).applyInArrow(run, schema)
    is_large = items[batch].eqNullSafe(large["_large"])
    rest = items.join(large, is_large, "left_anti").groupBy(batch).applyInArrow(run, schema)
    return rest.unionByName(_dedupe_in_rounds(items.join(large, is_large, "left_semi"), batch, threshold, pos))


def _dedupe_in_rounds(items: DataFrame, batch: str, threshold: float, pos: str) -> DataFrame:
    """greedy_dedupe of batches of any size, by rounds.

    A round takes the first items of each batch that are still open, about HEAD of them,
    lets one task find the leaders among them, and holds all later open items of the
    batch against these leaders, in parallel. What a leader takes is never looked at
    again, so a batch takes as many rounds as its leaders, and what they took at once,
    fill such heads. Comparisons are those of the greedy loop; no pairs are listed.
    """
    ranked = written(rank_within(items.withColumn("_batch", F.xxhash64(F.col(batch).cast("string"))), ["_batch"], [pos], "_rank"))
    blank = F.coalesce(F.size("embedding"), F.lit(0)) <= 0
    open_ = written(ranked.filter(~blank).select("_batch", "_rank", F.floor(F.col("_rank") / CHUNK).alias("_chunk"), "embedding"))
    decided = ranked.filter(blank).select("_batch", "_rank", F.col("_rank").alias("_leader"))
    found = "_batch long, _rank long, _leader long"

    def lead(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rank")
        led = leader_of(_unit_rows(group["embedding"].to_pylist()), threshold)
        return pa.table([group["_batch"], group["_rank"], group["_rank"].take(pa.array(led))], names=["_batch", "_rank", "_leader"])

    def follow(heads: pa.Table, later: pa.Table) -> pa.Table:
        heads = heads.sort_by("_leader")
        rows = [[], [], []]
        if heads.num_rows and later.num_rows:
            both = _unit_rows(heads["embedding"].to_pylist() + later["embedding"].to_pylist())
            similar = both[heads.num_rows :] @ both[: heads.num_rows].T >= threshold
            taken = pa.array(np.flatnonzero(similar.any(1)))
            rows = [later["_batch"].take(taken), later["_rank"].take(taken), heads["_leader"].take(pa.array(similar.argmax(1))).take(taken)]
        return pa.table([pa.chunked_array(r, pa.int64()) if not isinstance(r, list) else pa.array(r, pa.int64()) for r in rows], names=["_batch", "_rank", "_leader"])

    while not open_.isEmpty():
        counts = open_.groupBy("_batch", "_chunk").count()
        before = Window.partitionBy("_batch").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        taken = F.coalesce(F.sum("count").over(before), F.lit(0))
        heads = counts.filter("count > 0").withColumn("_before", taken).filter((F.col("_before") == 0) | (F.col("_before") + F.col("count") <= HEAD)).groupBy("_batch").agg(F.max("_chunk").alias("_upto"))
        split = open_.join(written(heads), "_batch")
        first = written(split.filter("_chunk <= _upto").drop("_upto").groupBy("_batch").applyInArrow(lead, found))
        later = written(split.filter("_chunk > _upto").drop("_upto"))
        chiefs = written(first.filter("_rank = _leader").drop("_leader").join(open_.drop("_chunk"), ["_batch", "_rank"]).withColumnRenamed("_rank", "_leader"))
        # each chunk that is still open meets the leaders of its batch
        sent = written(chiefs.join(later.select("_batch", "_chunk").distinct(), "_batch"))
        keys = ["_batch", "_chunk"]
        followed = written(sent.groupBy(*keys).cogroup(later.groupBy(*keys)).applyInArrow(follow, found))
        decided = decided.unionByName(first).unionByName(followed)
        open_ = written(later.join(followed.select("_batch", "_rank"), ["_batch", "_rank"], "left_anti"))
    led = ranked.select("_batch", "_rank", "significance_score").join(decided, ["_batch", "_rank"])
    best = F.max_by("_rank", F.struct("significance_score", -F.col("_rank")))
    kept = rank_within(led.groupBy("_batch", "_leader").agg(best.alias("_rank")), ["_batch"], ["_leader"], "place")
    return ranked.join(kept.select("_batch", "_rank", F.col("place").cast("int").alias("place")), ["_batch", "_rank"]).select(*items.columns, "place")


def nearest_earlier(new: DataFrame, past: DataFrame, threshold: float = RECUR_AT, batch: str | None = None) -> DataFrame:
    """new_id, past_id and similarity of each new item's most similar past one at or over the threshold.

    With `batch`, a numeric column of both, only items of lesser batches are past.

    Up to LITTLE new items, as those of a run against a whole history, are broadcast, and
    past ones (past_id, created_at, embedding) are scanned once without a shuffle. More
    are held against those past ones only that pivots don't rule out (`pruned.search`).
    Ties go to the latest past item; similarities of zero or less never count.
    """
    new, past = _placed(new, "new_id", batch, 1), _placed(past, "past_id", batch, 0, "created_at")
    if (rows := new.count()) <= LITTLE:
        found = _scan(new, past, threshold, rows)
    else:
        found = pruned.search(new, past, threshold).filter("compared IS NULL")
    best = F.max_by(F.struct("past_id", "similarity"), F.struct(F.round("similarity", 12), "created_at", -F.col("past_id")))
    return found.groupBy("new_id").agg(best.alias("b")).select("new_id", "b.past_id", "b.similarity")


def pairs_compared(new: DataFrame, past: DataFrame, threshold: float = RECUR_AT, batch: str | None = None) -> int:
    """How many pairs a pruned search computes the similarity of."""
    found = pruned.search(_placed(new, "new_id", batch, 1), _placed(past, "past_id", batch, 0, "created_at"), threshold)
    return found.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]


def _placed(rows: DataFrame, key: str, batch: str | None, otherwise: int, *more: str) -> DataFrame:
    return rows.select(key, *more, F.col("embedding").alias("v"), (F.col(batch) if batch else F.lit(otherwise)).cast("long").alias("batch"))


def _scan(new: DataFrame, past: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Few new items, broadcast in blocks, against every past one."""
    held = new.toArrow().to_pandas()
    shared = new.sparkSession.sparkContext.broadcast([held[k : k + BLOCK] for k in range(0, rows, BLOCK)])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        b = b.sort_values(["created_at", "past_id"], ascending=[False, True])
        for size, group in a[a["v"].notna()].groupby(a["v"].map(lambda v: 0 if v is None else len(v))):
            fits = b[b["v"].map(lambda w: w is not None and len(w) >= size)]
            if not size or fits.empty:
                continue
            x = np.stack([np.asarray(v, float) for v in group["v"]])
            y = np.stack([np.asarray(w, float)[: int(size)] for w in fits["v"]])
            norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
            s = np.divide(x @ y.T, norms, out=np.zeros(norms.shape), where=norms > 0)
            s[~(fits["batch"].to_numpy()[None, :] < group["batch"].to_numpy()[:, None])] = 0  # a similarity of zero never counts
            best = np.round(s, 12).argmax(1)
            for i, k in enumerate(best):
                if s[i, k] >= threshold and s[i, k] > 0:
                    found.append((group["new_id"].iloc[i], fits["past_id"].iloc[k], s[i, k], fits["created_at"].iloc[k]))
        return pd.DataFrame(found, columns=["new_id", "past_id", "similarity", "created_at"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK).to_pandas()
                for block in shared.value:
                    links = compare(block, part)
                    if len(links):
                        yield pa.RecordBatch.from_pandas(links, preserve_index=False)

    return past.mapInArrow(scan, "new_id long, past_id long, similarity double, created_at string")


def apply_recurrence(items: DataFrame, past: DataFrame, batch: str, dedupe_at: float = DEDUPE_AT, recur_at: float = RECUR_AT, enabled: bool = True, earlier_batches: bool = False) -> DataFrame:
    """De-duplicate a batch, then link each survivor (`id`) to its nearest earlier item; off, items pass through.

    With earlier_batches only those of the past items (with a column `batch`) count that lie in an earlier batch.
    """
    if not enabled:
        return items.withColumn("recurrence_of", F.lit(None).cast("long"))
    kept = written(greedy_dedupe(items, batch, dedupe_at))  # read three times below
    links = nearest_earlier(kept.select(F.col("id").alias("new_id"), batch, "embedding"), past, recur_at, batch if earlier_batches else None)
    return kept.join(links.select(F.col("new_id").alias("id"), F.col("past_id").alias("recurrence_of")), "id", "left")
