"""Questions to models: asked once, by few tasks at a time, and remembered.

A question is a JSON text. Its name is a hash of what kind of question it is, which
version of the model is asked, and the text; an answer that is known by that name is
taken over, and equal questions are asked once. The rest go to a stage of as many tasks
as calls may run at once (E10). They are asked in slices, each remembered before the
next begins, so that a run that breaks off asks at most one slice again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.scratch import written

#: Questions of a slice.
SLICE = 2000
#: JSON with all fields, also null ones.
FULL = {"ignoreNullFields": "false"}
ANSWERS = "kind string, name string, answer string"


@dataclass
class Asking:
    """How to ask: at most `concurrency` calls at once; `known` gives remembered answers (kind, name, answer) and `keep` takes new ones."""

    concurrency: int = 5
    version: str = ""
    known: Callable[[], DataFrame] | None = None
    keep: Callable[[DataFrame], None] | None = None


def ask(questions: DataFrame, model: Callable, kind: str, how: Asking) -> DataFrame:
    """questions (with a column `question`, JSON or null) and `answer`: JSON of what model(json.loads(question)) gave, null where it failed.

    What can't be written as JSON counts as a failure. Failures aren't remembered. If a
    slice takes its tasks down, the others are still asked and remembered before the
    error is raised.
    """
    text = F.concat_ws("\x1f", F.lit(kind), F.lit(how.version), F.col("question"))
    named = written(questions.withColumn("_name", F.sha2(text, 256)))
    known = how.known().filter(F.col("kind") == kind).select(F.col("name").alias("_name"), "answer") if how.known else named.select("_name", F.lit("").alias("answer")).limit(0)
    # of all that is remembered only what is asked now goes on
    known = known.join(named.select("_name").distinct(), "_name", "left_semi").dropDuplicates(["_name"])
    fresh = written(named.filter("question IS NOT NULL").select("_name", "question").dropDuplicates(["_name"]).join(known, "_name", "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, question in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    answer = json.dumps(model(json.loads(question)))
                except Exception:  # noqa: BLE001  a model that fails has no answer
                    answer = None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([answer], pa.string())], names=["_name", "answer"])

    n = fresh.count()
    slices, failure, answers = -(-n // SLICE), None, known
    for k in range(slices):
        part = fresh.filter(F.pmod(F.xxhash64("_name"), F.lit(slices)) == k).repartition(how.concurrency)
        try:
            found = written(part.mapInArrow(run, "_name string, answer string").filter("answer IS NOT NULL"))
        except Exception as e:  # noqa: BLE001  raised below
            failure = e
            continue
        if how.keep and not found.isEmpty():
            how.keep(found.select(F.lit(kind).alias("kind"), F.col("_name").alias("name"), "answer"))
        answers = answers.unionByName(found)
    if failure is not None:
        raise failure
    return written(named.join(answers, "_name", "left").drop("_name"))


def read_answers(answered: DataFrame, keys: list[str], schema: str, read: Callable[[object], list[tuple]]) -> DataFrame:
    """Rows that `read` makes of each answer, after the columns `keys` of its question; an answer of null gives none."""
    types = {f.name: f.dataType.simpleString() for f in answered.schema.fields}
    whole = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    names = [*keys, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*key, *row) for *key, answer in zip(*[b.column(k).to_pylist() for k in [*keys, "answer"]], strict=True) if answer is not None for row in read(json.loads(answer))]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([*[b.schema.field(k) for k in keys], *kinds]))

    kinds = [pa.field(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[x.split()[1]]) for x in schema.split(", ")]
    return answered.select(*keys, "answer").mapInArrow(run, whole)
