"""Model-backed steps. Models are injected callables, asked through `asking.ask`.

A model gets a list of dicts and answers with a list of dicts. Failures stay
inside the episode, batch or run they happen in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.asking import FULL, Asking, ask, read_answers
from loomline.operators.turns import first_classification, prefilter
from loomline.schema import CATEGORIES, EFFORT_CLASSES, ENGAGEMENT_CLASSES
from loomline.sources.scratch import written

Model = Callable[[list[dict]], list[dict]]

SCORING_BATCH = 40
FEWEST_LINES = 20
FEWEST_PAIRS = 4
CANDIDATE = "episode_key string, pos int, category string, text string, evidence_ref string, evidence_snippet string"
#: What a scoring model is told of a candidate.
CONTENT = ("category", "text", "evidence_ref", "evidence_snippet")
TURN = "episode_id long, human_line_number int, classification string, directive_necessary boolean, reason string, emit_pos int"
DERIVED = "label string, insight_type string, text string, evidence_insight_ids array<long>"


class Truncated(Exception):
    """A model's answer was cut off."""


def bisect(model: Model, items: list[dict], fewest: int) -> list[dict]:
    """On a truncated answer both halves are asked, down to a least size; below it the failure stands."""
    try:
        return model(items)
    except Truncated:
        if len(items) <= fewest:
            raise
        middle = len(items) // 2
        return bisect(model, items[:middle], fewest) + bisect(model, items[middle:], fewest)


def _among(x: object, known: Iterable) -> bool:
    """Whether x is text or a number among the known ones; other kinds of answers never are."""
    return isinstance(x, (str, int)) and not isinstance(x, bool) and x in known


def _number(x: object) -> bool:
    """Whether x is a finite number; true and false are none."""
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def generate_candidates(lines: DataFrame, model: Model, how: Asking = Asking()) -> DataFrame:
    """Candidates of each episode (episode_key, line_number, type, text); a bad item is left out, a failed episode has none."""

    def read(answer: object) -> list[tuple]:
        good = [a for a in answer if isinstance(a, dict) and _among(a.get("category"), CATEGORIES) and isinstance(a.get("text"), str)] if isinstance(answer, list) else []
        return [(i, a["category"], a["text"], _text(a.get("evidence_ref")), _text(a.get("evidence_snippet"))) for i, a in enumerate(good)]

    asked = F.sort_array(F.collect_list(F.struct("line_number", "type", "text")))
    questions = lines.groupBy("episode_key").agg(F.to_json(asked, FULL).alias("question"))
    answered = ask(questions, lambda items: bisect(model, items, FEWEST_LINES), "candidates", how)
    return read_answers(answered, ["episode_key"], CANDIDATE.removeprefix("episode_key string, "), read)


def scoring_batches(candidates: DataFrame, day: str = "batch_day") -> DataFrame:
    """Adds `batch` and `index`, the place in it; the candidates of a (session, day) in order, 40 a batch."""
    place = F.row_number().over(Window.partitionBy(day).orderBy("episode_key", "pos")) - 1
    return candidates.withColumn("_place", place).withColumns({"batch": F.concat_ws("/", F.col(day), F.floor(F.col("_place") / SCORING_BATCH).cast("string")), "index": (F.col("_place") % SCORING_BATCH).cast("int")}).drop("_place")


def score_candidates(batched: DataFrame, model: Model, how: Asking = Asking(3)) -> DataFrame:
    """Candidates with significance and effort class; any invalid answer fails its batch, and only that.

    An answer is invalid if its index is no place in the batch or comes twice, if its
    significance is no finite number, or if its effort class is unknown. The model gets
    what the candidates say (CONTENT), in order, and neither keys nor numbers of a run.
    recurrence_of is always null here; links come from vectors.
    """
    batched = written(batched)

    def read(answer: object) -> list[tuple]:
        size, given = answer
        kept = []
        for a in given if isinstance(given, list) else [None]:
            if not isinstance(a, dict) or not _among(a.get("effort_class"), EFFORT_CLASSES) or not _number(a.get("significance_score")) or type(a.get("index")) is not int or not 0 <= a["index"] < size:
                return []
            kept.append((a["index"], float(a["significance_score"]), a["effort_class"]))
        return kept if len({k[0] for k in kept}) == len(kept) else []

    content = [c for c in CONTENT if c in batched.columns]
    rows = F.sort_array(F.collect_list(F.struct("index", F.struct(*content).alias("c"))))
    questions = batched.groupBy("batch").agg(F.to_json(F.transform(rows, lambda r: r["c"]), FULL).alias("question"))
    answered = ask(questions, lambda items: (len(items), model(items)), "scores", how)
    scores = read_answers(answered, ["batch"], "index int, significance_score double, effort_class string", read)
    return batched.join(scores, ["batch", "index"]).withColumn("recurrence_of", F.lit(None).cast("long"))


def classify_turns(pairs: DataFrame, model: Model, how: Asking = Asking()) -> DataFrame:
    """Engagement of each pair; acknowledgments are known without the model, the first answer per line stays."""
    marked = written(prefilter(pairs))
    acks = marked.filter("is_acknowledgment").select(
        "episode_id", "human_line_number", F.lit("acknowledgment").alias("classification"), F.lit(None).cast("boolean").alias("directive_necessary"), F.lit("").alias("reason"), F.lit(0).alias("emit_pos")
    )

    def classify(items: list[dict]) -> list:
        return [[p["human_line_number"] for p in items], bisect(model, items, FEWEST_PAIRS)]

    def read(answer: object) -> list[tuple]:
        known, given = answer
        return [
            (a["human_line_number"], a["classification"], a.get("directive_necessary"), str(a.get("reason") or ""), i)
            for i, a in enumerate(given if isinstance(given, list) else [])
            if isinstance(a, dict) and _among(a.get("classification"), ENGAGEMENT_CLASSES) and _among(a.get("human_line_number"), known) and (a.get("directive_necessary") is None or isinstance(a["directive_necessary"], bool))
        ]

    content = ["human_line_number", *(c for c in marked.columns if c not in ("human_line_number", "episode_id", "is_acknowledgment"))]
    questions = marked.filter("NOT is_acknowledgment").groupBy("episode_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*content))), FULL).alias("question"))
    asked = read_answers(ask(questions, classify, "turns", how), ["episode_id"], TURN.removeprefix("episode_id long, "), read)
    return first_classification(acks.unionByName(asked.withColumn("episode_id", F.col("episode_id").cast("long")))).drop("emit_pos")


def derive_insights(items: DataFrame, model: Model) -> DataFrame:
    """Derived insights of each run; one that cites an unknown id is dropped, one without ids stays. Malformed answers and items count for nothing; it never raises."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = set(group["id"].tolist())
        try:
            answer = model(group.sort_values("created_at").to_dict("records"))
            answer = answer if isinstance(answer, list) else []
        except Exception:  # noqa: BLE001  a run that fails has no derived insights
            answer = []

        def cited(a: object) -> list | None:
            """The ids that an item cites; None for an item that doesn't count."""
            if not (isinstance(a, dict) and isinstance(a.get("insight_type"), str) and isinstance(a.get("text"), str)):
                return None
            found = a.get("evidence_insight_ids") or []
            return list(found) if isinstance(found, list) and all(_among(x, ids) for x in found) else None

        rows = [(group["label"].iloc[0], a["insight_type"], a["text"], cited(a)) for a in answer if cited(a) is not None]
        return pd.DataFrame(rows, columns=["label", "insight_type", "text", "evidence_insight_ids"])

    return items.select("label", "id", "category", "text", "created_at").groupBy("label").applyInPandas(run, DERIVED)


def narrative(insights: list[dict], effort: dict, model: Callable[[list[dict], dict], str] | None) -> str | None:
    """M5: a paragraph on a day, or None without insights, a model or an answer."""
    if model is None or not insights:
        return None
    try:
        return model(insights, effort) or None
    except Exception:  # noqa: BLE001  a brief goes without its narrative
        return None
