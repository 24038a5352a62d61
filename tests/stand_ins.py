"""Deterministic stand-ins for models, by rules; workers get them by value."""

from pyspark import cloudpickle

from loomline.plans import analyze
from loomline.schema import CATEGORIES, EFFORT_CLASSES


def extractor(lines: list[dict]) -> list[dict]:
    """One candidate per long user line, its category by the line's length."""
    return [{"category": CATEGORIES[len(x["text"]) % len(CATEGORIES)], "text": x["text"][:120], "evidence_ref": f"line {x['line_number']}", "evidence_snippet": x["text"][:40]} for x in lines if x["type"] == "user" and len(x["text"]) >= 20]


def scorer(candidates: list[dict]) -> list[dict]:
    return [{"index": i, "significance_score": 1 + len(c["text"]) % 5, "effort_class": EFFORT_CLASSES[len(c["text"]) % 3]} for i, c in enumerate(candidates)]


def classifier(pairs: list[dict]) -> list[dict]:
    def one(p: dict) -> dict:
        if p["directive_hint"]:
            return {"classification": "directive", "directive_necessary": bool(p["agent_asked_question"]), "reason": "instructed a command"}
        return {"classification": "corrective" if "wrong" in p["human_turn_text"].lower() else "deliberative", "directive_necessary": None, "reason": "by rule"}

    return [{"human_line_number": p["human_line_number"], **one(p)} for p in pairs]


def embedder(texts: list[str]) -> list[list[float] | None]:
    """Letter counts."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] if t else None for t in texts]


def deriver(items: list[dict]) -> list[dict]:
    return [{"insight_type": "pattern", "text": f"{len(items)} work items", "evidence_insight_ids": [i["id"] for i in items]}]


def all_of(**other):
    """Models of a run, some of them others."""
    return analyze.Models(**{"extractor": extractor, "scorer": scorer, "classifier": classifier, "embedder": embedder, **other})


cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["x"]))
