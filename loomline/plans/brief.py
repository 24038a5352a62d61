"""The daily brief: small aggregates collected and written as markdown."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from loomline.functions.formatting import elapsed_days, fixed, percent
from loomline.operators import engagement, insights, recurrence
from loomline.operators.models import narrative
from loomline.operators.scope import Days
from loomline.schema import CATEGORIES, CATEGORY_TITLES

TOP = 5
CHAIN_DAYS = 30


# Headings and sentences of a brief.
HEADINGS = {
    "effort": "Effort Breakdown",
    "engagement": "Engagement Pattern",
    "top": "Top Insights Today",
    "chains": "Recurring Patterns",
    "projects": "By Project",
}
EFFORT = "{judgment} judgment, {toil} toil, {overhead} overhead ({total} insights today)"
NONE_FLAGGED = "No unprompted babysitting detected today ({deliberative} deliberative, {corrective} corrective, {directive_necessary} necessary directive turns)."
RATIO = "{ratio}x good-engagement-to-babysitting ratio — {deliberative} deliberative + {corrective} corrective turns vs. {directive_unnecessary} unnecessary directive (babysitting) turns"
GATES = " ({directive_necessary} more directive turns were necessary gates, not counted as babysitting)"
STREAK = "Longest babysitting streak: {longest_directive_burst} turns in a row."
FLAGGED = "Recent babysitting turns flagged:"
FLAG = "- (line {human_line_number}) {reason}"
CHAIN = "- {first_text} — recurred {chain_length} times over {days} days (first seen {first_date})"
PROJECT = "- {project_dir}: {insight_count} insights"
VERIFIED, SEEN_ON, SEEN = " ✓ (verified)", " (recurring — also seen on {recurrence_date})", " (recurring)"


def _engagement(b: dict, flagged: Sequence[dict]) -> list[str]:
    if b["engagement_ratio"] is None:
        return [NONE_FLAGGED.format(**b)]
    lines = [RATIO.format(ratio=fixed(b["engagement_ratio"]), **b) + (GATES.format(**b) if b["directive_necessary"] > 0 else "")]
    lines += [STREAK.format(**b)] * (b["longest_directive_burst"] > 1)
    return lines + (["", FLAGGED, *[FLAG.format(**f) for f in flagged]] if flagged else [])


def _item(i: dict) -> str:
    return i["text"] + (f" _({i['evidence_ref']})_" if i["evidence_ref"] else "") + f" [{fixed(i['significance_score'])}]"


def _listed(i: dict) -> str:
    seen = "" if i["recurrence_of"] is None else SEEN_ON.format(**i) if i.get("recurrence_date") else SEEN
    return "- " + _item(i) + VERIFIED * bool(i["verified_by_git"]) + seen


def render_brief(
    day: str, items: list[dict], top: list[dict] = (), chains: list[dict] = (), rollup: list[dict] = (), effort: dict | None = None, paragraph: str | None = None, engaged: dict | None = None, flagged: list[dict] = (), title: str = "Daily Brief"
) -> str:
    """Sections in a fixed order, empty ones left out; projects only if there are two or more."""
    share = {k: percent(effort[k + "_ratio"]) for k in ("judgment", "toil", "overhead")} if effort else {}
    sections = {
        HEADINGS["effort"]: [EFFORT.format(total=effort["total"], **share)] if effort and effort["total"] > 0 else [],
        HEADINGS["engagement"]: _engagement(engaged, flagged) if engaged and engaged["total"] > 0 else [],
        HEADINGS["top"]: [f"{n}. {_item(i)}" for n, i in enumerate(top, 1)],
        HEADINGS["chains"]: [CHAIN.format(days=elapsed_days(c["first_date"], c["last_date"]), **c) for c in chains],
        HEADINGS["projects"]: [PROJECT.format(**r) for r in rollup] if len(rollup) > 1 else [],
        **{heading: [_listed(i) for i in items if i["category"] == category] for category, heading in zip(CATEGORIES, CATEGORY_TITLES, strict=True)},
    }
    lines = [f"# {title} — {day}\n"] + ([paragraph, ""] if paragraph else [])
    for heading, body in sections.items():
        if body:
            lines += [f"## {heading}\n", *body, ""]
    return "\n".join(lines)


def write_brief(tables: Mapping[str, DataFrame], day: str, folder: str, model: Callable | None = None, title: str = "Daily Brief") -> str:
    """K8: the brief of one day, written over an older one; its path. What is collected is a day's report."""
    i, e, t = tables["insights"], tables["episodes"], tables["engagement_turns"]
    rows = lambda df: [r.asDict() for r in df.collect()]
    one = Days(day)
    items, effort = rows(insights.brief_insights(i, e, day)), rows(insights.effort_breakdown(i, e, one))[0]
    text = render_brief(
        day,
        items,
        rows(insights.top_insights(i, e, one, TOP)),
        rows(recurrence.recurrence_chains(i, e, day, CHAIN_DAYS)),
        rows(insights.cross_project(i, e, one)),
        effort,
        narrative(items, effort, model),
        rows(engagement.engagement_breakdown(t, e, one))[0],
        rows(engagement.flagged_directives(t, e, one)),
        title,
    )
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{day}.md"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def list_briefs(folder: str) -> list[str]:
    """The days that have a brief, latest first."""
    return sorted((n.removesuffix(".md") for n in os.listdir(folder) if n.endswith(".md")), reverse=True) if os.path.isdir(folder) else []


def read_brief(folder: str, day: str) -> str | None:
    """A day's brief or None; a day that isn't one raises ValueError."""
    from loomline.plans.requests import parse_date

    path = f"{folder}/{parse_date(day)}.md"
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()
