"""Formatting and small date rules on the driver."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal


def fixed(x: float, places: int = 1) -> str:
    """The binary value rounded half up at a number of places."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def percent(ratio: float) -> str:
    return f"{math.floor(ratio * 100 + 0.5)}%"


def run_label(now: datetime) -> str:
    return now.strftime("run-%Y%m%dT%H%M%SZ")


def shift_date(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def preset_range(preset: str, latest: str, custom: tuple[str, str] | None = None) -> tuple[str, str]:
    """today, 7d and 30d end at the latest day with data; custom is as given."""
    if preset == "custom":
        if not custom:
            raise ValueError("a custom range needs two days")
        return custom
    return shift_date(latest, -{"today": 0, "7d": 6, "30d": 29}[preset]), latest


def elapsed_days(first: str, last: str) -> int:
    return (date.fromisoformat(last) - date.fromisoformat(first)).days


#: Least ratios of the two upper grades, and the shortest run that is worth a line.
GRADES = ((1.5, "strong"), (0.7, "even"))
RUN_WORTH_TELLING = 3


def engagement_grade(ratio: float | None) -> str:
    """Clear (nothing flagged), strong, even or weak."""
    if ratio is None:
        return "clear"
    return next((name for least, name in GRADES if ratio >= least), "weak")


def engagement_summary(b: dict, top_theme: tuple[str, int] | None = None) -> list[str]:
    """Lines on a breakdown: its grade, a run of flagged turns from 3 on, the commonest theme, and the good turns; none without turns."""
    if not b["total"]:
        return []
    ratio, run = b["engagement_ratio"], b["longest_directive_burst"]
    lines = [f"Engagement: {engagement_grade(ratio)}" + ("" if ratio is None else f" (ratio {fixed(ratio)})") + f" over {b['total']} turns"]
    if run >= RUN_WORTH_TELLING:
        lines.append(f"Longest run of unneeded directives: {run}")
    if top_theme and top_theme[1]:
        lines.append(f"Commonest theme: {top_theme[0].replace('-', ' ')}, {top_theme[1]} turns")
    lines.append(f"Good turns: {b['deliberative']} deliberative, {b['corrective']} corrective")
    return lines
