"""F8: request parameters as texts to values; what isn't valid raises ValueError."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date

from loomline.functions.formatting import preset_range
from loomline.operators.scope import Days, Scope

MAX_SEARCH = 20
PRESETS = ("today", "7d", "30d")


def parse_date(text: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or ""):
        raise ValueError(f"not a day: {text!r}")
    return date.fromisoformat(text).isoformat()


def parse_positive(text: str | None, default: int) -> int:
    if not text:
        return default
    if not re.fullmatch(r"[0-9]+", text) or int(text) == 0:
        raise ValueError(f"not a positive number: {text!r}")
    return int(text)


def parse_days(params: Mapping[str, str], latest: str | None = None) -> Days:
    """A preset (today, 7d or 30d, up to the latest day with data) comes first; either end of a range asks for both and comes before a single day."""
    if params.get("range"):
        if params["range"] not in PRESETS or not latest:
            raise ValueError(f"not a range: {params['range']!r}")
        return Days(*preset_range(params["range"], latest))
    if params.get("fromDate") or params.get("toDate"):
        first, last = parse_date(params.get("fromDate", "")), parse_date(params.get("toDate", ""))
        if first > last:
            raise ValueError("the range ends before it begins")
        return Days(first, last)
    return Days(parse_date(params.get("date", "")))


def parse_scope(params: Mapping[str, str]) -> Scope:
    return Scope(params.get("label"), params.get("project"), params.get("session"))


def parse_search_limit(text: str | None) -> int:
    return min(parse_positive(text, MAX_SEARCH), MAX_SEARCH)
