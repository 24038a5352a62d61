"""Day and scope conditions shared by the queries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Optional equalities; None is absent, the empty string is a value."""

    label: str | None = None
    project_dir: str | None = None
    session_id: str | None = None

    def condition(self) -> Column:
        found = F.lit(True)
        for name in ("label", "project_dir", "session_id"):
            value = getattr(self, name)
            if value is not None:
                found = found & (F.col(name) == value)
        return found


EVERYTHING = Scope()


@dataclass(frozen=True)
class Days:
    """One day, or both ends of a range, as YYYY-MM-DD."""

    first: str
    last: str | None = None

    def condition(self, column: str = "date") -> Column:
        return F.col(column) == self.first if self.last is None else F.col(column).between(self.first, self.last)


def trailing(as_of: str, days: int, column: str = "date") -> Column:
    """From `days` before as_of on, inclusive."""
    return F.col(column) >= (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()


def instant_cutoff(now: datetime, days: int) -> str:
    """An instant, as ISO text with milliseconds, to compare created_at with."""
    return (now.astimezone(timezone.utc) - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"


def day_cutoff(now: datetime, days: int) -> str:
    """A bare UTC day, so that all of that day is within."""
    return (now.astimezone(timezone.utc) - timedelta(days=days)).strftime("%Y-%m-%d")
