"""Episodes over a stream of lines: the batch rules of gaps, days and compaction, with state per session."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators.sessionize import GAP_MINUTES

OUTPUT = "project_dir string, session_id string, line_number int, date string, part int"


def assign_parts(lines: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Each streamed line (project_dir, session_id, line_number, ts, date, is_compact) with its episode number in its day.

    State per session is one row per day seen: its last line's time and its
    episode number. Lines of a micro-batch are taken in order of line number. A
    compact line closes the episode of the line before it, as the batch does for
    a boundary inside one day. Lines without a time or day are left out, as in the batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days: dict[str, tuple[datetime, int]] = {d: (t, p) for d, t, p in zip(*state.get, strict=True)} if state.exists else {}
        rows = []
        for batch in batches:
            for r in batch.dropna(subset=["ts", "date"]).sort_values("line_number").itertuples():
                seen = days.get(r.date)
                part = 0 if seen is None else seen[1] + int((r.ts - seen[0]).total_seconds() > gap_minutes * 60 or r.is_compact)
                days[r.date] = (r.ts, part)
                rows.append((*key, r.line_number, r.date, part))
        kept = sorted(days)
        state.update((kept, [days[d][0] for d in kept], [days[d][1] for d in kept]))
        yield pd.DataFrame(rows, columns=["project_dir", "session_id", "line_number", "date", "part"])

    return lines.groupBy("project_dir", "session_id").applyInPandasWithState(step, OUTPUT, "dates array<string>, lasts array<timestamp>, parts array<int>", "append", GroupStateTimeout.NoTimeout)


def event_rates(lines: DataFrame, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Lines per project in tumbling windows; later ones than the delay are dropped by the watermark."""
    from pyspark.sql import functions as F

    return lines.withWatermark("ts", delay).groupBy(F.window("ts", width), "project_dir").count()
