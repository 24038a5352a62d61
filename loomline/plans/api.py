"""What callers ask by name: each endpoint as a function of parameter texts that gives a lazy DataFrame."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import formatting
from loomline.operators import engagement, insights, listing, search
from loomline.operators.scope import Days, Scope
from loomline.plans import analyze, brief
from loomline.plans import requests as rq
from loomline.sources import transcripts
from loomline.sources.store import Store

Tables = Mapping[str, DataFrame]


def _ie(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t["insights"], t["episodes"]


def _days(t: Tables, p: Mapping[str, str]) -> Days:
    """The days of a request; the latest day with data is looked up for a preset only."""
    latest = insights.insight_dates(*_ie(t)).first() if p.get("range") else None
    return rq.parse_days(p, latest["date"] if latest else None)


def _need(p: Mapping[str, str], *names: str) -> list[str]:
    missing = [n for n in names if not p.get(n)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return [p[n] for n in names]


ENDPOINTS: dict[str, Callable[[Tables, Mapping[str, str], str], DataFrame]] = {
    "dates": lambda t, p, now: insights.insight_dates(*_ie(t)),
    "cross-project": lambda t, p, now: insights.cross_project(*_ie(t), _days(t, p), rq.parse_scope(p)),
    "engagement-breakdown": lambda t, p, now: engagement.breakdown_with_flags(t["engagement_turns"], t["episodes"], _days(t, p), rq.parse_scope(p)),
    "engagement-breakdown-trend": lambda t, p, now: engagement.trend_with_flags(t["engagement_turns"], t["episodes"], now, rq.parse_positive(p.get("days"), 30), rq.parse_scope(p)),
    "engagement-summary": lambda t, p, now: engagement_lines(t, _days(t, p), rq.parse_scope(p)),
    "labels": lambda t, p, now: insights.labels(*_ie(t)),
    "insights": lambda t, p, now: insights.resolve_insights(_ids(t["insights"], _need(p, "ids")[0]), *_ie(t)),
    "search": lambda t, p, now: search.search(*_ie(t), p.get("q", ""), rq.parse_search_limit(p.get("limit")), t.get("insight_grams")),
    "projects": lambda t, p, now: insights.projects(*_ie(t)),
    "sessions": lambda t, p, now: insights.sessions(*_ie(t), p.get("project")),
    "session-runs": lambda t, p, now: insights.session_runs(*_ie(t), t["derived_insights"], *_need(p, "project", "session")),
    "derived-insights": lambda t, p, now: insights.derived_of_run(t["derived_insights"], *_need(p, "project", "session"), p.get("label")),
    "session-projects": lambda t, p, now: listing.session_projects(t["files"], insights.sessions(*_ie(t)), _metadata(listing.first_of_projects(t["files"]))),
    "sessions-all": lambda t, p, now: sessions_page(t, p)[0],
    "jobs": lambda t, p, now: t["jobs"].filter(F.col("id") == _need(p, "id")[0]),
}
#: Endpoints that need the session files as well as the store.
OF_FILES = ("session-projects", "sessions-all")


def _ids(insights_table: DataFrame, text: str) -> DataFrame:
    """The ids of a comma-separated list."""
    return insights_table.sparkSession.createDataFrame([(rq.parse_positive(i, 0),) for i in text.split(",")], "id long")


def engagement_lines(t: Tables, days: Days, scope: Scope) -> DataFrame:
    """The lines of a breakdown and its commonest theme, as rows."""
    flagged = engagement.flagged_directives(t["engagement_turns"], t["episodes"], days, scope)
    top = engagement.directive_themes(flagged).first()
    found = engagement.engagement_breakdown(t["engagement_turns"], t["episodes"], days, scope).first().asDict()
    lines = formatting.engagement_summary(found, (top["theme"], top["count"]) if top else None)
    return t["episodes"].sparkSession.createDataFrame(list(enumerate(lines)), "place int, line string")


def _metadata(files: DataFrame) -> DataFrame:
    return transcripts.metadata_of(files.sparkSession, files)


def ask(endpoint: str, tables: Tables, params: Mapping[str, str], today: str) -> DataFrame:
    if endpoint not in ENDPOINTS:
        raise KeyError(endpoint)
    return ENDPOINTS[endpoint](tables, params, today)


def file_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The table of the endpoints of OF_FILES: the session files. Metadata are read only of the files that an answer shows."""
    return {"files": transcripts.list_session_files(spark, root)}


def briefs(folder: str, day: str | None = None) -> list[str] | str | None:
    """The days that have a brief, or the text of one."""
    return brief.list_briefs(folder) if day is None else brief.read_brief(folder, day)


def send(endpoint: str, store: Store, params: Mapping[str, str], now: Callable[[], datetime], use: analyze.Models | None = None, root: str | None = None, job_id: str | None = None) -> dict:
    """What changes the store: labels, sessions/analyze and derive-insights; the two last are jobs.

    An analysis is followed by the derivation of insights of its run where a
    deriving model is given. Without models nothing is analyzed.
    """
    if endpoint == "labels":
        project, session, old, new = _need(params, "project", "session", "from", "to")
        return {"updated": store.relabel_run(project, session, old, new)}
    if endpoint not in ("sessions/analyze", "derive-insights"):
        raise KeyError(endpoint)
    if use is None:
        raise ValueError("missing: models")
    project, session = _need(params, "project", "session")
    job = job_id or uuid.uuid4().hex

    def derive(label: str) -> int:
        return analyze.derive_run(store, project, session, label, use.deriver, now())

    def work() -> str:
        if endpoint == "derive-insights":
            return json.dumps({"derived": derive(_need(params, "label")[0])})
        done = analyze.analyze(store, _need({"root": root or ""}, "root")[0], now(), use=use, label=params.get("label"), force=params.get("force") == "true", project=project, session=session)
        derived = derive(done.label) if use.deriver is not None and done.insights else 0
        return json.dumps({**done.__dict__, "derived": derived})

    return {"id": job, "status": analyze.run_job(store, job, endpoint, work, now)}


def sessions_page(tables: Tables, params: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """A page of a project's sessions and its totals. Metadata are read of the page's files, and of the project's only where titles decide the page."""
    (project,) = _need(params, "project")
    page, size = rq.parse_positive(params.get("page"), 1), rq.parse_positive(params.get("pageSize"), 20)
    sort_by, direction, query = params.get("sortBy") or "mtime", params.get("sortDir") or "desc", params.get("q", "")
    if sort_by not in listing.SORTS or direction not in ("asc", "desc"):
        raise ValueError("sortBy or sortDir")
    analyzed = {"true": True, "false": False}.get(params.get("analyzed", ""))
    rows = listing.session_listing(tables["files"], insights.sessions(*_ie(tables), project), project)
    first = sort_by == "title" or bool(query.strip())
    if first:
        rows = listing.with_metadata(rows, _metadata(rows))
    found, totals = listing.page_of(listing.filter_listing(rows, analyzed, query), sort_by, direction == "desc", page, size)
    return (found if first else listing.with_metadata(found, _metadata(found))), totals
