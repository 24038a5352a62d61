"""Queries over insights and their episodes. All are lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import ratio
from loomline.operators.paging import page
from loomline.operators.scope import EVERYTHING, Days, Scope, trailing
from loomline.schema import CATEGORIES, EFFORT_CLASSES


def with_episodes(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """rows (insights or turns) with date, project, session, label and start_line of their episode."""
    e = episodes.select(F.col("id").alias("episode_id"), "date", "project_dir", "session_id", "label", "start_line")
    return rows.join(e, "episode_id")


def _count() -> Column:
    return F.count("*").alias("count")


def category_trend(insights: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING) -> DataFrame:
    """G1: insights by day and category in a trailing window; days without any are not filled."""
    rows = with_episodes(insights, episodes).filter(trailing(as_of, days) & scope.condition())
    return rows.groupBy("date", "category").agg(_count()).orderBy("date", "category")


def insight_count(insights: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """One row, how many insights."""
    return with_episodes(insights, episodes).filter(days.condition() & scope.condition()).agg(_count())


def top_insights(insights: DataFrame, episodes: DataFrame, days: Days, limit: int, offset: int = 0, scope: Scope = EVERYTHING) -> DataFrame:
    """The most significant insights, a page of them; ties by id."""
    rows = with_episodes(insights, episodes).filter(days.condition() & scope.condition())
    rows = rows.filter(F.col("category").isin(*CATEGORIES) & F.col("effort_class").isin(*EFFORT_CLASSES))
    return page(rows, [F.desc("significance_score"), F.col("id")], offset, limit)


def cross_project(insights: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """Insights by project, most first."""
    rows = with_episodes(insights, episodes).filter(days.condition() & scope.condition())
    return rows.groupBy("project_dir").agg(F.count("*").alias("insight_count")).orderBy(F.desc("insight_count"), "project_dir")


def _effort_counts() -> list[Column]:
    return [F.count_if(F.col("effort_class") == c).alias(c) for c in EFFORT_CLASSES]


def _with_ratios(counted: DataFrame) -> DataFrame:
    total = F.col("toil") + F.col("judgment") + F.col("overhead")
    counted = counted.withColumn("total", total)
    return counted.select("*", *[ratio(F.col(c), F.col("total")).alias(f"{c}_ratio") for c in EFFORT_CLASSES])


def project_effort(insights: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """Effort classes and their ratios by project, most toil first; unknown classes count nowhere."""
    rows = with_episodes(insights, episodes).filter(days.condition() & scope.condition())
    return _with_ratios(rows.groupBy("project_dir").agg(*_effort_counts())).orderBy(F.desc("toil"), "project_dir")


def effort_breakdown(insights: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """One row of effort counts, total and ratios; zeros if there is nothing."""
    return _with_ratios(with_episodes(insights, episodes).filter(days.condition() & scope.condition()).agg(*_effort_counts()))


def effort_trend(insights: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING) -> DataFrame:
    """The breakdown of each day in a trailing window."""
    rows = with_episodes(insights, episodes).filter(trailing(as_of, days) & scope.condition())
    return _with_ratios(rows.groupBy("date").agg(*_effort_counts())).orderBy("date")


def effort_by_category(insights: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """Categories by effort class, largest total first."""
    rows = with_episodes(insights, episodes).filter(days.condition() & scope.condition())
    counted = rows.groupBy("category").agg(*_effort_counts())
    return counted.withColumn("total", F.col("toil") + F.col("judgment") + F.col("overhead")).orderBy(F.desc("total"), "category")


def labels(insights: DataFrame, episodes: DataFrame) -> DataFrame:
    """Insights by run label."""
    return with_episodes(insights, episodes).groupBy("label").agg(_count()).orderBy("label")


def projects(insights: DataFrame, episodes: DataFrame) -> DataFrame:
    """Insights by project, most first."""
    return with_episodes(insights, episodes).groupBy("project_dir").agg(_count()).orderBy(F.desc("count"), "project_dir")


def sessions(insights: DataFrame, episodes: DataFrame, project_dir: str | None = None) -> DataFrame:
    """Insights by session, of one project or all."""
    rows = with_episodes(insights, episodes).filter(Scope(project_dir=project_dir).condition())
    return rows.groupBy("project_dir", "session_id").agg(_count()).orderBy(F.desc("count"), "project_dir", "session_id")


def session_runs(insights: DataFrame, episodes: DataFrame, derived: DataFrame, project_dir: str, session_id: str) -> DataFrame:
    """The runs of a session, latest first, with how many derived insights bear their label."""
    scope = Scope(project_dir=project_dir, session_id=session_id).condition()
    runs = with_episodes(insights, episodes).filter(scope).groupBy("label").agg(F.count("*").alias("insight_count"), F.max("created_at").alias("latest_created_at"))
    found = derived.filter(scope).groupBy("label").agg(F.count("*").alias("derived_count"))
    joined = runs.join(found, "label", "left").withColumn("derived_count", F.coalesce("derived_count", F.lit(0)))
    return joined.orderBy(F.desc("latest_created_at"), "label")


def insight_dates(insights: DataFrame, episodes: DataFrame) -> DataFrame:
    """The days that have insights, latest first."""
    return with_episodes(insights, episodes).select("date").distinct().orderBy(F.desc("date"))


def work_items(insights: DataFrame, episodes: DataFrame, project_dir: str, session_id: str, label: str) -> DataFrame:
    """T4: the insights of one run in order of creation."""
    return with_episodes(insights, episodes).filter(Scope(label, project_dir, session_id).condition()).orderBy("created_at", "id")


def derived_of_run(derived: DataFrame, project_dir: str, session_id: str, label: str | None = None) -> DataFrame:
    """T5: derived insights of a session, or of one run, latest first."""
    return derived.filter(Scope(label, project_dir, session_id).condition()).orderBy(F.desc("created_at"), "id")


def recent_insights(insights: DataFrame, since: str) -> DataFrame:
    """Insights created from an instant on, latest first."""
    return insights.filter(F.col("created_at") >= since).orderBy(F.desc("created_at"), "id")


def recent_embeddings(embeddings: DataFrame, insights: DataFrame, since_day: str) -> DataFrame:
    """Vectors of insights created from a day on, latest first."""
    i = insights.select(F.col("id").alias("insight_id"), F.col("created_at").alias("insight_created_at"))
    return embeddings.join(i, "insight_id").filter(F.col("insight_created_at") >= since_day).orderBy(F.desc("insight_created_at"), "insight_id")


def brief_insights(insights: DataFrame, episodes: DataFrame, day: str) -> DataFrame:
    """A day's insights by category and significance, with the day their parent was seen."""
    rows = with_episodes(insights, episodes)
    seen = rows.select(F.col("id").alias("recurrence_of"), F.col("date").alias("recurrence_date"))
    return rows.filter(F.col("date") == day).join(seen, "recurrence_of", "left").orderBy("category", F.desc("significance_score"), "id")


def resolve_insights(ids: DataFrame, insights: DataFrame, episodes: DataFrame) -> DataFrame:
    """Insights by id with their day, whatever the window or scope."""
    return with_episodes(insights, episodes).join(ids.select("id").distinct(), "id")


def by_category(insights: DataFrame) -> DataFrame:
    """Insights by category in the fixed order; unknown categories are not listed."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return insights.withColumn("category_place", place).filter("category_place > 0").orderBy("category_place", F.desc("significance_score"), "id")


def relabel(episodes: DataFrame, project_dir: str, session_id: str, old: str, new: str) -> DataFrame:
    """K5: episodes with a run's label changed; `relabeled` marks the changed rows. Derived insights keep theirs."""
    hit = Scope(old, project_dir, session_id).condition()
    return episodes.withColumn("relabeled", F.coalesce(hit, F.lit(False))).withColumn("label", F.when(F.col("relabeled"), new).otherwise(F.col("label")))
