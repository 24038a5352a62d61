"""Search over projects, sessions and insights."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.columns import like_folded
from loomline.operators.grams import matching
from loomline.operators.insights import with_episodes

SCHEMA = "branch int, kind string, project_dir string, session_id string, insight_id bigint, text string"


def search(insights: DataFrame, episodes: DataFrame, query: str, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """Projects, then sessions, then insights that match; each branch a third of the limit, rounded up.

    A blank query matches nothing. Branches are in order of their keys. With an index of
    the insights' texts (gram, insight_id) only what it names is looked at.
    """
    query = query.strip()
    if not query:
        return insights.sparkSession.createDataFrame([], SCHEMA)
    each = ceil(limit / 3)
    none = lambda kind: F.lit(None).cast(kind)
    projects = episodes.select("project_dir").distinct().filter(like_folded(F.col("project_dir"), query)).orderBy("project_dir").limit(each)
    projects = projects.select(F.lit(0).alias("branch"), F.lit("project").alias("kind"), "project_dir", none("string").alias("session_id"), none("bigint").alias("insight_id"), none("string").alias("text"))
    sessions = episodes.select("project_dir", "session_id").distinct().filter(like_folded(F.col("session_id"), query)).orderBy("project_dir", "session_id").limit(each)
    sessions = sessions.select(F.lit(1).alias("branch"), F.lit("session").alias("kind"), "project_dir", "session_id", none("bigint").alias("insight_id"), none("string").alias("text"))
    matched = insights.filter(like_folded(F.col("text"), query)) if index is None else matching(insights, "id", "text", query, index, "insight_id").select(*insights.columns)
    hits = with_episodes(matched, episodes).orderBy(F.desc("significance_score"), "id").limit(each)
    hits = hits.select(F.lit(2).alias("branch"), F.lit("insight").alias("kind"), "project_dir", "session_id", F.col("id").alias("insight_id"), "text")
    found = projects.unionByName(sessions).unionByName(hits)
    return found.orderBy("branch", "project_dir", "session_id", "insight_id").limit(limit)
