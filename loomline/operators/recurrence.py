"""Recurrence chains: insights that come back, followed to their first sighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.insights import with_episodes
from loomline.operators.scope import EVERYTHING, Scope, trailing
from loomline.sources.scratch import written

#: Levels that are walked one by one, before pointers are doubled; results don't depend on it.
NEAR_LEVELS = 12


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id of starts and of all that their walks along edges (id, parent) pass.

    Most walks are short: their levels are walked one by one, over the rows
    reached last. What lies deeper is reached along pointers that double, so that
    a walk of any depth takes as many rounds as its depth has binary digits.
    """
    reach = frontier = written(starts.select("id").distinct())
    for _ in range(NEAR_LEVELS):
        onward = edges.join(frontier, "id").select(F.col("parent").alias("id")).distinct()
        frontier = written(onward.join(reach, "id", "left_anti"))
        if frontier.isEmpty():
            return reach
        reach = reach.unionByName(frontier)
    jump, deep = edges, frontier
    steps, n = 1, edges.count()
    while steps <= n and not jump.isEmpty():
        deep = written(deep.unionByName(jump.join(deep, "id").select(F.col("parent").alias("id"))).distinct())
        jump = written(jump.join(jump.select(F.col("id").alias("parent"), F.col("parent").alias("far")), "parent").select("id", F.col("far").alias("parent")))
        steps *= 2
    return written(reach.unionByName(deep).distinct())


def roots(edges: DataFrame) -> DataFrame:
    """id and root_id of every id and every parent in edges (id, parent): where its walk ends; walks that meet themselves are left out.

    Each round doubles the pointers that haven't ended. The nodes in a distance of
    up to 2^k from their end are known after k rounds, and each longer walk passes
    nodes of up to twice that distance; so a round that finds no further end
    leaves only walks that go round in a circle.
    """
    ends = written(edges.select(F.col("parent").alias("id")).distinct().join(edges.select("id"), "id", "left_anti").select("id", F.col("id").alias("root_id")))
    moving = edges
    while True:
        at_end = written(moving.join(ends.select(F.col("id").alias("parent"), "root_id"), "parent").select("id", "root_id"))
        if at_end.isEmpty():
            return ends
        ends = ends.unionByName(at_end)
        moving = written(moving.join(moving.select(F.col("id").alias("parent"), F.col("parent").alias("far")), "parent").select("id", F.col("far").alias("parent")))


def chain_members(insights: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING) -> DataFrame:
    """root_id, id, text, date, created_at and chain_length of all members of chains of two or more.

    Walks start at the insights of the window and scope, and follow parents
    wherever they lie. A walk that meets itself is dropped whole. A missing
    parent is the root of those that name it, without being a member. Depth has
    no limit. Only the insights that walks pass are followed to their roots.
    """
    # one read of the insights gives their edges and where walks start; only members are read again, with their texts
    placed = episodes.select(F.col("id").alias("episode_id"), "date", "project_dir", "session_id", "label")
    starting = F.coalesce(trailing(as_of, days) & scope.condition(), F.lit(False))
    slim = written(insights.select("id", "episode_id", "recurrence_of").join(placed, "episode_id", "left").select("id", F.col("recurrence_of").alias("parent"), starting.alias("starts")).filter("parent IS NOT NULL OR starts"))
    edges = slim.filter("parent IS NOT NULL").select("id", "parent")
    walked = ancestors(edges, slim.filter("starts"))
    # an insight without a parent that is nobody's parent is a chain of one, which is no chain
    found = roots(written(edges.join(walked, "id", "left_semi")))
    members = written(with_episodes(insights, episodes).join(found, "id").select("root_id", "id", "text", "date", "created_at"))
    sized = members.groupBy("root_id").agg(F.count("*").alias("chain_length")).filter("chain_length > 1")
    return members.join(sized, "root_id").select("root_id", "id", "text", "date", "created_at", "chain_length")


def recurrence_chains(insights: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING) -> DataFrame:
    """One row per chain, longest first: its length, first text and the days of its first and last member."""
    order = F.struct("created_at", "id")
    chains = chain_members(insights, episodes, as_of, days, scope).groupBy("root_id").agg(
        F.count("*").alias("chain_length"),
        F.min_by("text", order).alias("first_text"),
        F.min_by("date", order).alias("first_date"),
        F.max_by("date", order).alias("last_date"),
    )
    return chains.orderBy(F.desc("chain_length"), "root_id")
