"""How humans engage: counts, ratios, bursts and flagged directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import ratio_or_null, theme
from loomline.operators.insights import with_episodes
from loomline.operators.scope import EVERYTHING, Days, Scope, trailing

FLAGGED = 5
EXAMPLES = 3
ORDER = ["start_line", "human_line_number", "project_dir", "session_id", "id"]


def _unnecessary() -> Column:
    """A directive that isn't known to be necessary."""
    return (F.col("classification") == "directive") & ~F.coalesce("directive_necessary", F.lit(False))


def _breakdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, ratio and longest burst by keys, or of all rows, in one read of the rows."""
    c = F.col("classification")
    counters = {
        "directive_unnecessary": _unnecessary(),
        "directive_necessary_count": (c == "directive") & F.coalesce("directive_necessary", F.lit(False)),
        "deliberative": c == "deliberative",
        "corrective": c == "corrective",
        "acknowledgment": c == "acknowledgment",
    }
    good = F.col("deliberative") + F.col("corrective")
    directive = F.col("directive_unnecessary") + F.col("directive_necessary_count")
    return longest_burst(rows, keys, counters).select(
        *keys,
        directive.alias("directive"),
        F.col("directive_necessary_count").alias("directive_necessary"),
        "directive_unnecessary", "deliberative", "corrective", "acknowledgment",
        (directive + good).alias("total"),
        ratio_or_null(good, F.col("directive_unnecessary")).alias("engagement_ratio"),
        F.col("longest_directive_burst").cast("long").alias("longest_directive_burst"),
    )


def longest_burst(rows: DataFrame, keys: list[str] | None = None, counters: dict[str, Column] | None = None) -> DataFrame:
    """Keys and longest_directive_burst, the most unnecessary directives in a row, by keys or over one global order; and how many rows meet each counter's condition.

    Rows are dealt by ranges of the full order, so that neither the whole scope nor
    a day that holds most rows meets in one task. Each range gives, for each key in
    it, its length and its leading, trailing and longest run; these few rows are
    then joined end to end.
    """
    keys, counters = keys or [], counters or {}
    flags = [F.coalesce(condition.cast("int"), F.lit(0)).alias("_" + name) for name, condition in counters.items()]
    added = [F.sum("_" + name).alias("_" + name) for name in counters]
    # one use of the ranges, in one job, so that they need not be written
    ranged = rows.select(*keys, *[c for c in ORDER if c not in keys], _unnecessary().alias("_u"), *flags).repartitionByRange(*keys, *ORDER).withColumn("_b", F.spark_partition_id())
    at = Window.partitionBy("_b", *keys).orderBy(*ORDER)
    numbered = ranged.withColumn("_n", F.row_number().over(at)).withColumn("_island", F.sum(F.when(F.col("_u"), 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("_b", *keys, "_island").agg(F.count_if("_u").alias("n"), F.count("*").alias("rows"), F.min(F.when(F.col("_u"), F.col("_n"))).alias("first"), F.max(F.when(F.col("_u"), F.col("_n"))).alias("last"), *added)
    size = F.sum("rows")
    edges = runs.groupBy("_b", *keys).agg(
        size.alias("size"),
        F.coalesce(F.max(F.when(F.col("first") == 1, F.col("n"))), F.lit(0)).alias("lead"),
        F.max_by(F.struct("last", "n"), F.col("last")).alias("_last"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        *added,
    )
    edges = edges.withColumn("trail", F.coalesce(F.when(F.col("_last.last") == F.col("size"), F.col("_last.n")), F.lit(0))).drop("_last")
    # at most as many rows as there are ranges, and one more for each key
    listed = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "size", "lead", "trail", "most"))).alias("s"), *added)
    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("best"))

    def join(acc: Column, x: Column) -> Column:
        whole = acc["open"] + x["lead"]
        opened = F.when(x["lead"] == x["size"], whole).otherwise(x["trail"])
        return F.struct(opened.alias("open"), F.greatest(acc["best"], x["most"], whole).alias("best"))

    return listed.select(*keys, F.aggregate("s", start, join)["best"].alias("longest_directive_burst"), *[F.coalesce("_" + name, F.lit(0)).alias(name) for name in counters])


def engagement_breakdown(turns: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """One row; total leaves acknowledgments out, the ratio is null without unnecessary directives."""
    return _breakdown(with_episodes(turns, episodes).filter(days.condition() & scope.condition()), [])


def engagement_trend(turns: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING) -> DataFrame:
    """The breakdown of each day in a trailing window; bursts end with their day."""
    return _breakdown(with_episodes(turns, episodes).filter(trailing(as_of, days) & scope.condition()), ["date"]).orderBy("date")


def flagged_directives(turns: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING, limit: int = FLAGGED) -> DataFrame:
    """The last unnecessary directives of the scope, latest first."""
    rows = with_episodes(turns, episodes).filter(days.condition() & scope.condition() & _unnecessary())
    return rows.orderBy(*[F.desc(c) for c in ORDER]).limit(limit)


def flagged_by_date(turns: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING, limit: int = FLAGGED) -> DataFrame:
    """W3 by day: the last unnecessary directives of each, `place` 1 for the latest."""
    rows = with_episodes(turns, episodes).filter(trailing(as_of, days) & scope.condition() & _unnecessary())
    place = F.row_number().over(Window.partitionBy("date").orderBy(*[F.desc(c) for c in ORDER]))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).orderBy("date", "place")


def _flags() -> Column:
    """An array of flagged rows, latest first, from rows with their `place`."""
    return F.transform(F.array_sort(F.collect_list(F.struct("place", "human_line_number", "reason", "created_at"))), lambda x: F.struct(x["human_line_number"].alias("human_line_number"), x["reason"].alias("reason"), x["created_at"].alias("created_at"))).alias("flagged_directives")


def breakdown_with_flags(turns: DataFrame, episodes: DataFrame, days: Days, scope: Scope = EVERYTHING) -> DataFrame:
    """G13 whole: the breakdown and its last flagged directives (W3), at most FLAGGED, as an array."""
    last = flagged_directives(turns, episodes, days, scope)
    order = F.struct(*[F.col(c) for c in ORDER])
    listed = last.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "human_line_number", "reason", "created_at"))).alias("f"))
    flags = F.transform(F.reverse("f"), lambda x: F.struct(x["human_line_number"].alias("human_line_number"), x["reason"].alias("reason"), x["created_at"].alias("created_at")))
    return engagement_breakdown(turns, episodes, days, scope).join(F.broadcast(listed.select(flags.alias("flagged_directives"))))


def trend_with_flags(turns: DataFrame, episodes: DataFrame, as_of: str, days: int, scope: Scope = EVERYTHING) -> DataFrame:
    """G14 whole: each day's breakdown and its last flagged directives."""
    flags = flagged_by_date(turns, episodes, as_of, days, scope).groupBy("date").agg(_flags())
    joined = engagement_trend(turns, episodes, as_of, days, scope).join(flags, "date", "left")
    return joined.withColumn("flagged_directives", F.coalesce("flagged_directives", F.array().cast(flags.schema["flagged_directives"].dataType))).orderBy("date")


def directive_themes(flagged: DataFrame) -> DataFrame:
    """Flagged directives by theme, most first, each with its first three examples.

    Only the first rows of a theme in each task are sorted together; the counts are plain sums.
    """
    themed = flagged.withColumn("theme", theme(F.col("reason")))
    place = F.row_number().over(Window.partitionBy("theme").orderBy(*ORDER))
    first = themed.withColumn("_place", place).filter(F.col("_place") <= EXAMPLES)
    examples = first.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("_place", "human_line_number", "reason"))).alias("examples"))
    return themed.groupBy("theme").agg(F.count("*").alias("count")).join(examples, "theme").orderBy(F.desc("count"), "theme")
