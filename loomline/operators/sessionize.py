"""Episodes from lines: day buckets, idle gaps, compaction boundaries and size budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import flag_is_true, local_date, token_estimate

GAP_MINUTES = 25
TOKEN_BUDGET = 150_000
SESSION = ["project_dir", "session_id"]
STRETCH = 4096


def prepare_lines(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Adds date (local day), is_compact (W4's mark) and chars (JSON length) to ingested lines."""
    return lines.withColumn("date", local_date(F.col("ts"), tz)).withColumn("is_compact", flag_is_true(F.col("raw"), "isCompactSummary")).withColumn("chars", F.length("raw_text"))


def before_compaction(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Adds `_boundary`, whether the next line of the session is a compact summary.

    Sessions are cut into stretches of line numbers, so that a session of any
    length is many small windows; each stretch's last line looks at the first of
    the next stretch, known from one row a stretch.
    """
    cut = lines.withColumn("_stretch", F.floor(F.col(line) / STRETCH))
    heads = cut.groupBy(*keys, "_stretch").agg(F.min_by("is_compact", line).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head", 1, False).over(Window.partitionBy(*keys).orderBy("_stretch"))).drop("_head")
    inside = F.lead("is_compact").over(Window.partitionBy(*keys, "_stretch").orderBy(line))
    return cut.withColumn("_inside", inside).join(heads, [*keys, "_stretch"]).withColumn("_boundary", F.coalesce("_inside", "_after")).drop("_stretch", "_inside", "_after")


def sessionize(lines: DataFrame, gap_minutes: float = GAP_MINUTES, keys: list[str] | None = None, line: str = "line_number") -> DataFrame:
    """Adds `part`, the running episode number within (keys, date).

    A gap of more than gap_minutes starts a new episode, and so does a line whose
    predecessor of the day is a compaction boundary: the line before a compact
    summary, in session order. Days always split; negative gaps never do. Lines
    without a timestamp have no day and are left out. Windows hold one day of one
    session.
    """
    keys = keys or SESSION
    day = Window.partitionBy(*keys, "date").orderBy(line)
    marked = before_compaction(lines, keys, line).filter("date IS NOT NULL")
    micros = F.unix_micros("ts")
    gap = micros - F.lag(micros).over(day) > gap_minutes * 60_000_000
    new = F.coalesce(gap, F.lit(False)) | F.coalesce(F.lag("_boundary").over(day), F.lit(False))
    return marked.withColumn("_new", new.cast("int")).withColumn("part", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, 0))).drop("_boundary", "_new")


def split_by_budget(lines: DataFrame, budget: int = TOKEN_BUDGET, keys: list[str] | None = None) -> DataFrame:
    """Adds `piece`; episodes over a token budget are halved by lines until each fits or is one line.

    Only line numbers and running lengths of the episodes that are too large are
    gathered, as one array an episode. All of its pieces are halved once a level, and
    there are as many levels as halving its lines down to one takes.
    """
    keys = [*(keys or SESSION), "date", "part"]
    whole = Window.partitionBy(*keys)
    sized = lines.withColumn("_tokens", token_estimate(F.sum("chars").over(whole)))
    upto = F.coalesce(F.sum("chars").over(whole.orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    large = sized.filter(F.col("_tokens") > budget).withColumn("_upto", upto)
    held = large.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_number", "_upto"))).alias("_l"))

    def before(k: Column) -> Column:
        """The length of an episode's first k lines."""
        return F.when(k > 0, F.get("_l", k - 1)["_upto"]).otherwise(0)

    def piece(first: Column, stop: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), stop.cast("int").alias("stop"))

    def halve(x: Column) -> Column:
        first, stop = x["first"], x["stop"]
        middle = first + F.floor((stop - first) / 2)
        fits = (stop - first <= 1) | (token_estimate(before(stop) - before(first)) <= budget)
        return F.when(fits, F.array(piece(first, stop))).otherwise(F.array(piece(first, middle), piece(middle, stop)))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_l"))).cast("int"))
    cut = F.aggregate(levels, F.array(piece(F.lit(0), F.size("_l"))), lambda found, _: F.flatten(F.transform(found, halve)))
    pieces = held.select(*keys, "_l", F.posexplode(cut).alias("piece", "_x"))
    placed = pieces.select(*keys, "piece", F.explode(F.slice("_l", F.col("_x.first") + 1, F.col("_x.stop") - F.col("_x.first"))).alias("_line")).select(*keys, F.col("_line.line_number").alias("line_number"), "piece")
    return sized.drop("_tokens").join(placed, [*keys, "line_number"], "left").withColumn("piece", F.coalesce("piece", F.lit(0)))


def episodes(pieces: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Episode rows: first and last line of each piece."""
    keys = keys or SESSION
    return pieces.groupBy(*keys, "date", "part", "piece").agg(F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.count("*").alias("n_lines"))


def chunk(lines: DataFrame, gap_minutes: float = GAP_MINUTES, budget: int = TOKEN_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lines with part and piece, episodes) of prepared lines."""
    pieces = split_by_budget(sessionize(lines, gap_minutes), budget)
    return pieces, episodes(pieces)
