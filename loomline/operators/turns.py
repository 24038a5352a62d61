"""Human turns paired with the agent activity before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import asked_question, directive_hint, flag_is_true, has_block, has_text, is_acknowledgment, is_injected, render_content

SAMPLES = 10
SAMPLE_CHARS = 500


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds text, is_human (a real human turn), is_agent and used_tool to lines with a VARIANT `raw`."""
    raw = F.col("raw")
    agent = F.col("type") == "assistant"
    lines = lines.withColumn("text", render_content(raw))
    human = (F.col("type") == "user") & has_text(raw) & ~is_injected(F.col("text")) & ~flag_is_true(raw, "isMeta")
    return lines.withColumn("is_human", human).withColumn("is_agent", agent).withColumn("used_tool", agent & has_block(raw, "tool_use"))


def turn_pairs(lines: DataFrame, keys: list[str], line: str = "line_number") -> DataFrame:
    """One row per human turn after agent activity.

    Lines up to and with a human turn are a cluster. It counts if it has a line
    of its own besides the turn and an agent has spoken anywhere before; tool use
    counts on agent lines only.
    """
    order = Window.partitionBy(*keys).orderBy(line)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("_cluster", F.coalesce(F.sum(F.col("is_human").cast("int")).over(before), F.lit(0))).withColumn("_saw", F.max("is_agent").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    human, other = F.col("is_human"), ~F.col("is_human")
    said = F.when(other & (F.col("text") != ""), F.struct(F.col(line).alias("l"), F.col("text").alias("t")))
    grouped = numbered.groupBy(*keys, "_cluster").agg(
        F.min(F.when(other, F.col(line))).alias("agent_line_start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), "\n").alias("agent_turn_text"),
        F.coalesce(F.bool_or(F.when(F.col("is_agent"), F.col("used_tool"))), F.lit(False)).alias("agent_had_tool_access"),
        F.max(F.when(human, F.col(line))).alias("human_line_number"),
        F.max(F.when(human, F.col("text"))).alias("human_turn_text"),
        F.coalesce(F.max(F.when(human, F.col("_saw"))), F.lit(False)).alias("_ok"),
    )
    pairs = grouped.filter("human_line_number IS NOT NULL AND agent_line_start IS NOT NULL AND _ok")
    return pairs.withColumn("agent_asked_question", asked_question(F.col("agent_turn_text"))).drop("_cluster", "_ok")


def prefilter(pairs: DataFrame) -> DataFrame:
    """Marks acknowledgments, which are never classified, and turns that look like directives."""
    return pairs.withColumn("is_acknowledgment", is_acknowledgment(F.col("human_turn_text"))).withColumn("directive_hint", directive_hint(F.col("human_turn_text")))


def first_classification(classified: DataFrame, emitted: str = "emit_pos") -> DataFrame:
    """Of several answers for one human line the first."""
    place = F.row_number().over(Window.partitionBy("episode_id", "human_line_number").orderBy(emitted))
    return classified.withColumn("_place", place).filter("_place = 1").drop("_place")


def spot_check_sample(pairs: DataFrame, classified: DataFrame) -> DataFrame:
    """Of each episode the first pairs that were classified, with the reason and texts cut to a length for reading."""
    hit = pairs.join(classified.select("episode_id", "human_line_number", "classification", "directive_necessary", "reason"), ["episode_id", "human_line_number"])
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("human_line_number"))
    short = [F.substring(c, 1, SAMPLE_CHARS).alias(c) for c in ("agent_turn_text", "human_turn_text")]
    return hit.withColumn("_place", place).filter(F.col("_place") <= SAMPLES).select("episode_id", "human_line_number", "classification", "directive_necessary", "reason", *short)


def append_spot_checks(sample: DataFrame, folder: str, label: str, stamp: str) -> None:
    """K9: adds a sample to a folder of Markdown text, a block a pair; the tasks write it. An empty sample adds nothing."""
    # The lines of a block.
    heading = F.concat(F.lit("### Human line "), F.col("human_line_number"), F.lit(" — "), F.col("classification"), F.coalesce(F.concat(F.lit(" (necessary: "), F.col("directive_necessary"), F.lit(")")), F.lit("")))
    fields = [F.concat(F.lit(f"**{name}:** "), F.coalesce(F.col(c), F.lit(""))) for name, c in (("Agent turn", "agent_turn_text"), ("Human turn", "human_turn_text"), ("Reason", "reason"))]
    blocks = sample.orderBy("episode_id", "human_line_number").select(F.concat_ws("\n", F.lit(f"## Spot-check sample — label `{label}` — {stamp}"), heading, *fields, F.lit("")).alias("value"))
    if not sample.isEmpty():
        blocks.write.mode("append").text(folder)
