"""The driver tables seen as domain tables, as DataFrames and as the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.schema import CATEGORIES

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"

# What the i-th reason says; reasons 0 to 3 have a theme.
REASONS = ("manually ran the tests", "did the code review", "agent was already doing it", "told agent what to type", "picked a name", "asked for more")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 8).cast("string")).alias("project_dir"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"),
        (F.col("o_orderkey") * 10).alias("start_line"),
        (F.col("o_orderkey") * 10 + 9).alias("end_line"),
        F.col("o_orderpriority").alias("label"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; ids number the rows of an order by all their columns. Parents: the row before, a missing id, or a cycle of two."""
    li = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    li = li.withColumn("n", place)
    key = F.col("l_orderkey")
    row = key * 1000 + F.col("n")
    parent = F.when((F.col("n") > 1) & (row % 3 != 0), row - 1).when((F.col("n") == 1) & (key % 11 == 0), row + 1).when((F.col("n") == 1) & (key % 5 == 0), -1 - key % 50)
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("l_partkey") % 7 + 1).cast("int"))
    return li.select(
        row.alias("id"),
        key.alias("episode_id"),
        category.alias("category"),
        F.concat(F.lit("Item "), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_linestatus")).alias("text"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence_ref"),
        (F.col("l_quantity") / 10).alias("significance_score"),
        (F.col("l_tax") > 0.05).alias("verified_by_git"),
        parent.alias("recurrence_of"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00:00.000'Z'").alias("created_at"),
        F.when(F.col("l_returnflag") == "A", "overhead").when(F.col("l_returnflag") == "R", "toil").otherwise("judgment").alias("effort_class"),
    )


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("user_id", "date").agg(F.min("event_id").alias("start_line"), F.max("event_id").alias("end_line")).select(
        (F.col("user_id") * 100000 + F.datediff(F.col("date").cast("date"), F.lit("2024-01-01").cast("date"))).alias("id"),
        "date",
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("project_dir"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        "start_line",
        "end_line",
        F.lit("").alias("label"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "directive").when(F.col("event_type") == "purchase", "deliberative").when(F.col("event_type") == "error", "corrective").when(F.col("event_type") == "signup", "acknowledgment").otherwise("other")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") * 100000 + F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).alias("episode_id"),
        F.col("event_id").alias("human_line_number"),
        kind.alias("classification"),
        (F.col("value") > 50).alias("directive_necessary"),
        F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 6 + 1).cast("int")).alias("reason"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
    )


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir).filter("id % 4 = 0")
    return e.select("id", "project_dir", "session_id", "label", F.lit("pattern").alias("insight_type"), F.concat(F.lit("Finding "), F.col("id").cast("string")).alias("text"), F.array(F.col("id") * 1000 + 1).alias("evidence_insight_ids"), F.concat("date", F.lit("T12:00:00.000Z")).alias("created_at"))


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of one session a user, in order of time; errors are compaction marks."""
    e = table(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(at).alias("line_number"), F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("event_type") == "error").alias("is_compact"), F.length("props").cast("long").alias("chars"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as classified lines: system rows are injected turns, every third agent row used a tool."""
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return c.select("conv_id", F.col("turn").alias("line_number"), text.alias("text"), ((F.col("role") == "user") & (text != "")).alias("is_human"), (F.col("role") == "assistant").alias("is_agent"), ((F.col("role") == "assistant") & (F.col("turn") % 3 == 0)).alias("used_tool"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 256).cast("int").alias("batch"), (F.col("vec_id") % 17).cast("double").alias("significance_score"), "embedding")


_CATEGORY = "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"
_REASON = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END"

#: DuckDB SQL of the tables above, as WITH clauses.
SQL = {
    "episodes": """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'p' || (o_custkey % 8) AS project_dir, 's' || o_custkey AS session_id,
        o_orderkey * 10 AS start_line, o_orderkey * 10 + 9 AS end_line, o_orderpriority AS label FROM orders""",
    "insights": f"""SELECT l_orderkey * 1000 + n AS id, l_orderkey AS episode_id, {_CATEGORY} AS category, 'Item ' || l_partkey || ' ' || l_linestatus AS text,
        'line ' || l_linenumber AS evidence_ref, l_quantity / 10 AS significance_score, l_tax > 0.05 AS verified_by_git,
        CASE WHEN n > 1 AND (l_orderkey * 1000 + n) % 3 <> 0 THEN l_orderkey * 1000 + n - 1 WHEN n = 1 AND l_orderkey % 11 = 0 THEN l_orderkey * 1000 + n + 1
             WHEN n = 1 AND l_orderkey % 5 = 0 THEN -1 - l_orderkey % 50 END AS recurrence_of,
        strftime(l_shipdate, '%Y-%m-%dT00:00:00.000Z') AS created_at,
        CASE l_returnflag WHEN 'A' THEN 'overhead' WHEN 'R' THEN 'toil' ELSE 'judgment' END AS effort_class
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)""",
    "event_episodes": """SELECT user_id * 100000 + datediff('day', DATE '2024-01-01', CAST(date AS DATE)) AS id, date, 'p' || (user_id % 8) AS project_dir, 'u' || user_id AS session_id, start_line, end_line, '' AS label
        FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, min(event_id) AS start_line, max(event_id) AS end_line FROM events GROUP BY ALL)""",
    "turns": f"""SELECT event_id AS id, user_id * 100000 + datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS episode_id, event_id AS human_line_number,
        CASE WHEN event_type IN ('click', 'view') THEN 'directive' WHEN event_type = 'purchase' THEN 'deliberative' WHEN event_type = 'error' THEN 'corrective' WHEN event_type = 'signup' THEN 'acknowledgment' ELSE 'other' END AS classification,
        value > 50 AS directive_necessary, {_REASON} AS reason FROM events""",
    "derived": """SELECT o_orderkey AS id, 'p' || (o_custkey % 8) AS project_dir, 's' || o_custkey AS session_id, o_orderpriority AS label, 'pattern' AS insight_type, 'Finding ' || o_orderkey AS text,
        [o_orderkey * 1000 + 1] AS evidence_insight_ids, strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00.000Z' AS created_at FROM orders WHERE o_orderkey % 4 = 0""",
    "placed": "SELECT i.*, e.date, e.project_dir, e.session_id, e.label FROM insights i JOIN episodes e ON i.episode_id = e.id",
    "placed_turns": "SELECT t.*, e.date, e.project_dir, e.session_id, e.start_line FROM turns t JOIN event_episodes e ON t.episode_id = e.id",
    "timed": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ln, ts, strftime(ts, '%Y-%m-%d') AS date, event_type = 'error' AS is_compact FROM events""",
    "lines": """SELECT conv_id, turn AS ln, coalesce(text, '') AS text, role = 'user' AND coalesce(text, '') <> '' AS h, role = 'assistant' AS a, role = 'assistant' AND turn % 3 = 0 AS tool FROM conversations""",
}
_NEEDS = {"placed": ("insights", "episodes"), "placed_turns": ("turns", "event_episodes")}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body with the WITH clauses of the named tables."""
    clauses: list[str] = []
    for n in names:
        for part in (*_NEEDS.get(n, ()), n):
            if part not in clauses:
                clauses.append(part)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in clauses) + ("" if body.lstrip().startswith(",") else "\n") + body
