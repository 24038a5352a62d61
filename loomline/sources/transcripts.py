"""Transcript files: append-only JSON lines under <root>/<project>/<session>.jsonl."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.columns import has_block
from loomline.schema import NOISE_TYPES
from loomline.sources.line_ranges import read_ranges
from loomline.sources.scratch import written

STRETCH = 100_000
FILES = "project_dir string, session_id string, path string, mtime timestamp, file_bytes long"
_PATH = r"([^/]+)/([^/]+)\.jsonl$"
SESSION = ["project_dir", "session_id"]


def _keyed(df: DataFrame, path: Column) -> DataFrame:
    part = lambda k: F.regexp_extract(path, _PATH, k)
    name = lambda k: F.coalesce(F.try_url_decode(F.regexp_replace(part(k), r"\+", "%2B")), part(k))
    return df.withColumn("project_dir", name(1)).withColumn("session_id", name(2))


def list_session_files(spark: SparkSession, root: str) -> DataFrame:
    """project_dir, session_id, path, mtime and bytes of the session files; none for a missing root."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*/*.jsonl")
    except AnalysisException:
        return spark.createDataFrame([], FILES)
    slim = found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("file_bytes"))
    return _keyed(slim, F.col("path")).select("project_dir", "session_id", "path", "mtime", "file_bytes")


def needs_scan(files: DataFrame, sessions: DataFrame, force: bool = False) -> DataFrame:
    """Files changed since their last run, with what is known of their lines.

    start_line is the session's cursor; read_offset and read_line tell where to read
    on (a byte, and the lines before it), and `islands` which later lines are done all
    the same. All are from the start for new files and when forced. A session row of an
    older version has no offset: it is read whole, its lines up to the cursor being done.
    So is a file that has become shorter, which an append-only one never does.
    """
    none = F.array().cast("array<struct<first:int,last:int>>")
    if force:
        return files.join(sessions.select(*SESSION), SESSION, "left").withColumns({"start_line": F.lit(0), "read_offset": F.lit(0).cast("long"), "read_line": F.lit(0), "islands": none})
    known = sessions.select(*SESSION, "last_line", "last_run_at", "read_offset", "read_line", "islands")
    joined = files.join(known, SESSION, "left")
    changed = F.col("last_run_at").isNull() | F.col("mtime").isNull() | (F.col("mtime") >= F.try_to_timestamp("last_run_at"))
    joined = joined.filter(F.coalesce(changed, F.lit(True))).withColumn("start_line", F.coalesce("last_line", F.lit(0)))
    usable = F.col("read_offset").isNotNull() & (F.col("read_offset") <= F.col("file_bytes"))
    before = F.array(F.struct(F.lit(1).alias("first"), F.col("start_line").alias("last")))
    return joined.withColumns(
        {
            "islands": F.when(usable, F.coalesce("islands", none)).when(F.col("start_line") > 0, F.concat(before, F.coalesce("islands", none))).otherwise(none),
            "read_line": F.when(usable, F.coalesce("read_line", F.lit(0))).otherwise(0),
            "read_offset": F.when(usable, F.col("read_offset")).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("last_line", "last_run_at")


def read_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Physical lines of files (project_dir, session_id, path, file_bytes, read_offset, read_line) from their offsets on, as a written table.

    Columns: project_dir, session_id, line_number (1-based in the whole file), raw_text,
    at and next_at (its first byte and the first one after it), closed (whether its end has been written) and fetched (bytes
    read for it). Nothing before the offset is read and nothing past the size that the
    listing gave, so the table is a snapshot. A line's number is its place in its range
    and the lines of the ranges before, which are one row a range.
    """
    # names and sizes of the files wanted, which Spark lists on the driver anyhow
    wanted = files.select("path", "read_offset", "file_bytes").collect()
    lines = written(read_ranges(spark, [(r["path"], r["read_offset"], r["file_bytes"]) for r in wanted]))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("path", "part").agg(F.count("*").alias("n"))
    starts = counts.select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(files.select("path", "read_line"), "path")
    numbered = lines.join(starts, ["path", "part"]).withColumn("line_number", (F.col("read_line") + F.col("before") + F.col("place") + 1).cast("int"))
    return written(_keyed(numbered, F.col("path")).select(*SESSION, "line_number", "raw_text", "at", "next_at", "closed", "fetched"))


def all_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every physical line of every session file with its number, blank and malformed ones included."""
    return read_lines(spark, whole(list_session_files(spark, root)))


def whole(files: DataFrame) -> DataFrame:
    """Files to be read from their start."""
    return files.withColumns({"read_offset": F.lit(0).cast("long"), "read_line": F.lit(0)})


def parse_lines(lines: DataFrame, as_of: str) -> DataFrame:
    """Adds raw (VARIANT), status, type, timestamp, ts and has_tool_use to physical lines.

    status is kept, blank, malformed, noise (known other types) or unknown. A
    missing or empty timestamp becomes as_of; one that can't be read gives a null
    ts, and such lines are in no day.
    """
    raw = F.try_parse_json("raw_text")
    parsed = lines.withColumn("raw", raw)
    kind = F.try_variant_get("raw", "$.type", "string")
    shape = F.coalesce(F.schema_of_variant("raw"), F.lit(""))
    status = (
        F.when(F.trim(F.regexp_replace("raw_text", r"\s", "")) == "", "blank")
        .when(F.col("raw").isNull() | ~shape.startswith("OBJECT"), "malformed")
        .when(kind.isin("user", "assistant"), "kept")
        .when(kind.isin(*NOISE_TYPES), "noise")
        .otherwise("unknown")
    )
    stamp = F.coalesce(F.nullif(F.try_variant_get("raw", "$.timestamp", "string"), F.lit("")), F.lit(as_of))
    parsed = parsed.withColumn("status", status).withColumn("type", kind).withColumn("timestamp", stamp)
    return parsed.withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("has_tool_use", (F.col("type") == "assistant") & has_block(F.col("raw"), "tool_use"))


def unknown_types(parsed: DataFrame) -> DataFrame:
    """S3: session, type and number of lines of a type that is neither kept nor known noise, to be warned of."""
    return parsed.filter("status = 'unknown'").groupBy("project_dir", "session_id", "type").agg(F.count("*").alias("n_lines"))


def max_lines(lines: DataFrame) -> DataFrame:
    """The last line number of each file, over all lines."""
    return lines.groupBy("project_dir", "session_id").agg(F.max("line_number").alias("max_line"))


@dataclass
class Scan:
    """What a run found.

    `lines`: the parsed lines of changed files from where they had not been done, with
    `done` for those that earlier runs have committed. `new`: the kept lines among them
    that are not done. `seen`: sessions with max_line, start_line, n_lines (new ones) and
    bytes_read; those with new kept lines, or whose lines go on past the cursor with
    noise only, so that the cursor can follow.
    """

    lines: DataFrame
    new: DataFrame
    seen: DataFrame


def scan_new_lines(spark: SparkSession, root: str, sessions: DataFrame, as_of: str, force: bool = False, project: str | None = None, session: str | None = None) -> Scan:
    """The lines of changed files that no run has done yet; of a file only what lies past its cursor's byte is read."""
    wanted = F.lit(True)
    if project is not None:
        wanted = wanted & (F.col("project_dir") == project)
    if session is not None:
        wanted = wanted & (F.col("session_id") == session)
    files = written(needs_scan(list_session_files(spark, root).filter(wanted), sessions, force))
    lines = read_lines(spark, files).join(files.select(*SESSION, "start_line", "islands"), SESSION)
    lines = lines.withColumn("done", F.exists("islands", lambda i: F.col("line_number").between(i["first"], i["last"]))).drop("islands")
    parsed = parse_lines(lines, as_of)
    fresh = (F.col("status") == "kept") & ~F.col("done")
    counted = parsed.groupBy(*SESSION, "start_line").agg(F.max("line_number").alias("max_line"), F.count_if(fresh).alias("n_lines"), F.sum("fetched").alias("bytes_read"))
    return Scan(parsed, parsed.filter(fresh), written(counted.filter((F.col("n_lines") > 0) | (F.col("max_line") > F.col("start_line")))))


def cursors(lines: DataFrame, last_run_at: str | None) -> DataFrame:
    """Where each session stands, of all of its lines from its offset on (SESSION, line_number, at, next_at, closed, done).

    last_line is the last line before which all are done; read_offset and read_line lead
    to the first one that is not done or not ended yet; islands are the runs of done lines
    after that. Runs are found in stretches of line numbers, so that no session meets in
    one task, and then joined where stretches meet.
    """
    rest = F.when(~F.col("done"), F.col("line_number"))
    open_ = F.when(~F.col("done") | ~F.col("closed"), F.col("line_number"))
    ends = lines.groupBy(*SESSION).agg(
        F.coalesce(F.min(rest) - 1, F.max("line_number")).cast("int").alias("last_line"),
        F.coalesce(F.min(open_) - 1, F.max("line_number")).cast("int").alias("read_line"),
        F.coalesce(F.min(F.when(~F.col("done") | ~F.col("closed"), F.col("at"))), F.max("next_at")).alias("read_offset"),
    )
    ends = written(ends)
    after = lines.filter("done").join(ends.select(*SESSION, "read_line"), SESSION).filter("line_number > read_line")
    cut = after.select(*SESSION, "line_number", F.floor(F.col("line_number") / STRETCH).alias("stretch"))
    run = F.col("line_number") - F.row_number().over(Window.partitionBy(*SESSION, "stretch").orderBy("line_number"))
    pieces = cut.withColumn("run", run).groupBy(*SESSION, "stretch", "run").agg(F.min("line_number").alias("first"), F.max("line_number").alias("last"))
    order = Window.partitionBy(*SESSION).orderBy("first")
    starts = F.coalesce(F.col("first") > F.lag("last").over(order) + 1, F.lit(True)).cast("int")
    joined = pieces.withColumn("new", starts).withColumn("island", F.sum("new").over(order)).groupBy(*SESSION, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    islands = joined.groupBy(*SESSION).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("islands"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return ends.join(islands, SESSION, "left").withColumn("islands", F.coalesce("islands", none)).withColumn("last_run_at", F.lit(last_run_at).cast("string"))


def metadata_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Cwd and title of these files' sessions; no other file is read."""
    return session_metadata(read_lines(spark, whole(files)))


def session_metadata(lines: DataFrame) -> DataFrame:
    """The last non-empty cwd and title of each session; bad lines are passed over."""
    raw = F.try_parse_json("raw_text")
    found = lines.select("project_dir", "session_id", "line_number", F.try_variant_get(raw, "$.cwd", "string").alias("cwd"), F.try_variant_get(raw, "$.aiTitle", "string").alias("title"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("line_number"))).alias(c)
    return found.groupBy("project_dir", "session_id").agg(last("cwd"), last("title"))
