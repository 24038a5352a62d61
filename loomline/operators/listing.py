"""Listings of sessions on disk, joined with what has been analyzed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import is_temp_path
from loomline.operators import paging

SORTS = ("mtime", "title", "analyzed")
MAX_PAGE = 100


def session_listing(files: DataFrame, analyzed: DataFrame, project_dir: str) -> DataFrame:
    """A project's session files with analyzed and run_count; analyzed is G10's (project, session, count)."""
    runs = analyzed.select("project_dir", "session_id", F.col("count").alias("run_count"))
    joined = files.filter(F.col("project_dir") == project_dir).join(runs, ["project_dir", "session_id"], "left")
    return joined.withColumn("analyzed", F.col("run_count").isNotNull()).withColumn("run_count", F.coalesce("run_count", F.lit(0)))


def filter_listing(listing: DataFrame, analyzed: bool | None = None, query: str = "") -> DataFrame:
    """analyzed or not, and a text in the session's id or title."""
    if analyzed is not None:
        listing = listing.filter(F.col("analyzed") == analyzed)
    q = query.strip().lower()
    if q:
        listing = listing.filter(F.lower("session_id").contains(q) | F.coalesce(F.lower("title").contains(q), F.lit(False)))
    return listing


def page_of(listing: DataFrame, sort_by: str = "mtime", descending: bool = True, page: int = 1, page_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one page of rows with their place, one row of total and total_pages). Ties by session id."""
    if sort_by not in SORTS or page < 1 or page_size < 1:
        raise ValueError("sort_by, page or page_size")
    page_size = min(page_size, MAX_PAGE)
    key = F.coalesce(F.col(sort_by).cast("string") if sort_by == "mtime" else F.col(sort_by), F.lit(False) if sort_by == "analyzed" else F.lit(""))
    order = [key.desc() if descending else key.asc(), F.col("session_id")]
    rows = paging.page(listing, order, (page - 1) * page_size, page_size)
    totals = listing.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)))
    return rows, totals


def with_metadata(page: DataFrame, metadata: DataFrame) -> DataFrame:
    """cwd and title of a page's sessions only: the page is cut before metadata is joined."""
    return page.join(metadata, ["project_dir", "session_id"], "left")


def first_of_projects(files: DataFrame) -> DataFrame:
    """Of each project outside scratch directories the file of its first session."""
    first = F.min_by(F.struct(*[c for c in files.columns if c != "project_dir"]), "session_id")
    return files.filter(~is_temp_path(F.col("project_dir"))).groupBy("project_dir").agg(first.alias("f")).select("project_dir", "f.*")


def session_projects(files: DataFrame, analyzed: DataFrame, metadata: DataFrame) -> DataFrame:
    """Projects outside scratch directories: sessions, analyzed sessions, and the cwd of one of them."""
    kept = files.filter(~is_temp_path(F.col("project_dir")))
    per = kept.groupBy("project_dir").agg(F.count("*").alias("session_count"), F.min("session_id").alias("session_id"))
    done = analyzed.groupBy("project_dir").agg(F.count("*").alias("analyzed_count"))
    joined = per.join(done, "project_dir", "left").join(metadata.select("project_dir", "session_id", "cwd"), ["project_dir", "session_id"], "left")
    out = joined.select("project_dir", "cwd", "session_count", F.coalesce("analyzed_count", F.lit(0)).alias("analyzed_count"))
    return out.orderBy(F.coalesce("cwd", "project_dir"), "project_dir")


def numbered(listing: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place in an order, for paging inside a project."""
    return listing.withColumn("place", F.row_number().over(Window.partitionBy("project_dir").orderBy(*order)))
