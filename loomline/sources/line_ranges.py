"""Lines of growing text files by byte ranges: a data source whose tasks read just the ranges they are given.

Each file comes with where to start and where to stop, so that what was read before
and what is appended later costs nothing. A file is cut into ranges of RANGE_BYTES,
small ones share a task; a line belongs to the range that its first byte lies in.
Lines end with LF, CR LF or CR; the last one may have no end yet.

Tasks open files through pyarrow's file systems: paths are local or in a file system
that pyarrow knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
STEP_BYTES = 1 << 20
BATCH_LINES = 5000
SCHEMA = "path string, part int, place int, at long, next_at long, closed boolean, fetched long, raw_text string"


class Ranges(InputPartition):
    """Ranges that one task reads: path, where the file's reading starts, start and stop of the range, where its reading stops, and its number."""

    def __init__(self, ranges: list[tuple[str, int, int, int, int, int]]) -> None:
        self.ranges = ranges


def cut_ranges(files: Sequence[tuple[str, int, int]], size: int = RANGE_BYTES) -> list[Ranges]:
    """Tasks for files (path, start, stop): ranges of at most `size` bytes, and together at most that many a task."""
    tasks: list[Ranges] = []
    room = 0
    for path, first, last in files:
        for number, start in enumerate(range(first, last, size)):
            stop = min(start + size, last)
            if stop - start > room:
                tasks.append(Ranges([]))
                room = size
            tasks[-1].ranges.append((path, first, start, stop, last, number))
            room -= stop - start
    return tasks


def open_file(path: str) -> pa.NativeFile:
    """A file by its path or URI as Spark lists it, in which nothing is percent-encoded."""
    scheme, host, name = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/]*)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return LocalFileSystem().open_input_file(name)
    files, base = FileSystem.from_uri(f"{scheme}:{host or '//'}/")
    return files.open_input_file(base.rstrip("/") + name)


class _Bytes:
    """Bytes of an open file, and how many were asked of it."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.fetched = file, 0

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        found = self.file.read(stop - start)
        self.fetched += len(found)
        return found


def lines_of_range(source: _Bytes, first: int, start: int, stop: int, last: int) -> Iterator[tuple[int, int, bytes]]:
    """First byte, text and the byte after its end, of each line that begins in [start, stop) of a file read from `first` to `last`.

    From a range's second on, one byte more is read in front, so that what belongs to
    the line before, at least that byte, is passed over.
    """
    at = start if start == first else start - 1
    held, end = b"", at
    passed = start == first
    while True:
        step = min(STEP_BYTES, stop - end) if end < stop else min(STEP_BYTES, last - end)
        more = source.read(end, end + step) if step > 0 else b""
        end += len(more)
        whole = not more or end >= last
        parts = (held + more).splitlines(keepends=True)
        # the last part may go on; a CR may be followed by its LF
        keep = parts.pop() if parts and not whole and not parts[-1].endswith(b"\n") else b""
        for part in parts:
            if passed:
                if at >= stop:
                    return
                text = part.rstrip(b"\r\n") if part.endswith((b"\n", b"\r")) else part
                yield at, at + len(part), text
            passed = True
            at += len(part)
        held = keep
        if whole or at >= stop or (end >= stop and not passed):
            return


class LineReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int, int]], size: int) -> None:
        self.files, self.size = files, size

    def partitions(self) -> list[InputPartition]:
        return cut_ranges(self.files, self.size) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("at", pa.int64()), ("next_at", pa.int64()), ("closed", pa.bool_()), ("fetched", pa.int64()), ("raw_text", pa.string())])
        rows: list[tuple] = []
        held = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        for path, first, start, stop, last, number in partition.ranges:
            with open_file(path) as file:
                source, told = _Bytes(file), 0
                for place, (at, after, text) in enumerate(lines_of_range(source, first, start, stop, last)):
                    # each line tells what was fetched since the one before, so that sums over lines are right
                    rows.append((path, number, place, at, after, after - at > len(text), source.fetched - told, text.decode("utf-8", "replace")))
                    told, held = source.fetched, held + len(text)
                    if len(rows) >= BATCH_LINES or held > STEP_BYTES * 8:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class LineRanges(DataSource):
    """Options: `files`, JSON of [path, start, stop] each, and `bytes`, the size of a range."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:  # noqa: ANN001
        return LineReader([tuple(f) for f in json.loads(self.options.get("files", "[]"))], int(self.options.get("bytes", RANGE_BYTES)))


def read_ranges(spark: SparkSession, files: Sequence[tuple[str, int, int]], size: int | None = None) -> DataFrame:
    """Lines of files (path, start, stop): path, part (a range's number), place in it, at and next_at (bytes), closed, fetched, raw_text."""
    spark.dataSource.register(LineRanges)
    return spark.read.format("line_ranges").option("files", json.dumps(list(files))).option("bytes", str(size or RANGE_BYTES)).load()
