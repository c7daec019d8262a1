"""File trees as a data source: ``spark.read.format("tree")``.

Option ``path`` is the tree, option ``work`` a table of what there is to list, which
``write_work`` makes: a row a directory or, of a directory with many entries, a row a
slice of its names.  A partition is a file of that table, so a flat folder of a million
names is listed by many tasks, each of which asks for size and time of its own names
only.  Filters on size, time and the text of a path are applied while listing, those
on paths before a file is asked for anything.

Links to directories are not entered; broken links and special files are left out.
"""

from __future__ import annotations

import datetime as dt
import operator
import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from textquarry.session import scratch_path

LISTING = "path string, size bigint, mod_time timestamp"
WORK = "path string, slice int, slices int"
SLICE_NAMES = 20_000
BATCH_FILES = 10_000
UTC = dt.timezone.utc

TEXT_TESTS = {
    EqualTo: operator.eq,
    In: lambda text, values: text in values,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: operator.contains,
}
VALUE_TESTS = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
}


def file_system(root: str):
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _entries(system, folder: str) -> tuple[int, list[str]]:
    """How many entries a directory has, and its directories; nothing is asked of files."""
    if isinstance(system, pafs.LocalFileSystem):
        count, folders = 0, []
        try:
            with os.scandir(folder) as found:
                for entry in found:
                    count += 1
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.path)
        except FileNotFoundError:
            pass
        return count, folders
    infos = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return len(infos), [i.path for i in infos if i.type == pafs.FileType.Directory]


def write_work(spark: SparkSession, root: str, *, slice_names: int = SLICE_NAMES) -> str:
    """Find all directories below a root and write what there is to list; returns the folder.

    Directories are found level by level, each level by as many tasks as it has
    directories to offer; paths do not pass through the driver.  Only local file
    systems can name entries without their sizes, so only there directories are cut.
    """
    system, top = file_system(root)
    sliced = isinstance(system, pafs.LocalFileSystem)

    def children(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(root)
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                count, folders = _entries(system, folder)
                rows += [(folder, count), *((f, None) for f in folders)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                names=["path", "entries"],
            )

    width = spark.sparkContext.defaultParallelism * 4
    found = scratch_path(spark, "directories")
    level, depth = spark.createDataFrame([(top.rstrip("/") or "/",)], "path string"), 0
    while level is not None:
        path = f"{found}/depth={depth}"
        level.mapInArrow(children, "path string, entries bigint").write.parquet(path)
        below = spark.read.parquet(path).where("entries is null").select("path")
        level, depth = None if below.isEmpty() else below.repartition(width), depth + 1
    counted = spark.read.parquet(found).where("entries > 0")
    slices = F.ceil(F.col("entries") / slice_names).cast("int") if sliced else F.lit(1)
    rows = counted.select("path", slices.alias("slices"), "entries")
    rows = rows.select("path", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "slices")
    total = counted.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    work = scratch_path(spark, "tree")
    rows.repartition(max(width, -(-total // slice_names))).write.parquet(work)
    return work


class _Part(InputPartition):
    def __init__(self, file: str):
        self.file = file


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.work = options["path"], options["work"]
        self.tests: dict[str, list] = {"path": [], "size": [], "mod_time": []}

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            known = TEXT_TESTS if name == "path" else VALUE_TESTS if name in self.tests else {}
            if type(f) in known and f.value is not None:
                value = set(f.value) if isinstance(f, In) else f.value
                if isinstance(value, dt.datetime) and value.tzinfo is None:
                    value = value.replace(tzinfo=UTC)
                self.tests[name].append((known[type(f)], value))
            elif not (isinstance(f, IsNotNull) and name in self.tests):
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.work)
        files = [i.path for i in system.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".parquet")]
        return [_Part(f) for f in sorted(files)] or [_Part("")]

    def _passes(self, name: str, value) -> bool:
        return all(test(value, bound) for test, bound in self.tests[name])

    def _files(self, system, folder: str, part: int, parts: int) -> Iterator[tuple]:
        """(path, size, time) of a slice of a directory's files."""
        if not isinstance(system, pafs.LocalFileSystem):
            for i in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if i.type == pafs.FileType.File and self._passes("path", i.path):
                    yield i.path, i.size or 0, i.mtime
            return
        try:
            found = os.scandir(folder)
        except FileNotFoundError:
            return
        with found:
            for entry in found:
                if parts > 1 and zlib.crc32(os.fsencode(entry.name)) % parts != part:
                    continue
                if not self._passes("path", entry.path) or not entry.is_file():
                    continue
                try:
                    stat = entry.stat()
                except FileNotFoundError:
                    continue
                micros = stat.st_mtime_ns // 1000
                yield entry.path, stat.st_size, dt.datetime.fromtimestamp(0, UTC) + dt.timedelta(microseconds=micros)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = file_system(self.root)
        shared, _ = file_system(self.work)
        rows: list[tuple] = []
        with shared.open_input_file(partition.file) as source:
            work = pq.read_table(source).to_pylist()
        for w in work:
            for path, size, time in self._files(system, w["path"], w["slice"], w["slices"]):
                if self._passes("size", size) and self._passes("mod_time", time):
                    rows.append((path, size, time))
                if len(rows) >= BATCH_FILES:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.timestamp("us", tz="UTC")),
            ],
            names=["path", "size", "mod_time"],
        )


class TreeDataSource(DataSource):
    """``tree``: options path (the tree) and work (what ``write_work`` wrote)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def list_tree(spark: SparkSession, root: str, *, slice_names: int = SLICE_NAMES) -> DataFrame:
    """Every file below ``root``: ``path, size, mod_time``, without content.

    Conditions on the result are pushed into the listing where they can be.
    """
    spark.dataSource.register(TreeDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    work = write_work(spark, root, slice_names=slice_names)
    return spark.read.format("tree").option("work", work).load(root)
