"""File trees as DataFrames.

The ``files`` schema used everywhere: ``project_id, path, rel_path, content,
size, mod_time, file_hash``.

Trees are listed and read by tasks through Arrow's file systems.  Spark's own
file sources skip every name that starts with a dot or an underscore, and with
it ``.gitignore`` and ``__init__.py``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.paths import ancestors, base_name, relative_to, under_path
from textquarry.functions.text import content_hash
from textquarry.operators.filters import IndexRules, gitignore_filter, text_files
from textquarry.plans.joins import cut_lineage
from textquarry.sources.tree import LISTING, file_system, list_tree

FILE_COLUMNS = ["project_id", "path", "rel_path", "content", "size", "mod_time", "file_hash"]
BYTES_PER_TASK = 128 * 1024 * 1024
BYTES_PER_BATCH = 16 * 1024 * 1024


def stat_paths(paths: DataFrame, root: str) -> DataFrame:
    """``path, size, mod_time`` of those of the given paths that are files now.

    Only these paths are asked for, by the tasks that hold them.
    """

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(root)
        for batch in batches:
            found = system.get_file_info(batch.column(0).to_pylist())
            found = [i for i in found if i.type == pafs.FileType.File]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i.path for i in found], pa.string()),
                    pa.array([i.size or 0 for i in found], pa.int64()),
                    pa.array([i.mtime for i in found], pa.timestamp("us", tz="UTC")),
                ],
                names=["path", "size", "mod_time"],
            )

    inside = paths.select("path").distinct().where(under_path(F.col("path"), file_system(root)[1]))
    # A path that climbs out of the tree again is not below it.
    inside = inside.where(~F.concat("path", F.lit("/")).contains("/../"))
    return inside.mapInArrow(ask, LISTING)


def scan_paths(
    spark: SparkSession,
    project_id: str,
    root: str,
    paths: DataFrame,
    rules: IndexRules = IndexRules(),
) -> DataFrame:
    """Indexable files among the given paths of a project directory.

    Besides them only the ignore files of the directories above are read.
    """
    root = root.rstrip("/") or "/"
    top = file_system(root)[1].rstrip("/") or "/"
    listing = cut_lineage(stat_paths(paths, root), "listing")
    above = listing.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    ignores = above.where(under_path(F.col("dir"), top)).select(
        F.concat(F.when(F.col("dir") == "/", "").otherwise(F.col("dir")), F.lit("/.gitignore")).alias("path")
    )
    accepted = listing.where(
        rules.accepts(relative_to(F.col("path"), F.lit(top)), F.col("size"))
    )
    kept = gitignore_filter(accepted, top, read_contents(stat_paths(ignores, root), root))
    return file_rows(read_contents(kept, root), project_id, top)


def read_contents(
    listing: DataFrame, root: str, *, skip_unreadable: bool = False
) -> DataFrame:
    """Add ``content`` (bytes) to listed files, read by the tasks.

    A file that cannot be read fails the job, or is left out.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema.fields)

    def emit(batch: pa.RecordBatch, kept: list[int], contents: list[bytes]) -> pa.RecordBatch:
        rows = batch.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(contents, pa.binary())], names=[*rows.schema.names, "content"]
        )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(root)
        for batch in batches:
            kept, contents, size = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with system.open_input_stream(path) as stream:
                        data = stream.read()
                except OSError:
                    if not skip_unreadable:
                        raise
                    continue
                kept.append(i)
                contents.append(data)
                size += len(data)
                if size >= BYTES_PER_BATCH:
                    yield emit(batch, kept, contents)
                    kept, contents, size = [], [], 0
            if kept:
                yield emit(batch, kept, contents)

    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cores = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, int(total // BYTES_PER_TASK) + 1)
    return listing.repartition(tasks).mapInArrow(read, schema + ", content binary")


def file_rows(raw: DataFrame, project_id: str | None = None, root: str = "/") -> DataFrame:
    """Bring raw files to the ``files`` schema.

    The hash is over the raw bytes; the text has malformed UTF-8 replaced.
    """
    content = F.col("content").cast("binary")
    project = F.lit(project_id) if project_id is not None else F.col("project_id")
    mod_time = F.col("mod_time") if "mod_time" in raw.columns else F.lit(None).cast("timestamp")
    return raw.select(
        project.alias("project_id"),
        "path",
        relative_to(F.col("path"), F.lit(root.rstrip("/") or "/")).alias("rel_path"),
        F.make_valid_utf8(content.cast("string")).alias("content"),
        F.octet_length(content).cast("bigint").alias("size"),
        mod_time.alias("mod_time"),
        content_hash(content).alias("file_hash"),
    )


def scan_project(
    spark: SparkSession, project_id: str, root: str, rules: IndexRules = IndexRules()
) -> DataFrame:
    """Indexable files of one project directory.

    Rules and ignore files are applied to the listing; only files that pass are
    read.
    """
    root = root.rstrip("/") or "/"
    listing = cut_lineage(list_tree(spark, root), "listing")
    top = file_system(root)[1].rstrip("/") or "/"
    ignore_files = listing.where(base_name(F.col("path")) == ".gitignore")
    accepted = listing.where(
        rules.accepts(relative_to(F.col("path"), F.lit(top)), F.col("size"))
    )
    kept = gitignore_filter(accepted, top, read_contents(ignore_files, root))
    return file_rows(read_contents(kept, root), project_id, top)


def scan_text_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files line search looks at: no index rules, only text, of any size by default.

    Unreadable files are left out.
    """
    listed = list_tree(spark, root)
    if max_bytes is not None:
        listed = listed.where(F.col("size") <= max_bytes)
    raw = read_contents(listed, root, skip_unreadable=True)
    return text_files(raw, max_bytes).select(
        "path", "size", "mod_time",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
