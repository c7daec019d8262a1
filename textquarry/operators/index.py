"""Keeping the index tables in step with the files, and reporting on them.

Tables: ``chunk_vectors`` (chunks plus ``embedding``), ``symbols`` and
``file_state`` (``path, project_id, file_hash``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.paths import under_path
from textquarry.plans.joins import cut_lineage, lookup_join

SYMBOL_COLUMNS = [
    "project_id", "path", "language", "symbol", "signature", "start_line", "end_line",
]


def compare_files(files: DataFrame, file_state: DataFrame) -> DataFrame:
    """``path, project_id, file_hash`` and ``status`` new, modified or unchanged of all files.

    Contents take no part in the comparison.
    """
    known = file_state.select("path", F.col("file_hash").alias("known_hash"))
    status = (
        F.when(F.col("known_hash").isNull(), "new")
        .when(F.col("known_hash") != F.col("file_hash"), "modified")
        .otherwise("unchanged")
    )
    narrow = files.select("path", "project_id", "file_hash")
    return narrow.join(known, "path", "left").withColumn("status", status).drop("known_hash")


def changed_files(
    files: DataFrame, file_state: DataFrame, compared: DataFrame | None = None
) -> DataFrame:
    """Files whose content is not what was indexed, with their ``status``.

    Paths measured to be few go to the file scan; contents are shuffled only
    where too many files changed for that.  ``compared`` may bring the stored
    comparison.
    """
    compared = compare_files(files, file_state) if compared is None else compared
    changed = compared.where(F.col("status") != "unchanged").select("path", "status")
    return lookup_join(files, changed, ["path"])


def deleted_files(file_state: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed paths that no longer exist."""
    return file_state.join(files.select("path"), "path", "left_anti")


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add chunks; a chunk with a stored id replaces it.

    The same text twice in one file has one id: its last place is kept.  Stored rows
    have distinct ids.  Ids measured to be few go to the stored chunks, which then
    stay where they are.  Where nothing is stored, the incoming chunks are worked out once.
    """
    columns = stored.columns
    last = Window.partitionBy("chunk_id").orderBy(F.desc("start_line"), F.desc("end_line"))
    fresh = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*columns)
    if stored.isEmpty():
        return fresh
    replaced = cut_lineage(incoming.select("chunk_id").distinct(), "replaced")
    return lookup_join(stored, replaced, ["chunk_id"], "left_anti").select(*columns).unionByName(fresh)


def delete_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of any path-keyed index table without the given paths.

    Paths measured to be few go to the table; only beyond that is it shuffled.
    """
    return lookup_join(table, paths.select("path").distinct(), ["path"], "left_anti")


def delete_prefix(table: DataFrame, prefix: str) -> DataFrame:
    """Rows not below ``prefix``; ``""`` deletes everything."""
    return table.where(~under_path(F.col("path"), prefix))


def merge_index(table: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace all rows of changed paths by fresh ones."""
    return delete_paths(table, changed).unionByName(fresh.select(*table.columns))


def symbol_table(chunks: DataFrame) -> DataFrame:
    """One row per named location; the same definition twice stays two rows."""
    return chunks.where(F.col("symbol") != "").select(
        *SYMBOL_COLUMNS, F.lower("symbol").alias("symbol_lc")
    )


def with_cached_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach stored embeddings by chunk id; ``embedding`` is null where missing.

    ``vectors`` has one row per chunk id, as the index keeps them.  Measured to be
    few, as those of changed files are, they go to the chunks, and no content is
    shuffled.
    """
    return lookup_join(chunks, vectors.select("chunk_id", "embedding"), ["chunk_id"], "left")


def indexed_paths(file_state: DataFrame) -> DataFrame:
    return file_state.select("path").distinct()


def count_by_project(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """Stored chunks of every given project; 0 for unknown or empty ones."""
    counts = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))
    return (
        projects.select("project_id").distinct()
        .join(counts, "project_id", "left")
        .select("project_id", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))
    )


def index_status(
    chunks: DataFrame, symbols: DataFrame, file_state: DataFrame, projects: DataFrame
) -> DataFrame:
    """Chunks, symbols and last index time per project, and a ``*`` total row.

    ``file_state`` brings ``indexed_at``.  Totals count everything stored, also
    rows of projects that are no longer listed.
    """
    per_chunk = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))
    per_symbol = symbols.groupBy("project_id").agg(F.count("*").alias("symbols"))
    per_time = file_state.groupBy("project_id").agg(F.max("indexed_at").alias("last_indexed_at"))
    facts = (
        per_chunk.join(per_symbol, "project_id", "full")
        .join(per_time, "project_id", "full")
        .select(
            "project_id",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("symbols", F.lit(0)).alias("symbols"),
            "last_indexed_at",
        )
    )
    listed = (
        projects.select("project_id").distinct()
        .join(facts, "project_id", "left")
        .select(
            "project_id",
            F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
            F.coalesce("symbols", F.lit(0)).cast("bigint").alias("symbols"),
            "last_indexed_at",
        )
    )
    total = facts.agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks"),
        F.coalesce(F.sum("symbols"), F.lit(0)).cast("bigint").alias("symbols"),
        F.max("last_indexed_at").alias("last_indexed_at"),
    ).select(F.lit("*").alias("project_id"), "chunks", "symbols", "last_indexed_at")
    return listed.unionByName(total)


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("project_id").alias("name"), F.col("root").alias("path"))


def file_state_of(files: DataFrame) -> DataFrame:
    return files.select("path", "project_id", "file_hash")


