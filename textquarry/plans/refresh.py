"""Whole-index jobs: refresh, rebuild and remove projects, apply changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.paths import self_and_ancestors, under_path
from textquarry.operators.chunking import chunk_files
from textquarry.operators.embedding import EmbedderFactory, embed_chunks
from textquarry.operators.filters import IndexRules
from textquarry.operators.index import (
    changed_files,
    compare_files,
    deleted_files,
    file_state_of,
)
from textquarry.plans.joins import cut_lineage, fits_broadcast, lookup_join
from textquarry.sources.store import IndexStore

# Operations of a change that leave a file behind, and all that are followed.
WATCHED_OPS = ("write", "create", "rename", "remove")


def build_chunk_vectors(
    files: DataFrame,
    vectors: DataFrame | None = None,
    *,
    factory: EmbedderFactory | None = None,
) -> DataFrame:
    """Files to chunks with vectors; equal texts within a file are one chunk."""
    return embed_chunks(chunk_files(files, distinct=True), vectors, factory=factory)


def _vectors_of(store: IndexStore, files: DataFrame) -> DataFrame:
    """Stored vectors that chunks of the given files could have.

    A chunk id contains its path.  For a small set of files the store is
    filtered by their paths, so that a few changes never shuffle all vectors.
    """
    vectors = store.chunk_vectors().select("chunk_id", "path", "embedding")
    paths = files.select("path").distinct()
    if fits_broadcast(paths):
        vectors = vectors.join(F.broadcast(paths), "path", "left_semi")
    return vectors.select("chunk_id", "embedding")


def index_changed(
    store: IndexStore,
    files: DataFrame,
    state: DataFrame,
    *,
    drop_missing: bool,
    factory: EmbedderFactory | None = None,
    source: str = "",
    source_batch: int = -1,
) -> int:
    """Index the files that differ from ``state``; optionally drop missing ones.

    Paths and hashes are compared and written out; contents are read for the
    changed files alone, and never written anywhere but to the index.
    """
    compared = cut_lineage(compare_files(files, state), "compared")
    changed = compared.where(F.col("status") != "unchanged")
    contents = changed_files(files, state, compared).drop("status")
    fresh = build_chunk_vectors(contents, _vectors_of(store, changed), factory=factory)
    gone = deleted_files(state, compared) if drop_missing else None
    return store.replace(
        file_state_of(changed), fresh, removed=gone, source=source, source_batch=source_batch
    )


def refresh_project(
    store: IndexStore, files: DataFrame, project_id: str, *, factory: EmbedderFactory | None = None
) -> int:
    """Bring a project's rows up to date with its files.

    Only new and modified files are chunked and embedded; rows of files that
    are gone are dropped.
    """
    state = store.file_state().where(F.col("project_id") == project_id)
    return index_changed(store, files, state, drop_missing=True, factory=factory)


def rebuild_project(
    store: IndexStore, files: DataFrame, root: str, *, factory: EmbedderFactory | None = None
) -> int:
    """Drop everything below ``root`` (``""``: the whole index) and index ``files``.

    Files are read once, and their contents written to the index only.
    """
    below = under_path(F.col("path"), root)
    old = store.file_state().where(below)
    known = store.chunk_vectors().where(below).select("chunk_id", "embedding")
    return store.replace(None, build_chunk_vectors(files, known, factory=factory), removed=missing_from(old))


def missing_from(candidates: DataFrame):
    """Which of some paths a write did not bring."""
    return lambda written: candidates.select("path").join(written, "path", "left_anti")


def remove_project(store: IndexStore, root: str) -> int:
    """Drop everything below a project's root."""
    return store.delete(store.file_state().where(under_path(F.col("path"), root)))


def _inside(table: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct paths of a table that are, or lie below, one of the roots."""
    exploded = table.select(
        "path", F.explode_outer(self_and_ancestors(F.col("path"))).alias("root")
    )
    return lookup_join(exploded, roots, ["root"], "left_semi").select("path").distinct()


def reindex_paths(
    store: IndexStore,
    files: DataFrame,
    paths: DataFrame,
    rules: IndexRules = IndexRules(),
    *,
    factory: EmbedderFactory | None = None,
) -> int:
    """Index given files and everything below given directories again.

    Stored rows there that no indexable file stands behind any more are dropped.
    """
    roots = cut_lineage(paths.select(F.col("path").alias("root")).distinct(), "roots")
    indexable = files.where(rules.accepts(F.col("rel_path"), F.col("size")))
    wanted = cut_lineage(_inside(indexable, roots), "wanted")
    again = lookup_join(indexable, wanted, ["path"], "left_semi")
    old = _inside(store.file_state(), roots)
    fresh = build_chunk_vectors(again, _vectors_of(store, wanted), factory=factory)
    return store.replace(None, fresh, removed=missing_from(old))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last followed operation per path of a batch of changes."""
    followed = changes.where(F.col("op").isin(*WATCHED_OPS))
    return followed.groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))


def apply_changes(
    store: IndexStore,
    changes: DataFrame,
    files: DataFrame,
    rules: IndexRules = IndexRules(),
    *,
    factory: EmbedderFactory | None = None,
    source: str = "",
    source_batch: int = -1,
) -> int:
    """Apply a batch of changes to the store; repeating a batch changes nothing.

    ``files`` is the present state of the tree, or of the touched paths.  What
    matters is whether a changed path is an indexable file now: if so it is indexed
    again, and if it is missing or filtered out its rows go.
    """
    if source and source_batch <= store.applied(source):
        return -1
    touched = cut_lineage(latest_changes(changes).select("path"), "touched")
    indexable = files.where(rules.accepts(F.col("rel_path"), F.col("size")))
    again = lookup_join(indexable, touched, ["path"], "left_semi")
    fresh = build_chunk_vectors(again, _vectors_of(store, touched), factory=factory)
    return store.replace(
        None, fresh, removed=missing_from(touched), source=source, source_batch=source_batch
    )
