"""Coalescing file changes, in batch and as a stream, and applying them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators.embedding import EmbedderFactory
from textquarry.operators.filters import IndexRules
from textquarry.operators.projects import assign_project
from textquarry.plans.joins import cut_lineage, lookup_join
from textquarry.plans.refresh import WATCHED_OPS, apply_changes
from textquarry.sources.store import IndexStore
from textquarry.streaming.debounce import bucket_of, debounce_rows

QUIET_SECONDS = 2
BLOCK_SECONDS = 3600


def _followed(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("op").isin(*WATCHED_OPS))


def debounce_changes(
    changes: DataFrame,
    quiet_seconds: float = QUIET_SECONDS,
    block_seconds: int = BLOCK_SECONDS,
    buckets: int = 0,
) -> DataFrame:
    """Bursts of changes per project: each ends when nothing happens for a while.

    Output: one row per burst and path, ``project_id, burst_start, burst_end,
    path, n_events``.  Events exactly ``quiet_seconds`` apart are one burst.  With
    ``buckets`` the paths of a project are dealt to so many buckets, each with
    bursts of its own, and the ``bucket`` is a column too.

    Bursts are found in two levels.  Events meet their predecessor within a
    block of time; only each block's first and last event and last burst start
    are compared across blocks, so a project with most of the events is not
    handled by one task.  Paths are counted per burst, never collected.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    keys = ["project_id"]
    followed = _followed(changes)
    if buckets:
        keys.append("bucket")
        followed = followed.withColumn("bucket", bucket_of(F.col("path"), buckets))
    events = followed.select(
        *keys, "path", "ts", micros.alias("us"),
        F.floor(micros / (block_seconds * 1_000_000)).alias("block"),
    )
    gap = int(quiet_seconds * 1_000_000)
    edges = events.groupBy(*keys, "block").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    by_block = Window.partitionBy(*keys).orderBy("block")
    edges = edges.withColumn("prev_us", F.lag("last_us").over(by_block)).select(*keys, "block", "prev_us")
    in_block = Window.partitionBy(*keys, "block").orderBy("us")
    previous = F.coalesce(F.lag("us").over(in_block), F.col("prev_us"))
    starts = (
        events.join(edges, [*keys, "block"])
        .withColumn("previous", previous)
        .withColumn(
            "start_us",
            F.when(F.col("previous").isNull() | (F.col("us") - F.col("previous") > gap), F.col("us")),
        )
    )
    so_far = in_block.rangeBetween(Window.unboundedPreceding, 0)
    placed = starts.withColumn("own_start", F.max("start_us").over(so_far))
    carried = placed.groupBy(*keys, "block").agg(F.max("start_us").alias("last_start"))
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *keys, "block", F.max("last_start").over(earlier).alias("carried_start")
    )
    located = placed.join(carried, [*keys, "block"]).select(
        *keys, "path", "us", F.coalesce("own_start", "carried_start").alias("start_us")
    )
    per_path = located.groupBy(*keys, "start_us", "path").agg(
        F.count("*").alias("n_events"), F.max("us").alias("last_us")
    )
    per_burst = located.groupBy(*keys, "start_us").agg(F.max("us").alias("end_us"))
    # A burst may hold most of the events, but only one row per path is joined.
    return (
        per_path.drop("last_us")
        .join(per_burst, [*keys, "start_us"])
        .select(
            *keys,
            F.timestamp_micros("start_us").alias("burst_start"),
            F.timestamp_micros("end_us").alias("burst_end"),
            "path",
            "n_events",
        )
    )


def debounce_stream(
    changes: DataFrame,
    quiet_seconds: float = QUIET_SECONDS,
    lateness: str = "10 seconds",
    buckets: int = 1,
) -> DataFrame:
    """The same bursts from a stream, one row per burst and path.

    A burst is emitted once the watermark has passed its end.  With ``buckets``
    above 1 a project's paths are dealt to so many buckets, each with bursts of its
    own, as ``debounce_changes`` does with the same number, so that a project with
    most of the events is kept by several tasks.  Rows without a path move the clock.
    """
    followed = changes.where(F.col("op").isin(*WATCHED_OPS) | F.col("path").isNull())
    return debounce_rows(followed, quiet_seconds, lateness, buckets)


def with_clock(changes: DataFrame) -> DataFrame:
    """Add a row without a path every second, so that a quiet stream's last bursts end."""
    spark = changes.sparkSession
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    columns = [
        (F.col("timestamp") if name == "ts" else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()
    ]
    return changes.unionByName(ticks.select(*columns))


def start_change_stream(
    changes: DataFrame,
    store: IndexStore,
    files: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    rules: IndexRules = IndexRules(),
    *,
    projects: DataFrame | None = None,
    source: str = "changes",
    factory: EmbedderFactory | None = None,
    trigger: dict | None = None,
    quiet_seconds: float = QUIET_SECONDS,
    lateness: str = "10 seconds",
    buckets: int = 1,
) -> StreamingQuery:
    """Keep a store up to date from a stream of changes ``path, op, ts``.

    Changes go through ``debounce_stream``: a path is indexed again once its burst
    is over, however often it changed in it.  Bursts are kept per ``project_id``
    where the changes have one.  ``files(touched)`` gives the present files among the
    touched paths, as ``scan_paths`` does: a micro-batch lists and reads what it
    changes, not the tree.  ``projects`` (``project_id, root, ord``) says which
    project a path belongs to; a path outside all of them belongs to one named after
    its directory.  The batch id is stored with each commit, so a batch that is run
    again after a failure is applied once.
    """
    named = changes if "project_id" in changes.columns else changes.withColumn("project_id", F.lit(""))

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= store.applied(source):
            return
        touched = cut_lineage(batch.select("path").distinct(), "touched")
        if touched.isEmpty():
            return
        present = files(touched)
        if projects is not None:
            owners = cut_lineage(assign_project(touched, projects), "owners")
            present = lookup_join(present.drop("project_id"), owners, ["path"])
        apply_changes(
            store, touched.withColumns({"op": F.lit(WATCHED_OPS[0]), "ts": F.lit(None).cast("timestamp")}),
            present, rules, factory=factory, source=source, source_batch=batch_id,
        )

    return (
        debounce_stream(named, quiet_seconds, lateness, buckets)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{QUIET_SECONDS} seconds"}))
        .start()
    )
