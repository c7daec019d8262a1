"""Keeping the memory corpus in step with incoming chat turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators.embedding import EmbedderFactory
from textquarry.plans.joins import cut_lineage, lookup_join
from textquarry.plans.refresh import build_chunk_vectors, index_changed, missing_from
from textquarry.sources.files import file_rows
from textquarry.sources.sessions import DEFAULT_PROVIDER, TURNS_PER_FILE, export_sessions, session_of
from textquarry.sources.store import IndexStore

SYNC_INTERVAL = "5 minutes"


def sync_sessions(
    store: IndexStore,
    turns: DataFrame,
    exported_at: Column,
    *,
    provider: str = DEFAULT_PROVIDER,
    min_user_bytes: int = 10,
    turns_per_file: int = TURNS_PER_FILE,
    factory: EmbedderFactory | None = None,
    source: str = "",
    source_batch: int = -1,
) -> int:
    """Export the given whole sessions and index those of their files that changed.

    Parts that a session no longer has are dropped.
    """
    files = file_rows(
        export_sessions(
            turns, exported_at, provider=provider, min_user_bytes=min_user_bytes, turns_per_file=turns_per_file
        )
    )
    given = turns.select(F.col("conv_id").cast("string").alias("session")).distinct()
    state = _state_of(store, provider).join(given, "session", "left_semi").drop("session")
    return index_changed(
        store, files, state, drop_missing=True, factory=factory, source=source, source_batch=source_batch
    )


def _state_of(store: IndexStore, provider: str) -> DataFrame:
    state = store.file_state().where(F.col("project_id") == "memory-" + provider)
    return state.withColumn("session", session_of(F.col("path")))


# --- sweep -----------------------------------------------------------------

DIGESTS = "session string, turns bigint, h1 bigint, h2 bigint"


def session_digests(turns: DataFrame) -> DataFrame:
    """What a session holds, as a digest that does not depend on the order of rows.

    Folded by the tasks that read the turns; no text is shuffled.
    """
    said = [F.col("turn"), F.col("role"), F.col("text")]
    return turns.groupBy(F.col("conv_id").cast("string").alias("session")).agg(
        F.count("*").alias("turns"),
        F.bit_xor(F.xxhash64(*said)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), *said)).alias("h2"),
    )


def _kept_digests(store: IndexStore, provider: str) -> tuple[DataFrame, int]:
    """The digests of the last sweep that was finished, and its number."""
    folder = f"digests/{provider}"
    done = [int(n) for n in store.names(folder) if n.isdigit() and "_SUCCESS" in store.names(f"{folder}/{n}")]
    if not done:
        return store.spark.createDataFrame([], DIGESTS), 0
    return store.spark.read.schema(DIGESTS).parquet(f"{store.folder}/{folder}/{max(done)}"), max(done)


def sweep_sessions(
    store: IndexStore,
    turns: DataFrame,
    exported_at: Column,
    *,
    provider: str = DEFAULT_PROVIDER,
    **options,
) -> int:
    """Find sessions that differ from the last sweep, whoever changed them, and sync those.

    ``turns`` are all turns there are; sessions that are gone lose their files.  Only
    digests are compared, so texts are read again for the differing sessions alone.
    Digests are kept after the sync: a sweep that dies is simply done again.
    Returns how many sessions differed.
    """
    now = cut_lineage(session_digests(turns), "digests")
    before, number = _kept_digests(store, provider)
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("turns", "h1", "h2")]
    compared = now.alias("n").join(before.alias("b"), "session", "full").select(
        "session", F.col("n.turns").isNull().alias("gone"), (same[0] & same[1] & same[2]).alias("same")
    )
    differing = cut_lineage(compared.where("not same").drop("same"), "differing")
    count = differing.count()
    if count:
        asked = differing.where("not gone").select(F.col("session").alias("_session"))
        changed = turns.withColumn("_session", F.col("conv_id").cast("string"))
        changed = lookup_join(changed, asked, ["_session"], "left_semi").drop("_session")
        sync_sessions(store, changed, exported_at, provider=provider, **options)
        gone = differing.where("gone").select("session")
        if not gone.isEmpty():
            store.delete(_state_of(store, provider).join(gone, "session", "left_semi").select("path"))
        now.write.mode("overwrite").parquet(f"{store.folder}/digests/{provider}/{number + 1}")
    return count


def start_memory_sweep(
    spark: SparkSession,
    store: IndexStore,
    sessions: Callable[[], DataFrame],
    exported_at: Column,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Sweep all sessions at every tick, every five minutes by default.

    ``sessions()`` returns all turns there are.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        sweep_sessions(store, sessions(), exported_at, **options)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(sweep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": SYNC_INTERVAL}))
        .start()
    )


def rebuild_memory(
    store: IndexStore, turns: DataFrame, exported_at: Column, *, provider: str = DEFAULT_PROVIDER,
    min_user_bytes: int = 10, turns_per_file: int = TURNS_PER_FILE, factory: EmbedderFactory | None = None,
) -> int:
    """Clear the provider's memory and export and index every session again."""
    files = file_rows(
        export_sessions(
            turns, exported_at, provider=provider, min_user_bytes=min_user_bytes, turns_per_file=turns_per_file
        )
    )
    mine = F.col("project_id") == "memory-" + provider
    known = store.chunk_vectors().where(mine)
    fresh = build_chunk_vectors(files, known, factory=factory)
    return store.replace(None, fresh, removed=missing_from(store.file_state().where(mine)))


def start_memory_sync(
    turns: DataFrame,
    store: IndexStore,
    sessions: Callable[[DataFrame], DataFrame],
    exported_at: Column,
    checkpoint: str,
    *,
    source: str = "memory",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Sync memory from a stream of turns, every five minutes by default.

    A micro-batch brings only new turns, but a session is exported whole:
    ``sessions(conv_ids)`` returns all turns so far of the touched sessions.
    """

    def sync(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= store.applied(source):
            return
        touched = batch.select("conv_id").distinct()
        sync_sessions(
            store, sessions(touched), exported_at, source=source, source_batch=batch_id, **options
        )

    return (
        turns.writeStream.foreachBatch(sync)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": SYNC_INTERVAL}))
        .start()
    )
