"""The index tables on shared storage.

Every change is appended: its rows go to a folder of their own
(``chunks/write=<id>``, ``file_state/write=<id>``) and become visible when a
commit file with the next number names that folder.  A commit file is written under
another name and renamed, which fails where the number is taken, so of two writers the
later one takes the number after.  (On object stores a rename is a copy and no such
guarantee: there only one process may write.)  A file without content, left by a
writer that died, names nothing and its number is stepped over.  A row of
``chunks`` is live while no later commit wrote its path, so replacing or deleting
files costs as much as the change and not as much as the index.  ``compact``
rewrites the live rows as one base, from which plain scans need no join, and
``vacuum`` deletes what no reader of the present state needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.index import symbol_table
from textquarry.operators.knn import DimensionMismatch
from textquarry.plans.joins import fits_broadcast

CHUNK_SCHEMA = (
    "chunk_id string, project_id string, path string, file_hash string, language string, "
    "symbol string, signature string, content string, start_line int, end_line int, "
    "embedding array<float>, batch bigint"
)
STATE_SCHEMA = (
    "path string, project_id string, file_hash string, indexed_at timestamp, deleted boolean, "
    "chunks bigint, symbols bigint"
)
COMMIT_SCHEMA = (
    "batch bigint, base bigint, dim int, source string, source_batch bigint, write string"
)


class CommitConflict(RuntimeError):
    """Another writer took the commit number, or changed what was to be compacted."""


def check_dimension(vector: Column, dim: int) -> Column:
    """The vector itself, or a failing job if its length is not ``dim``."""
    message = F.concat(
        F.lit(f"embedding has wrong dimension, expected {dim}, got "),
        F.coalesce(F.size(vector), F.lit(0)).cast("string"),
    )
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(message))


class IndexStore:
    """Chunks with vectors, symbols and file state below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    # --- reading ---

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.folder}/commits")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT_SCHEMA)

    def _span(self) -> list[Row]:
        """Commits from the base of the present state on: as many as since it was compacted."""
        commits = self._commits()
        base = commits.agg(F.max("base")).first()[0]
        live = commits.where((F.col("batch") >= base) & F.col("write").isNotNull())
        return live.orderBy("batch").collect() if base else []

    def _table(self, name: str, schema: str, span: list[Row]) -> DataFrame:
        """Rows of the writes of a span, with the number of their commit as ``batch``."""
        if not span:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
        paths = [f"{self.folder}/{name}/write={c['write']}" for c in span]
        rows = self.spark.read.schema(schema).parquet(*paths)
        if len(span) == 1:
            return rows.withColumn("batch", F.lit(span[0]["batch"]).cast("bigint"))
        numbers = F.create_map(*[F.lit(x) for c in span for x in (c["write"], c["batch"])])
        write = F.regexp_extract(F.col("_metadata.file_path"), "/write=([0-9a-f]+)/", 1)
        return rows.withColumn("batch", numbers[write])

    def _chunks(self, span: list[Row]) -> DataFrame:
        return self._table("chunks", CHUNK_SCHEMA.removesuffix(", batch bigint"), span)

    def _latest(self, span: list[Row]) -> DataFrame:
        """The last state row of every path in a span."""
        row = F.max_by(
            F.struct("project_id", "file_hash", "indexed_at", "deleted", "chunks", "symbols", "batch"), "batch"
        )
        states = self._table("file_state", STATE_SCHEMA, span)
        return states.groupBy("path").agg(row.alias("s")).select("path", "s.*")

    def file_state(self) -> DataFrame:
        """Indexed files: ``path, project_id, file_hash, indexed_at``."""
        return self._states(self._span()).drop("chunks", "symbols")

    def statistics(self) -> DataFrame:
        """Files, chunks, symbols and last index time per project, as kept with the file states.

        Every write counts its own chunks per file, so no chunk is read here.
        """
        return self._states(self._span()).groupBy("project_id").agg(
            F.count("*").alias("files"),
            F.sum("chunks").alias("chunks"),
            F.sum("symbols").alias("symbols"),
            F.max("indexed_at").alias("last_indexed_at"),
        )

    def _states(self, span: list[Row]) -> DataFrame:
        live = self._table("file_state", STATE_SCHEMA, span) if len(span) < 2 else self._latest(span)
        return live.where(~F.col("deleted")).select(
            "path", "project_id", "file_hash", "indexed_at", "chunks", "symbols"
        )

    def chunk_vectors(self) -> DataFrame:
        """Live chunks with their vectors.

        What later commits have overtaken is as small as the changes since the
        base; measured to be small it goes to the chunk scan, and no chunk is
        shuffled.
        """
        return self._live_chunks(self._span())

    def _live_chunks(self, span: list[Row]) -> DataFrame:
        chunks = self._chunks(span)
        columns = [c for c in chunks.columns if c != "batch"]
        if len(span) < 2:
            return chunks.select(*columns)
        later = self._table("file_state", STATE_SCHEMA, span[1:])
        overtaken = later.groupBy(F.col("path").alias("_path")).agg(F.max("batch").alias("_last"))
        if fits_broadcast(overtaken):
            overtaken = F.broadcast(overtaken)
        dead = (F.col("path") == F.col("_path")) & (F.col("batch") < F.col("_last"))
        return chunks.join(overtaken, dead, "left_anti").select(*columns)

    def symbols(self) -> DataFrame:
        return symbol_table(self.chunk_vectors())

    def applied(self, source: str) -> int:
        """Last batch of a streaming source that was committed; -1 for none."""
        done = self._commits().where(F.col("source") == source)
        value = done.agg(F.max("source_batch")).first()[0]
        return -1 if value is None else value

    # --- writing ---

    def replace(
        self,
        file_state: DataFrame | None,
        chunk_vectors: DataFrame,
        removed: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
        *,
        source: str = "",
        source_batch: int = -1,
        indexed_at=None,
    ) -> int:
        """Make the given files and chunks the only rows of their paths.

        Without ``file_state`` the files are those of the chunks, read once: every file
        has a chunk.  ``removed`` holds further paths to drop, or works them out from the
        paths that were written.  A write that fails before its commit stays invisible.
        Returns the number of the commit.
        """
        now = (F.current_timestamp() if indexed_at is None else indexed_at).cast("timestamp")
        span = self._span()
        write = uuid.uuid4().hex
        dim = self._write_chunks(chunk_vectors, write, span[-1]["dim"] if span else None)
        written = self._written(write)
        files = written if file_state is None else file_state.select("path", "project_id", "file_hash").join(
            written.select("path", "chunks", "symbols"), "path", "left"
        )
        counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("chunks", "symbols")]
        shape = ["path", "project_id", "file_hash", now.alias("indexed_at")]
        states = files.select(*shape, F.lit(False).alias("deleted"), *counts)
        if callable(removed):
            removed = removed(written.select("path"))
        if removed is not None:
            empty = {"project_id": F.lit(""), "file_hash": F.lit(""), "chunks": F.lit(0), "symbols": F.lit(0)}
            gone = removed.select("path").distinct().withColumns(empty)
            states = states.unionByName(gone.select(*shape, F.lit(True).alias("deleted"), *counts))
        self._write("file_state", states, write)
        while True:
            known = span[-1]["dim"] if span else None
            if dim is not None and known is not None and dim != known:
                raise DimensionMismatch(f"vectors have dimension {dim}, the store has {known}")
            batch = span[-1]["batch"] + 1 if span else 1
            base = span[0]["batch"] if span else batch
            try:
                return self._commit(batch, base, known or dim, source, source_batch, write)
            except CommitConflict:  # another writer was first; its rows are independent of these
                span = self._span()
                if source and source_batch <= self.applied(source):
                    return -1

    def delete(self, paths: DataFrame) -> int:
        """Drop all rows of the given paths."""
        empty = self.spark.createDataFrame([], CHUNK_SCHEMA).drop("batch")
        return self.replace(self.file_state().limit(0), empty, removed=paths)

    def compact(self) -> int:
        """Rewrite the live rows as a new base.

        Raises :class:`CommitConflict` if another commit came meanwhile.
        """
        span = self._span()
        if not span:
            return 0
        write = uuid.uuid4().hex
        self._write_chunks(self._live_chunks(span), write, span[-1]["dim"])
        states = self._states(span).withColumn("deleted", F.lit(False))
        self._write("file_state", states, write)
        return self._commit(span[-1]["batch"] + 1, None, span[-1]["dim"], "", -1, write, self._sources())

    def _sources(self) -> list[dict]:
        """Last committed batch of every streaming source, which outlives the commits it came with."""
        done = self._commits().where("source <> ''").groupBy("source").agg(F.max("source_batch").alias("source_batch"))
        return [row.asDict() for row in done.collect()]

    def vacuum(self) -> int:
        """Delete the folders of writes from before the base or never committed, and old commits.

        Returns how many folders.  Not while readers of an older state or unfinished
        writes are about.
        """
        span = self._span()
        live = {f"write={c['write']}" for c in span}
        old = [n for n in self.names("commits") if span and n[:12].isdigit() and int(n[:12]) < span[0]["batch"]]
        remove = lambda fs, p: fs.delete(p, True)
        gone = 0
        for name in ("chunks", "file_state"):
            for write in set(self.names(name)) - live:
                gone += self._files(f"{self.folder}/{name}/{write}", remove)
        for name in old:  # after the folders they name
            self._files(f"{self.folder}/commits/{name}", remove)
        return gone

    def names(self, folder: str) -> list[str]:
        def names(fs, path):
            return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

        return self._files(f"{self.folder}/{folder}", names)

    def _files(self, path: str, action):
        """Run ``action(file system, path)`` of Hadoop's file system on the driver."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return action(place.getFileSystem(context._jsc.hadoopConfiguration()), place)

    def _write(self, name: str, rows: DataFrame, write: str) -> None:
        rows.write.parquet(f"{self.folder}/{name}/write={write}")

    def _written(self, write: str) -> DataFrame:
        """The files of a write, from its chunks, and how many chunks and symbols each has."""
        schema = CHUNK_SCHEMA.removesuffix(", batch bigint")
        chunks = self.spark.read.schema(schema).parquet(f"{self.folder}/chunks/write={write}")
        return chunks.groupBy("path").agg(
            F.max("project_id").alias("project_id"), F.max("file_hash").alias("file_hash"),
            F.count("*").alias("chunks"), F.count_if(F.col("symbol") != "").alias("symbols"),
        )

    def _write_chunks(self, rows: DataFrame, write: str, dim: int | None) -> int | None:
        """Write chunks and return the dimension all vectors have.

        Once the dimension is known the write itself checks it; the first write
        is read back to learn it.  Every file is sorted by project, so a
        project filter skips row groups, and no shuffle is spent on the layout.
        """
        columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")][:-1]
        rows = rows.select(*columns)
        if dim is not None:
            rows = rows.withColumn("embedding", check_dimension(F.col("embedding"), dim))
        self._write("chunks", rows.sortWithinPartitions("project_id", "path"), write)
        if dim is not None:
            return dim
        lengths = F.coalesce(F.size("embedding"), F.lit(-1))
        schema = CHUNK_SCHEMA.removesuffix(", batch bigint")
        written = self.spark.read.schema(schema).parquet(f"{self.folder}/chunks/write={write}")
        low, high = written.agg(F.min(lengths), F.max(lengths)).first()
        if low is not None and (low != high or low <= 0):
            raise DimensionMismatch(f"vectors of one write have dimensions {low} to {high}")
        return low

    def _commit(
        self, batch: int, base: int | None, dim: int | None, source: str, source_batch: int, write: str,
        sources: list[dict] | None = None,
    ) -> int:
        """Make a write visible under a number, ``batch`` or, past empty files, a later one.

        Without ``base`` the commit is the base itself.  Fails if the number is taken.
        """
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE

        def create(fs, folder):
            path = lambda name: jvm.org.apache.hadoop.fs.Path(folder, name)
            number = batch
            while fs.exists(path(f"{number:012d}.json")):
                if fs.getFileStatus(path(f"{number:012d}.json")).getLen():
                    raise CommitConflict(f"commit {number} exists")
                number += 1
            row = {"batch": number, "base": base or number, "dim": dim}
            rows = [row | {"source": source, "source_batch": source_batch, "write": write}]
            rows += [row | kept for kept in sources or []]
            draft, final = path(f".{uuid.uuid4().hex}"), path(f"{number:012d}.json")
            out = fs.create(draft, False)
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
            out.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
            try:
                context.rename(draft, final, how)
            except Exception as err:
                fs.delete(draft, False)
                if fs.exists(final):
                    raise CommitConflict(f"commit {number} exists") from err
                raise
            return number

        return self._files(f"{self.folder}/commits", create)
