"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

``LineIndex`` keeps three tables below one folder, each change a new version:

- ``postings``: (h1, h2, doc, op), the exact record of which document holds
  which line key, appended with op +1 on insertion and -1 on deletion;
- ``counts``: (shard, h1, h2, n_docs, keeper), the exact reference counts and
  the largest document that holds the key;
- ``filters``: per shard a cuckoo filter of the keys in at least ``min_docs``
  documents.  A key that crosses the bound is inserted into or deleted from its
  shard's filter; a filter that is full is built anew from the counts.

Cleaning asks the filters first.  Only lines that they may know, few in an
ordinary corpus, meet the exact counts, so false positives cost a lookup and
never a line.  Filters measured to be small travel to the tasks; larger ones
meet the line keys shard by shard, a shard's keys dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.llm.cuckoo import CuckooFilter
from textquarry.session import scratch_path

MIN_CHARS = 40
MIN_DOCS = 5
SHARDS = 64
SHARD_KEYS = 200_000
BROADCAST_BYTES = 32 << 20
PROBE_ROWS = 200_000

KEY = ["h1", "h2"]
DONE = "version long, shards int, min_chars int, min_docs int"


def _postings(min_chars: int, known=None, shards: int = 1):
    """Distinct keys of every text; with filters that were sent, those they may know.

    One Python step does both, so a task needs one worker process.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        filters = None
        for batch in kernels.cuts(batches):
            blobs = kernels.blobs_of(batch.column(1))
            ids = batch.column(0)
            for begin, part in kernels.slices(blobs):
                keys = kernels.LineKeys(kernels.Texts(part))
                owner = np.repeat(np.arange(len(part)), np.diff(keys.first))
                able = keys.chars >= min_chars
                owner, h1, h2 = owner[able], keys.h1[able], keys.h2[able]
                order = np.lexsort((h2, h1, owner))
                owner, h1, h2 = owner[order], h1[order], h2[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (np.diff(owner) != 0) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                if known is not None:
                    if filters is None:
                        filters = {k: CuckooFilter.from_bytes(b) for k, b in known.value.items()}
                    new[new] = _may_know(filters, shards, h1[new], h2[new])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[new].view(np.int64)),
                        pa.array(h2[new].view(np.int64)),
                        ids.take(pa.array(owner[new] + begin)),
                    ],
                    names=["h1", "h2", "doc"],
                )

    return run


def _rewrite(text_at: int, drops_at: int, names: list[str], extra: list[str]):
    """Texts without the lines whose keys are listed beside them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches):
            blobs = kernels.blobs_of(batch.column(text_at))
            drops = batch.column(drops_at)
            listed = drops.is_valid().to_pylist()
            out: list[bytes] = list(blobs)
            lines = np.array([b.count(b"\n") + 1 for b in blobs], dtype=np.int64)
            gone = np.zeros(len(blobs), dtype=np.int64)
            for i in np.flatnonzero(listed):
                keys = kernels.LineKeys(kernels.Texts([blobs[i]]))
                bad = {(d["h1"], d["h2"]) for d in drops[int(i)].as_py()}
                h1, h2 = keys.h1.view(np.int64).tolist(), keys.h2.view(np.int64).tolist()
                stay = [
                    line
                    for line, a, b in zip(blobs[i].split(b"\n"), h1, h2, strict=True)
                    if (a, b) not in bad
                ]
                gone[i] = lines[i] - len(stay)
                out[i] = b"\n".join(stay)
            columns = [c for k, c in enumerate(batch.columns) if k != drops_at]
            columns[text_at] = pa.array(out, pa.binary()).cast(pa.string())
            columns = dict(zip(names, columns, strict=True))
            columns[extra[0]], columns[extra[1]] = pa.array(lines), pa.array(gone)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


class LineIndex:
    """Line keys of a corpus that grows and shrinks, below ``folder``.

    Opened on a folder with an index, it goes on from the last complete version;
    what a writer left that died before is overwritten.  One process may write at a
    time: a change on a version that is no longer the last one fails.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str | None = None,
        *,
        min_chars: int = MIN_CHARS,
        min_docs: int = MIN_DOCS,
        shards: int | None = None,
    ):
        self.spark = spark
        self.folder = (folder or scratch_path(spark, "lines")).rstrip("/")
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards
        self.version = 0
        done = self._done()
        if done is not None:  # an index that is there goes on with its own settings
            self.version, self.shards, self.min_chars, self.min_docs = done

    # -- state

    def _done(self) -> tuple | None:
        """Last complete version below the folder and its settings."""
        try:
            done = self.spark.read.schema(DONE).json(f"{self.folder}/done")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = done.orderBy(F.desc("version")).first()
        return row and tuple(row)

    def _finish(self) -> None:
        """Mark the version as complete, after all its tables are written."""
        row = [(self.version, self.shards, self.min_chars, self.min_docs)]
        self.spark.createDataFrame(row, DONE).coalesce(1).write.mode("append").json(f"{self.folder}/done")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}/v{self.version}")

    def counts(self) -> DataFrame:
        """(shard, h1, h2, n_docs, keeper) of all keys that a document holds."""
        shard = F.pmod(F.col("h1"), F.lit(self.shards)).cast("int").alias("shard")
        return self._read("counts").select(shard, *KEY, "n_docs", "keeper")

    def filters(self) -> DataFrame:
        """(shard, filter) of all shards that have keys in ``min_docs`` documents."""
        return self._read("filters")

    def _logged(self) -> DataFrame:
        paths = [f"{self.folder}/postings/v{v}" for v in range(1, self.version + 1)]
        return self.spark.read.parquet(*paths)

    def postings(self) -> DataFrame:
        """(h1, h2, doc) of the documents that are in."""
        if self.version == 1:
            return self._logged().select(*KEY, "doc")
        live = self._logged().groupBy(*KEY, "doc").agg(F.sum("op").alias("op"))
        return live.where("op > 0").select(*KEY, "doc")

    def _keys(self, docs: DataFrame, id_col: str, text_col: str, known=None) -> DataFrame:
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
        return rows.where("doc is not null").mapInArrow(
            _postings(self.min_chars, known, self.shards), "h1 long, h2 long, doc long"
        )

    # -- changes

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents.  What an id already holds is not counted again."""
        keys = self._keys(docs, id_col, text_col).distinct()
        if self.version:
            keys = keys.join(self.postings(), [*KEY, "doc"], "left_anti")
        self._commit(keys.withColumn("op", F.lit(1)))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out again; unknown ids change nothing."""
        gone = ids.select(F.col(f"`{id_col}`").cast("long").alias("doc")).distinct()
        keys = self.postings().join(gone, "doc", "left_semi").select(*KEY, "doc")
        self._commit(keys.withColumn("op", F.lit(-1)))

    def _commit(self, change: DataFrame) -> None:
        """Write the postings of a change, then counts and filters that include it."""
        done = self._done()
        if done is not None and done[0] != self.version:
            raise RuntimeError(f"version {done[0]} was written meanwhile; open the index again")
        new = self.version + 1
        path = f"{self.folder}/postings/v{new}"
        change.select(*KEY, "doc", "op").write.mode("overwrite").parquet(path)
        change = self.spark.read.parquet(path)
        delta = change.groupBy(*KEY).agg(
            F.sum("op").cast("long").alias("n_docs"), F.max(F.when(F.col("op") > 0, F.col("doc"))).alias("keeper")
        )
        old = self.counts() if self.version else None
        if old is None:
            counts = delta.select(*KEY, "n_docs", "keeper")
        else:
            sums = old.select(*KEY, "n_docs", "keeper").union(delta).groupBy(*KEY)
            counts = sums.agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
            counts = counts.where("n_docs > 0")
        self.version = new
        if old is not None:
            # A deletion may have taken a key's keeper: those keys ask the postings.
            touched = change.where("op < 0").select(*KEY).distinct()
            keepers = (
                self.postings().join(touched, KEY, "left_semi").groupBy(*KEY)
                .agg(F.max("doc").alias("exact"))
            )
            counts = counts.join(keepers, KEY, "left").select(
                *KEY, "n_docs", F.coalesce("exact", "keeper").alias("keeper")
            )
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts/v{new}")
        self._update_filters(old)
        self._finish()

    def _update_filters(self, old: DataFrame | None) -> None:
        if self.shards is None:  # as many as the first documents ask for, from then on the same
            frequent = self._read("counts").where(F.col("n_docs") >= self.min_docs).count()
            self.shards = max(SHARDS, -(-frequent // SHARD_KEYS))
        many = self.counts().where(F.col("n_docs") >= self.min_docs).select("shard", *KEY)
        path = f"{self.folder}/filters/v{self.version}"
        shape = "shard int, filter binary"
        if old is None:
            made = many.groupBy("shard").applyInArrow(_build, shape)
        else:
            before = old.where(F.col("n_docs") >= self.min_docs).select("shard", *KEY)
            up = many.join(before, KEY, "left_anti").withColumn("sign", F.lit(1))
            down = before.join(many, KEY, "left_anti").withColumn("sign", F.lit(-1))
            columns = ["shard", *KEY, "sign"]
            moves = up.select(columns).union(down.select(columns))
            filters = self.spark.read.parquet(f"{self.folder}/filters/v{self.version - 1}")
            changed = filters.groupBy("shard").cogroup(moves.groupBy("shard"))
            made = changed.applyInArrow(_change, "shard int, filter binary")
            # A shard whose filter ran full comes back empty and is built from the counts.
            made.write.mode("overwrite").parquet(path + "-changed")
            made = self.spark.read.parquet(path + "-changed")
            full = made.where("filter is null").select("shard")
            anew = many.join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_build, shape)
            made = made.where("filter is not null").union(anew)
        made.write.mode("overwrite").parquet(path)

    # -- use

    def clean(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
    ) -> DataFrame:
        """``docs`` without the lines that another document keeps.

        A line whose key has at least ``min_chars`` code points and is held by
        at least ``min_docs`` documents of the index stays only in the largest
        id that holds it (there in all its places).  All other lines stay,
        joined by \\n.  All columns come back, the text cleaned, with
        n_lines (before) and n_dropped added; columns of these names in ``docs``
        are replaced.

        A null text counts as empty: one empty line, returned as an empty text.
        Rows with a null id lose no line.  Rows that share an id are one
        document.  Lines and texts of any length count whole; an empty table gives
        no rows.
        """
        drops = self._drops(docs, id_col, text_col)
        held = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        spare = next(
            p for k in range(len(held) + 1) if not any(c.startswith(p := f"_drops{k}_") for c in held)
        )
        per_doc = drops.groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias(spare))
        base = docs.select(*[F.col(f"`{c}`") for c in held])
        joined = base.join(
            per_doc.select(F.col("doc").alias(f"{spare}id"), spare),
            F.col(f"`{id_col}`").cast("long") == F.col(f"{spare}id"),
            "left",
        ).drop(f"{spare}id")
        schema = base.schema.add("n_lines", "long").add("n_dropped", "long")
        run = _rewrite(held.index(text_col), len(held), held, ["n_lines", "n_dropped"])
        return joined.mapInArrow(run, schema)

    def _drops(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc, h1, h2) of the keys that a document loses."""
        filters = self.filters()
        size = filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        if size <= BROADCAST_BYTES:
            sent = self.spark.sparkContext.broadcast(
                {r["shard"]: bytes(r["filter"]) for r in filters.collect()}
            )
            maybe = self._keys(docs, id_col, text_col, sent)
        else:
            maybe = self._probe_by_shard(self._keys(docs, id_col, text_col))
        exact = self.counts().where(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper")
        return maybe.join(exact, KEY).where("doc <> keeper").select("doc", *KEY)

    def _probe_by_shard(self, keys: DataFrame) -> DataFrame:
        keys = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(self.shards)).cast("int"))
        held = self.counts().agg(F.sum("n_docs")).first()[0] or 0
        salts = max(1, held // (self.shards * PROBE_ROWS))
        keys = keys.withColumn("salt", F.pmod(F.xxhash64("doc", "h2"), F.lit(salts)).cast("int"))
        spread = self.filters().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int"))))
        return (
            keys.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt"))
            .applyInArrow(_probe_shard, "h1 long, h2 long, doc long")
        )


def _longs(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _filter_table(shard: int, blob: bytes | None):
    import pyarrow as pa

    return pa.table(
        {"shard": pa.array([shard], pa.int32()), "filter": pa.array([blob], pa.binary())}
    )


def _build(key, table):
    made = CuckooFilter.of(_longs(table, "h1"), _longs(table, "h2"))
    return _filter_table(key[0].as_py(), made.to_bytes())


def _change(key, filters, moves):
    sign = _longs(moves, "sign")
    h1, h2 = _longs(moves, "h1"), _longs(moves, "h2")
    if filters.num_rows:
        made = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
    else:
        made = CuckooFilter.sized(int((sign > 0).sum()))
    made.remove_all(h1[sign < 0], h2[sign < 0])
    fits = made.add_all(h1[sign > 0], h2[sign > 0])
    return _filter_table(key[0].as_py(), made.to_bytes() if fits else None)


def _may_know(filters: dict, shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys the filters of their shards may know."""
    shard = np.mod(h1.view(np.int64), shards)
    hit = np.zeros(len(h1), dtype=bool)
    for k in np.unique(shard):
        if k in filters:
            at = np.flatnonzero(shard == k)
            hit[at] = filters[k].contains(h1[at], h2[at])
    return hit


def _probe_shard(key, keys, filters):
    import pyarrow as pa

    found = keys.select(["h1", "h2", "doc"])
    if not filters.num_rows or not keys.num_rows:
        return found.slice(0, 0)
    known = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
    return found.filter(pa.array(known.contains(_longs(keys, "h1"), _longs(keys, "h2"))))


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Line dedup of one table: all its documents inserted in a new index, then cleaned."""
    index = LineIndex(docs.sparkSession, min_chars=min_chars, min_docs=min_docs)
    index.insert(docs, id_col, text_col)
    return index.clean(docs, id_col, text_col)
