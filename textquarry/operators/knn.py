"""Exact vector top-k by cosine similarity.

The chunks are never shuffled.  A batch of queries whose size was measured goes
to every task as one matrix; a task multiplies Arrow batches of vectors with it
and keeps its own best rows per query, and only those partial results are
merged.  A larger table of queries meets the chunks in a grid: both sides are
written, and every cell of a block of queries and a segment of chunk files is a task
that reads them there, all in one job.  Filters, the keyword bonus and "the best
chunk of each file" are applied before a task keeps its best rows, so none of them
can leave a query with fewer results than there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.plans.grid import grid_map
from textquarry.plans.joins import cut_lineage

# Queries go to every task, or to a cell of the grid, in blocks below both bounds.
MAX_QUERIES = 1024
MAX_QUERY_VALUES = 4_000_000
GRID_BATCH = 10_000
# Rows of a batch that are looked at first, and queries compared with a batch at once.
FIRST_ROWS = 512
SCREENED = 128

# Scores are ranked after rounding, so that equal texts tie on every engine and
# the tie is settled by chunk_id.
SCORE_DIGITS = 6

# Score bonus for a query found in the symbol, else in the path.
SYMBOL_BOOST, PATH_BOOST = 0.1, 0.05

TOPK_SCHEMA = "query_id string, chunk_id string, score double"
FILTERS = {"project_id": "project_id", "language": "language", "path_prefix": "path"}


class DimensionMismatch(ValueError):
    """Vectors of different length met in one search or one store."""


def _unit_rows(flat: np.ndarray, rows: int, dim: int) -> np.ndarray:
    matrix = flat.astype(np.float64).reshape(rows, dim)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, keep: int, paths: np.ndarray | None) -> np.ndarray:
    """Positions of the ``keep`` best rows by (score desc, id asc), one a path if given."""
    pool = np.arange(len(scores))
    if paths is None and len(scores) > keep:
        floor = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        pool = np.flatnonzero(scores >= floor)
    order = pool[np.lexsort((ids[pool], -scores[pool]))]
    if paths is None:
        return order[:keep]
    seen: set = set()
    chosen = []
    for row in order:
        if len(chosen) == keep:
            break
        if paths[row] not in seen:
            seen.add(paths[row])
            chosen.append(row)
    return np.array(chosen, dtype=np.int64)


class _Bonus:
    """Keyword bonus of the rows of a batch: a literal hit in the symbol, else in the path."""

    def __init__(self, batch: pa.RecordBatch):
        self.symbol = pc.utf8_lower(batch.column("symbol"))
        self.path = pc.utf8_lower(batch.column("path"))

    def add(self, scores: np.ndarray, rows: np.ndarray, needle: str | None) -> np.ndarray:
        if needle is None:
            return scores
        at = pa.array(rows)
        hits = [
            pc.match_substring(column.take(at), needle).fill_null(False).to_numpy(zero_copy_only=False)
            for column in (self.symbol, self.path)
        ]
        bonus = np.where(hits[0], SYMBOL_BOOST, np.where(hits[1], PATH_BOOST, 0.0))
        return np.round(scores + bonus, SCORE_DIGITS) + 0.0


def _mask(batch: pa.RecordBatch, filters: tuple) -> np.ndarray:
    """Rows of a batch that satisfy every (filter, value) pair."""
    mask = np.ones(batch.num_rows, dtype=bool)
    for name, value in filters:
        column = batch.column(FILTERS[name])
        test = pc.equal(column, value)
        if name == "path_prefix":
            below = value if value.endswith("/") else value + "/"
            test = pc.or_(test, pc.starts_with(column, below))
        mask &= test.fill_null(False).to_numpy(zero_copy_only=False)
    return mask


def _spread_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in two: few rows first, whose best scores keep most others out."""
    yield batch.slice(0, FIRST_ROWS)
    if batch.num_rows > FIRST_ROWS:
        yield batch.slice(FIRST_ROWS)


def _partial_topk(queries: list, keep: int, boost: bool = False, per_path: bool = False):
    """Kernel for ``mapInArrow``: best ``keep`` rows per query of one partition.

    Queries of one vector share its products.  Products in single precision, less
    what their rounding can take away, find the few rows that can still be among the
    best of a query; only those are scored, in double precision.
    """
    dim = len(queries[0]["embedding"])
    places: dict[tuple, int] = {}
    vector_of = np.array([places.setdefault(tuple(q["embedding"]), len(places)) for q in queries])
    matrix = _unit_rows(np.array(list(places), dtype=np.float64).ravel(), len(places), dim)
    rough_matrix = matrix.astype(np.float32)
    query_ids = [q["query_id"] for q in queries]
    asked = [name for name in FILTERS if any(q[name] for q in queries)]
    filters = [tuple((name, q[name]) for name in asked if q[name]) for q in queries]
    needles = [(q["text"] or "").lower() if boost and q["text"] is not None else None for q in queries]
    reach = SYMBOL_BOOST if boost else 0.0
    # Rounding of products, each of at most 1 in all, and of scores to their digits.
    margin = reach + 10.0**-SCORE_DIGITS + (dim + 8) * 2.0**-23
    groups: dict[tuple, list] = {}
    for i, chosen in enumerate(filters):
        groups.setdefault(chosen, []).append(i)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_scores = [np.empty(0) for _ in queries]
        best_ids = [np.empty(0, dtype=object) for _ in queries]
        best_paths = [np.empty(0, dtype=object) for _ in queries]
        floors = np.full(len(queries), -np.inf)
        for batch in (part for whole in batches for part in _spread_rows(whole)):
            if batch.num_rows == 0:
                continue
            vectors = batch.column("embedding")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            if vectors.null_count or (lengths != dim).any():
                raise DimensionMismatch(f"stored vectors do not all have dimension {dim}")
            unit = _unit_rows(
                vectors.flatten().to_numpy(zero_copy_only=False), batch.num_rows, dim
            )
            rough = rough_matrix @ unit.astype(np.float32).T
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            paths = batch.column("path").to_numpy(zero_copy_only=False) if per_path else None
            bonus = _Bonus(batch) if boost else None
            for chosen, members in groups.items():
                inside = np.flatnonzero(_mask(batch, chosen)) if chosen else None
                if inside is not None and not len(inside):
                    continue
                for at in range(0, len(members), SCREENED):
                    some = np.array(members[at : at + SCREENED])
                    seen = rough[vector_of[some]]
                    if inside is not None:
                        seen = seen[:, inside]
                    # Not below, so that what is no number is left to the exact scores.
                    hits = ~(seen < (floors[some] - margin).astype(np.float32)[:, None])
                    for n in np.flatnonzero(hits.any(axis=1)):
                        i, rows = some[n], np.flatnonzero(hits[n])
                        rows = rows if inside is None else inside[rows]
                        found = np.round(unit[rows] @ matrix[vector_of[i]], SCORE_DIGITS) + 0.0
                        if len(best_scores[i]) == keep:  # what no bonus can bring up is out
                            able = found >= best_scores[i][-1] - reach
                            rows, found = rows[able], found[able]
                        if not len(rows):
                            continue
                        if bonus is not None:
                            found = bonus.add(found, rows, needles[i])
                        merged_scores = np.concatenate([best_scores[i], found])
                        merged_ids = np.concatenate([best_ids[i], ids[rows]])
                        merged_paths = np.concatenate([best_paths[i], paths[rows]]) if per_path else None
                        order = _best(merged_scores, merged_ids, keep, merged_paths)
                        best_scores[i], best_ids[i] = merged_scores[order], merged_ids[order]
                        if per_path:
                            best_paths[i] = merged_paths[order]
                        if len(order) == keep:
                            floors[i] = best_scores[i][-1]
        counts = [len(s) for s in best_scores]
        if not sum(counts):
            return
        columns = {
            "query_id": pa.array(np.repeat(np.array(query_ids, dtype=object), counts), pa.string()),
            "chunk_id": pa.array(np.concatenate(best_ids), pa.string()),
            "score": pa.array(np.concatenate(best_scores), pa.float64()),
        }
        if per_path:
            columns["path"] = pa.array(np.concatenate(best_paths), pa.string())
        yield pa.RecordBatch.from_pydict(columns)

    return run


def _one_dimension(dims: set, nulls: bool) -> int:
    if len(dims) > 1 or nulls:
        raise DimensionMismatch("query vectors do not all have one dimension")
    return max(dims, default=0)


def _few(queries: DataFrame) -> list | None:
    """All queries, if they are measured to be few enough for every task."""
    head = queries.limit(MAX_QUERIES + 1).collect()
    dim = _one_dimension(
        {len(q["embedding"]) for q in head if q["embedding"] is not None},
        any(q["embedding"] is None for q in head),
    )
    few = len(head) <= 1 or (len(head) <= MAX_QUERIES and len(head) * dim <= MAX_QUERY_VALUES)
    return head if few else None


def _grid_topk(
    chunk_vectors: DataFrame, queries: DataFrame, keep: int, columns: list[str], schema: str, **how: bool
) -> tuple[DataFrame, int]:
    """Partial results of many queries, and how many rows the best of them can be."""
    queries = cut_lineage(queries, "queries")
    size = F.size("embedding")
    low, high, nulls, count = queries.agg(
        F.min(size), F.max(size), F.count_if(F.col("embedding").isNull()), F.count("*")
    ).first()
    dim = _one_dimension({low, high}, nulls > 0)
    stored = cut_lineage(chunk_vectors.select(*columns), "vectors")

    def cell(block: pa.Table, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _partial_topk(block.to_pylist(), keep, **how)(batches)

    rows = max(1, min(MAX_QUERIES, MAX_QUERY_VALUES // max(1, dim)))
    return grid_map(queries, stored, cell, schema, block_rows=rows, batch_rows=GRID_BATCH), count * keep


def vector_topk(
    chunk_vectors: DataFrame,
    queries: DataFrame,
    keep: int,
    *,
    boost: bool = False,
    per_path: bool = False,
) -> tuple[DataFrame, int]:
    """The ``keep`` best chunks of every query, and how many rows that can be.

    ``queries`` has ``query_id, embedding`` and, as optional filters (``''`` or
    null: any), ``project_id``, ``language`` and ``path_prefix``.  ``boost`` adds
    the keyword bonus of the query's ``text`` to the scores; ``per_path`` counts
    only the best chunk of every path, which then is a column of the result.
    Queries are read when the plan is built.  Ranked by score rounded to six
    places, then by ``chunk_id``; scores are of type DOUBLE.
    """
    spark = chunk_vectors.sparkSession
    present = set(queries.columns)
    shaped = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        "embedding",
        (F.col("text") if boost else F.lit(None)).cast("string").alias("text"),
        *[
            (F.col(c) if c in present else F.lit("")).cast("string").alias(c)
            for c in FILTERS
        ],
    )
    schema = TOPK_SCHEMA + (", path string" if per_path else "")

    def part(batch: list) -> DataFrame:
        source = chunk_vectors
        columns = ["chunk_id", "embedding"]
        if boost:
            columns += ["symbol", "path"]
        elif per_path:
            columns.append("path")
        for name, column in FILTERS.items():
            values = {q[name] or "" for q in batch}
            if values == {""}:
                continue
            columns.append(column)
            # Every query names a value: let the scan skip the other row groups.
            if name != "path_prefix" and "" not in values and len(values) <= 256:
                source = source.where(F.col(column).isin(sorted(values)))
        rows = [q.asDict() for q in batch]
        kernel = _partial_topk(rows, keep, boost, per_path)
        return source.select(*dict.fromkeys(columns)).mapInArrow(kernel, schema)

    few = _few(shaped)
    if few == []:
        return spark.createDataFrame([], schema + ", rank int"), 0
    if few is not None:
        merged, total = part(few), len(few) * keep
    else:
        asked = {c for c in FILTERS if c in present}
        columns = ["chunk_id", "embedding", *(["symbol", "path"] if boost else ["path"] if per_path else [])]
        columns += [column for name, column in FILTERS.items() if name in asked]
        merged, total = _grid_topk(
            chunk_vectors, shaped, keep, list(dict.fromkeys(columns)), schema, boost=boost, per_path=per_path
        )
    if per_path:
        of_path = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "chunk_id")
        merged = merged.withColumn("n", F.row_number().over(of_path)).where("n = 1").drop("n")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = (
        merged.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= keep)
    )
    return top, total
