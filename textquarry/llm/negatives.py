"""Hard negatives of anchors by exact inner products, several candidates a product.

Kronecker packing.  Components of candidates and anchors are biased to be
non-negative.  The components of several candidates then stand in separated fields of
one wide integer; one product with an anchor's component multiplies all of them, and
since no field can overflow into the next, the sum over the components unpacks to the
exact score of each candidate.  Field widths follow from the measured largest
components.  Wide integers of up to 53 bits are held in doubles, which carry them
exactly, so that a matrix product does the multiplications; beyond that they are
Python's integers.

Anchors meet all rows in a grid of blocks and file segments, twice: for the positives,
and then, with the window of scores each positive allows, for its negatives.  A cell
keeps the best rows of each request; what a request cannot use any more is dropped by
one comparison of its scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.plans.grid import grid_map
from textquarry.plans.joins import cut_lineage

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
SCALE = 256
DOUBLE_BITS = 53
WIDE_FIELDS = 8
REQUESTS = 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """Anchors ready to be multiplied with packed candidates.

    ``vectors`` is a matrix of integers, a row an anchor.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.bias = max(0, -int(vectors.min(initial=0)))
        self.most = int(vectors.max(initial=0)) + self.bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """(rows, anchors) exact inner products; beyond 64 bits they stop at its ends."""
        count, dim = rows.shape
        if not count or not dim:
            return np.zeros((count, len(self.vectors)), dtype=np.int64)
        bias = max(0, -int(rows.min(initial=0)))
        most = int(rows.max(initial=0)) + bias
        width = max(1, (dim * most * self.most).bit_length())
        fields = DOUBLE_BITS // width
        kind, whole = (np.float64, np.int64) if fields else (object, object)
        fields = fields or WIDE_FIELDS
        words = -(-count // fields)
        padded = np.zeros((fields * words, dim), dtype=whole)
        padded[:count] = rows
        padded[:count] += bias
        wide = np.zeros((words, dim), dtype=whole)
        for f in range(fields):
            wide |= padded[f * words : (f + 1) * words] << (width * f)
        factors = (self.vectors.astype(whole) + self.bias).T
        product = (wide.astype(kind) @ factors.astype(kind)).astype(whole)
        mask = (1 << width) - 1
        sums = np.concatenate([(product >> (width * f)) & mask for f in range(fields)])[:count]
        # (c + bias)(a + self.bias) summed, less what the biases brought in.
        sums -= self.bias * padded[:count].sum(axis=1, dtype=whole)[:, None]
        sums -= bias * self.vectors.astype(whole).sum(axis=1, dtype=whole)[None, :]
        return sums if whole is np.int64 else np.clip(sums, LEAST, MOST).astype(np.int64)


def _integers(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of an Arrow column of integer lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def best_rows(ask: np.ndarray, score: np.ndarray, row: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best rows of each request: score down, id up."""
    order = np.lexsort((row, -score, ask))
    first = np.searchsorted(ask[order], ask[order], "left")
    return order[np.arange(len(order)) - first < keep]


class _Requests:
    """The requests of a block whose vectors have one length, and their best rows."""

    def __init__(self, block, dim: int, flat: np.ndarray, begin: np.ndarray, rows: np.ndarray):
        number = lambda name: block.column(name).to_numpy()[rows]
        self.dim, self.rows = dim, rows
        self.anchor, self.label = number("anchor_id"), number("anchor_label")
        self.low, self.high = number("low").copy(), number("high")
        _, first, self.which = np.unique(self.anchor, return_index=True, return_inverse=True)
        at = begin[rows[first]][:, None] + np.arange(dim)[None, :]
        self.packed = Packed(flat[at] if dim else np.zeros((len(first), 0), dtype=np.int64))
        none = np.empty(0, dtype=np.int64)
        self.ask, self.score, self.row = none, none, none

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, keep: int) -> None:
        scores = self.packed.scores(vectors)
        for a in range(0, len(self.rows), REQUESTS):
            part = slice(a, a + REQUESTS)
            found = scores[:, self.which[part]]
            hit = (found >= self.low[part]) & (found <= self.high[part])
            hit &= (labels[:, None] == self.label[part]) == same
            hit &= ids[:, None] != self.anchor[part]
            at, ask = np.nonzero(hit)
            if not len(at):
                continue
            everything = [
                np.concatenate(x)
                for x in ((self.ask, ask + a), (self.score, found[at, ask]), (self.row, ids[at]))
            ]
            best = best_rows(*everything, keep)
            self.ask, self.score, self.row = (x[best] for x in everything)
            # A request with all its rows only takes others as good as its last.
            count = np.bincount(self.ask, minlength=len(self.rows))
            last = np.searchsorted(self.ask, np.arange(len(self.rows)), "right") - 1
            full = count == keep
            self.low[full] = np.maximum(self.low[full], self.score[last[full]])


def _ranked(same: bool, keep: int, carried: list[str]):
    """Kernel of a cell: the ``keep`` best rows of each request with (or without) its label."""

    def run(block, batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = block.combine_chunks()
        flat, lengths = _integers(block.column("v").combine_chunks())
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        groups = [
            _Requests(block, int(d), flat, begin, np.flatnonzero(lengths == d)) for d in np.unique(lengths)
        ]
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            values, sizes = _integers(batch.column("v"))
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for group in groups:
                at = np.flatnonzero(sizes == group.dim)
                vectors = values[starts[at][:, None] + np.arange(group.dim)[None, :]]
                group.meet(ids[at], labels[at], vectors, same, keep)
        for group in groups:
            if len(group.ask):
                asked = block.select(carried).take(pa.array(group.rows[group.ask]))
                named = asked.append_column("vec_id", pa.array(group.row))
                yield from named.append_column("score", pa.array(group.score)).to_batches()

    return run


def _best(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def integer_vectors(
    table: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x) of the rows that take part.

    Rows with a null id or label, a null vector, or a null or non-finite component do not.
    """
    x = lambda c: c.cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf"))
    rows = table.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").alias("e"),
    )
    rows = rows.where("vec_id is not null and label is not null and e is not null").where(F.forall("e", finite))
    return rows.select("vec_id", "label", F.transform("e", lambda c: F.floor(x(c) * scale).cast("long")).alias("v"))


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors``, some of its rows, have ``vec_id, label, v`` as
    ``integer_vectors`` gives them.  Scores are integer inner products; higher ones
    come first, ties by smaller id.  An anchor's positives are the best ``positives``
    rows of its label with another id; for each, the best ``negatives`` rows of other
    labels with ``low_percent * p <= 100 * n <= high_percent * p`` (p, n: the scores)
    are returned, or all if there are fewer.

    Rows that share an id are rows of their own, but never meet an anchor of that id;
    of anchors that share one, the row with the smallest label and vector is the anchor.  Vectors of different lengths
    have no score.  Empty tables give an empty result.  Scores beyond 64 bits count
    as the ends of that range.
    """
    stored = cut_lineage(vectors.select("vec_id", "label", "v"), "vectors")
    first = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row"))
    asked = first.select(
        F.col("vec_id").alias("anchor_id"), F.col("_row.label").alias("anchor_label"), F.col("_row.v").alias("v"),
        F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"),
    )
    asked = cut_lineage(asked, "anchors")
    near = grid_map(asked, stored, _ranked(True, positives, ["anchor_id"]), "anchor_id long, vec_id long, score long")
    near = _best(near, ["anchor_id"], positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")
    )
    p = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(p * low_percent / 100), F.floor(p * high_percent / 100)
    windows = asked.drop("low", "high").join(near, "anchor_id")
    windows = windows.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).where("low <= high")
    keys = ["anchor_id", "positive_id", "positive_score", "place"]
    far = grid_map(
        windows, stored, _ranked(False, negatives, keys),
        "anchor_id long, positive_id long, positive_score long, place int, vec_id long, score long",
    )
    return _best(far, keys, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
