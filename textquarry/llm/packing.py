"""Best-fit packing planned on the histogram of lengths.

The plan looks at how many pieces there are of each length, never at the pieces:
best-fit decreasing places all pieces of one length at once into runs of equal
sequences, so its work depends on the number of distinct lengths, at most the
capacity.  A plan row says that ranks ``[rank, rank + n)`` of a length go
``per_sequence`` each to consecutive sequences from ``sequence`` on, from
``offset``.  Pieces then take their slots by their rank within their length.

Ranks are worked out in two levels: within (length, block) over narrow rows, and
from the counts of the blocks before; a length that a third of all pieces have
is spread over its blocks.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.tokens import TEXTS, Encoder
from textquarry.plans.joins import cut_lineage

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_ROWS = 100_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, rank, n, sequence, per_sequence, offset).

    ``histogram`` maps lengths from 1 to ``capacity`` to how many pieces have
    them.  Rows are ordered by length and rank and cover every rank once.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, how many)
    spaces: list[int] = []  # keys of open_runs, ascending
    made = 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in open_runs:
                bisect.insort(spaces, space)
                open_runs[space] = []
            open_runs[space].append((first, n))

    def take(length: int, rank: int, left: int, space: int, first: int, n: int) -> int:
        """Fill up to ``n`` sequences with ``space`` from ``left`` pieces; how many went in."""
        per = min(space // length, left)
        full = min(n, left // per)
        rows.append((length, rank, full * per, first, per, capacity - space))
        put(space - per * length, first, full)
        put(space, first + full, n - full)
        return full * per

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = open_runs[space].pop()
                if not open_runs[space]:
                    del open_runs[space], spaces[at]
            else:
                space, first = capacity, made
                per = min(capacity // length, left)
                n = left // per
                made += n
            went = take(length, rank, left, space, first, n)
            rank, left = rank + went, left - went
    out = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> DataFrame:
    """(row, id, piece, start, length, ids) of all documents, written to the shared folder.

    A document is the ids of its text and then ``end_id``; only one longer than
    the capacity is cut, into pieces of the capacity and a last, maybe shorter
    one.  ids are little-endian unsigned 32-bit integers; row is a number of its
    own for every piece.  A null text is empty, a text of any length is encoded
    whole.  Repeated rows and rows with a null id are documents of their own, an
    empty table has no pieces.  Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder.get(vocabulary, spaced=False, width=4)
        row = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                texts = [t or "" for t in batch.column(1).slice(begin, TEXTS).to_pylist()]
                owner, number, start, length, ids = [], [], [], [], []
                for i, made in enumerate(encoder.encode(texts), begin):
                    made += end
                    for at in range(0, len(made), 4 * capacity):
                        part = made[at : at + 4 * capacity]
                        owner.append(i)
                        number.append(at // (4 * capacity))
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                rows = np.arange(row, row + len(owner), dtype=np.int64)
                row += len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["row", id_col, "piece", "start", "length", "ids"],
                )

    wanted = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = wanted.schema[0].dataType.simpleString()
    shape = f"row long, `{id_col}` {kind}, piece int, start long, length long, ids binary"
    return cut_lineage(wanted.mapInArrow(run, shape), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, sequence_id, offset) of every piece of a written ``pieces`` table."""
    spark = cut.sparkSession
    counts = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in counts}
    rows = plan(histogram, capacity)
    blocks = max(1, sum(histogram.values()) // BLOCK_ROWS)
    narrow = cut.select(
        "row", "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    )
    inside = Window.partitionBy("length", "block").orderBy("row")
    ranked = narrow.withColumn("inside", F.row_number().over(inside) - 1)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = narrow.groupBy("length", "block").count().select(
        "length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    ranked = ranked.join(bases, ["length", "block"]).select(
        "row", "length", (F.col("base") + F.col("inside")).alias("rank")
    )
    sent = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slots = sent.value
        bits = 50
        keys = (slots[:, 0] << bits) + slots[:, 1]
        for batch in batches:
            length = batch.column(1).to_numpy()
            rank = batch.column(2).to_numpy()
            slot = slots[np.searchsorted(keys, (length << bits) + rank, "right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(slot[:, 3] + nth // slot[:, 4]),
                    pa.array(slot[:, 5] + nth % slot[:, 4] * length),
                ],
                names=["row", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "row long, sequence_id long, offset long")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, **settings) -> DataFrame:
    """``pieces`` of the documents with their sequence_id and offset, ids included."""
    cut = pieces(docs, capacity=capacity, **settings)
    return cut.join(place(cut, capacity), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, starts): the packed sequences, pieces in their order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
