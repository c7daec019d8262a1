"""A table of requests against all rows of a table, as a grid of bounded cells.

Requests are written in blocks, the rows in as many files as their scan has splits.
A cell is one block and one segment of the files: its task holds the block, streams
the segment from the shared folder, and gives back what its kernel found.  Nothing is
shuffled or broadcast but the results, the driver only sees file names, and a lost
task reads its two sides again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from textquarry.plans.joins import cut_lineage
from textquarry.session import scratch_path

BLOCK_ROWS = 1024
BATCH_ROWS = 4096
# Cells a core gets at least, where there are files enough.
WAVES = 3


def open_parquet(uri: str):
    """A Parquet file of the shared folder, on any file system Arrow knows."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pq.ParquetFile(system.open_input_file(path))


def _files(table: DataFrame) -> list[str]:
    return sorted(table.inputFiles())


def write_blocks(requests: DataFrame, rows: int) -> list[str]:
    """Write requests in files of at most ``rows`` rows, and name the files."""
    held = cut_lineage(requests, "requests")
    blocks = max(1, -(-held.count() // rows))
    path = scratch_path(held.sparkSession, "blocks")
    held.coalesce(blocks).write.option("maxRecordsPerFile", rows).parquet(path)
    return _files(held.sparkSession.read.schema(held.schema).parquet(path))


def grid_map(
    requests: DataFrame,
    stored: DataFrame,
    kernel: Callable,
    schema: str,
    *,
    block_rows: int = BLOCK_ROWS,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Run ``kernel(block, batches)`` on every cell of requests and stored rows.

    ``block`` is an Arrow table of at most ``block_rows`` requests, ``batches`` an
    iterator over Arrow batches of a segment of ``stored``, which must be a table
    read from files (as ``cut_lineage`` returns).  Every pair of a request and a
    row meets in one cell.  Empty sides give an empty result.
    """
    spark = stored.sparkSession
    blocks, files = write_blocks(requests, block_rows), _files(stored)
    cores = spark.sparkContext.defaultParallelism
    segments = min(len(files), max(1, -(-WAVES * cores // max(1, len(blocks)))))
    columns = stored.columns

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                block = open_parquet(blocks[cell // segments]).read()
                if block.num_rows:
                    yield from kernel(block, _stream(files[cell % segments :: segments], columns, batch_rows))

    cells = len(blocks) * segments
    return spark.range(0, cells, 1, max(1, cells)).mapInArrow(run, schema)


def _stream(files: list[str], columns: list[str], rows: int) -> Iterator:
    for name in files:
        yield from open_parquet(name).iter_batches(rows, columns=columns)
