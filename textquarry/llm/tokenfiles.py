"""Token ids as flat unsigned integer files with 64-bit document offsets.

A written corpus is a folder of parts, in ascending order of document ids:

- ``<part>.bin``  ids, unsigned 16-bit where the vocabulary fits, else 32-bit;
- ``<part>.idx``  unsigned 64-bit offsets into it, one more than documents;
- ``<part>.ids``  signed 64-bit document ids (rows with a null id come first);
- ``manifest``    a Parquet table of the parts: their name, documents, tokens and
  base, the number of ids in all parts before, a prefix sum over the parts.

All files are little-endian.  A part's name is new for each attempt of a task and
only the manifest names parts, so a lost task leaves no trace in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm import storage
from textquarry.llm.tokens import TEXTS, Encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0


def write_tokens(
    docs: DataFrame,
    folder: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    width: int = 2,
    parts: int | None = None,
) -> None:
    """Encode all documents and write them below ``folder`` in ascending id order.

    ``width`` is the bytes of an id: 2 for vocabularies of up to 65,536 ids,
    else 4.  A null text is empty: it has its end id alone.  Rows with a null id
    come first; rows that share an id are all written, next to each other.  A text
    is encoded whole at any length; an empty table writes no documents.  Other
    columns are not read.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")
    )
    parts = parts or max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "doc").sortWithinPartitions("doc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder.get(vocabulary, spaced=True, width=width)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        name = f"{folder}/{uuid.uuid4().hex}"
        system, path = storage.filesystem(f"{name}.bin")
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        out = None
        for batch in batches:
            out = out or system.open_output_stream(path, compression=None)
            ids.append(np.array([-1 if d is None else d for d in batch.column(0).to_pylist()], "<i8"))
            nulls = batch.column(0).null_count if len(ids) == 1 else nulls + batch.column(0).null_count
            for begin in range(0, batch.num_rows, TEXTS):
                made = encoder.encode([t or "" for t in batch.column(1).slice(begin, TEXTS).to_pylist()])
                sizes.append(np.array([len(m) // width + 1 for m in made], dtype=np.int64))
                out.write(b"".join(part for m in made for part in (m, end)))
        if out is None:
            return
        out.close()
        held = np.concatenate(ids)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        storage.write_bytes(f"{name}.idx", offsets.tobytes())
        storage.write_bytes(f"{name}.ids", held.tobytes())
        first = int(held[nulls]) if nulls < len(held) else None
        yield pa.RecordBatch.from_pydict(
            {
                "part": [name.rsplit("/", 1)[1]], "first_doc": pa.array([first], pa.int64()),
                "nulls": [nulls], "documents": [len(held)], "tokens": [int(offsets[-1])],
                "width": pa.array([width], pa.int32()),
            }
        )

    system, path = storage.filesystem(folder)
    system.create_dir(path, recursive=True)
    shape = "part string, first_doc long, nulls long, documents long, tokens long, width int"
    ordered.mapInArrow(run, shape).write.mode("overwrite").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of a folder with their base: one row a part, so one small window."""
    earlier = Window.orderBy(F.col("nulls").desc(), "first_doc").rowsBetween(
        Window.unboundedPreceding, -1
    )
    parts = spark.read.parquet(f"{folder}/manifest")
    return parts.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document of a folder.

    start counts the ids of all documents before; ids are little-endian unsigned
    32-bit integers.  Parts are memory-mapped and read document by document.
    """
    parts = manifest(spark, folder).select("part", "nulls", "documents", "width", "base")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in batch.to_pylist():
                name = f"{folder}/{part['part']}"
                tokens = storage.mapped(f"{name}.bin", f"<u{part['width']}")
                offsets = storage.mapped(f"{name}.idx", "<u8").astype(np.int64)
                docs = storage.mapped(f"{name}.ids", "<i8")
                step = TEXTS
                for a in range(0, part["documents"], step):
                    b = min(a + step, part["documents"])
                    at = np.arange(a, b)
                    ids = [tokens[x:y].astype("<u4").tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(docs[a:b]), mask=at < part["nulls"]),
                            pa.array(part["base"] + offsets[a:b]),
                            pa.array(np.diff(offsets[a : b + 1])),
                            pa.array(ids, pa.binary()),
                        ],
                        names=[id_col, "start", "n_tokens", "ids"],
                    )

    count = max(1, parts.count())
    dealt = parts.repartition(count)
    return dealt.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")
