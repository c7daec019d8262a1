"""Embedding chunks: the built-in hashed embedder or a model of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType

from textquarry.functions.embed import DEFAULT_DIM, hash_embedding
from textquarry.operators.index import with_cached_vectors

DEFAULT_BATCH = 32

# Makes an ``embed(texts) -> vectors`` function; called once per task.
EmbedderFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


def _model_vectors(factory: EmbedderFactory, batch_size: int):
    """Column function of texts: the model's vectors, null for null."""

    @arrow_udf(ArrayType(FloatType()))
    def vectors_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = factory()
        for batch in batches:
            texts = [t for t in batch.to_pylist() if t is not None]
            vectors: list = []
            for at in range(0, len(texts), batch_size):
                part = embed(texts[at : at + batch_size])
                wanted = len(texts[at : at + batch_size])
                if len(part) != wanted:
                    raise ValueError(f"expected {wanted} embeddings, got {len(part)}")
                vectors.extend(part)
            made = iter(vectors)
            out = [list(map(float, next(made))) if known else None for known in batch.is_valid().to_pylist()]
            yield pa.array(out, pa.list_(pa.float32()))

    return vectors_of


def embed_with(
    chunks: DataFrame, factory: EmbedderFactory, batch_size: int = DEFAULT_BATCH
) -> DataFrame:
    """Add ``embedding`` with an external model.

    Only the text crosses to Python, in batches of ``batch_size`` texts.  A
    model that returns another number of vectors than texts fails the job.
    """
    batch_size = batch_size if batch_size > 0 else DEFAULT_BATCH
    return chunks.withColumn("embedding", _model_vectors(factory, batch_size)("content"))


def embed_chunks(
    chunks: DataFrame,
    vectors: DataFrame | None = None,
    *,
    factory: EmbedderFactory | None = None,
    dim: int = DEFAULT_DIM,
    batch_size: int = DEFAULT_BATCH,
) -> DataFrame:
    """Chunks with vectors: from the cache by chunk id, otherwise computed.

    Texts that have a cached vector are not handed to the embedder.
    """
    if factory is None:
        if vectors is None:
            return chunks.withColumn(
                "embedding", hash_embedding(F.col("content"), dim).cast("array<float>")
            )
        missing = F.when(F.col("embedding").isNull(), F.col("content"))
        return with_cached_vectors(chunks, vectors).withColumn(
            "embedding", F.coalesce("embedding", hash_embedding(missing, dim).cast("array<float>"))
        )
    if vectors is None:
        return embed_with(chunks, factory, batch_size)
    # One pass: texts with a vector reach the model's column as null.
    batch_size = batch_size if batch_size > 0 else DEFAULT_BATCH
    missing = F.when(F.col("embedding").isNull(), F.col("content"))
    return with_cached_vectors(chunks, vectors).withColumn(
        "embedding", F.coalesce("embedding", _model_vectors(factory, batch_size)(missing))
    )
