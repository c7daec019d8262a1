"""Vector expressions: the built-in hashed embedder and normalisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 64
# Texts are cut into words so many bytes at a time: words take many times their text's size.
SLICE_BYTES = 2 * 1024 * 1024


def _buckets(tokens: list[str], dim: int) -> np.ndarray:
    """Bucket of each token: first 32 bits of its md5, modulo the dimension."""
    heads = [int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in tokens]
    return np.array(heads, dtype=np.int64) % dim


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive texts of at most ``most`` bytes together; a longer one is by itself."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        limit = (ends[at - 1] if at else 0) + most
        stop = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def _embed_batch(texts: pa.Array, dim: int) -> np.ndarray:
    """Unit-length term counts of a batch of lower-cased texts, a slice at a time."""
    parts = [_embed_slice(part, dim) for part in _slices(texts, SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, dim))


def _embed_slice(texts: pa.Array, dim: int) -> np.ndarray:
    """Unit-length term counts of texts held at once.

    Works on whole columns; only the distinct tokens of a slice are hashed.
    """
    words = pc.split_pattern_regex(texts.cast(pa.large_string()), pattern="[^a-z0-9]+")
    rows = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in vocabulary], dtype=bool)
    keep = real[codes] if len(codes) else np.zeros(0, dtype=bool)
    cells = rows[keep] * dim + _buckets(vocabulary, dim)[codes[keep]]
    counts = np.bincount(cells, minlength=len(texts) * dim).astype(np.float64)
    counts = counts.reshape(len(texts), dim)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def hash_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Hashed term-frequency vector of a text, L2-normalised; null for null.

    Tokens are the lower-cased runs of ASCII letters and digits.  A narrow
    operation: no token leaves its task, so embedding a corpus needs no
    shuffle.  Runs on Arrow batches, because hashing and counting tokens with
    array lambdas costs about twenty times as much.
    """

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        matrix = _embed_batch(texts.fill_null(""), dim)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * dim
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()), mask=mask)

    return embed(F.lower(text))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain Column used twice is a tree used twice, and inside a lambda it is
    evaluated per element; a one-element array gives it a name instead.
    """
    return F.transform(F.array(value), body)[0]
