"""Numpy kernels shared by the text operators: word spans, span hashes, shingles.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 that is
the same as working on code points.  A batch of texts is laid out in one byte
array, so that the kernels run over many short texts at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 17
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000


def process_store() -> dict:
    """Objects kept for the life of a Python worker (tables, tokenizers, caches).

    Task functions are pickled with their code, so their own module globals do
    not outlive a task; this module entry does.
    """
    name = "_textquarry_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__.setdefault("kept", {})


def kept_vocabulary(key: tuple, make):
    """The one vocabulary, with its cache, that a worker process holds at a time."""
    kept = process_store()
    if kept.get("vocabulary", (None,))[0] != key:
        kept.pop("vocabulary", None)
        kept["vocabulary"] = (key, make())
    return kept["vocabulary"][1]


def forget_vocabulary() -> None:
    """Give back the memory of a vocabulary that an earlier stage left in this process."""
    if process_store().pop("vocabulary", None) is not None:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> dict:
    kept = process_store()
    if "tables" not in kept:
        random = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lower = random.copy()
        lower[65:91] = random[97:123]
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        separator = np.zeros(256, dtype=bool)
        separator[[0x20, *range(0x09, 0x0E)]] = True
        kept["tables"] = {
            "raw": random,
            "lower": lower,
            "base": base,
            "power": _powers(base, 2 * CHUNK),
            "inverse": _powers(inverse, 2 * CHUNK),
            "inverse_base": inverse,
            "second": mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC6A4A7935BD1E995)),
            "separator": separator,
        }
        kept["tables"]["second"][65:91] = kept["tables"]["second"][97:123]
    return kept["tables"]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: str) -> np.ndarray:
    """64-bit hash of ``data[start:end]`` for ascending, disjoint spans.

    ``table`` is ``raw`` or, reading A-Z as a-z, ``lower`` or ``second`` (an
    independent hash, for keys of 128 bits).  The hash depends on the bytes
    alone, not on the place of the span.
    """
    tables = _tables()
    lut = tables[table]
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        length = int(ends[j - 1]) - base
        power, inverse = tables["power"], tables["inverse"]
        if length >= len(power):  # one span longer than a chunk
            power, inverse = _powers(tables["base"], length + 1), tables["inverse"]
        sums = np.zeros(length + 1, dtype=np.uint64)
        np.cumsum(lut[data[base : base + length]] * power[:length], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(
            0xD6E8FEB86659FD93
        )
        i = j
    return mix64(out)


class Texts:
    """Several texts as one byte array with their words.

    ``starts``/``ends`` are word spans, ``first[i]:first[i + 1]`` the words of
    text ``i``, ``at[i]:at[i] + size[i]`` its bytes.
    """

    def __init__(self, blobs: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*blobs, b""]), dtype=np.uint8)
        self.size = np.array([len(b) for b in blobs], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        inside = ~_tables()["separator"][self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, np.append(self.at, len(self.data)))

    def word_hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, "lower" if lower else "raw")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines, and the first line of each text."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([[0], cuts[:-1] + 1]) if len(cuts) else cuts
        return starts, cuts, np.searchsorted(starts, np.append(self.at, len(self.data)))


class LineKeys:
    """The lines of several texts with their keys.

    A key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
    lower-cased: ``start``/``end`` are its bytes, ``chars`` its code points,
    ``h1``/``h2`` its 128-bit hash.  ``first[i]:first[i + 1]`` are text ``i``'s lines.
    """

    def __init__(self, texts: Texts):
        begin, stop, self.first = texts.lines()
        self.line_start, self.line_end = begin, stop
        a = np.searchsorted(texts.starts, begin)
        b = np.searchsorted(texts.starts, stop)
        self.start, self.end = begin.copy(), begin.copy()
        some = b > a
        self.start[some] = texts.starts[a[some]]
        self.end[some] = texts.ends[b[some] - 1]
        self.has_word = some
        heads = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        self.chars = heads[self.end] - heads[self.start]
        self.h1 = span_hashes(texts.data, self.start, self.end, "lower")
        self.h2 = span_hashes(texts.data, self.start, self.end, "second")


def slices(blobs: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes (a longer text comes alone)."""
    begin, size = 0, 0
    for i, blob in enumerate(blobs):
        if size and size + len(blob) > limit:
            yield begin, blobs[begin:i]
            begin, size = i, 0
        size += len(blob) + 1
    if begin < len(blobs):
        yield begin, blobs[begin:]


def cuts(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches in cuts of at most ``rows`` rows, which keeps a task's copies small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def blobs_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def windows(hashes: np.ndarray, first: np.ndarray, width: int):
    """Hash of every run of ``width`` words inside one text, and where runs begin.

    Returns (hash per word position, mask of positions where a run begins).
    """
    n = len(hashes)
    valid = np.zeros(n, dtype=bool)
    rolled = np.zeros(n, dtype=np.uint64)
    if n >= width:
        m = n - width + 1
        acc = hashes[:m].copy()
        for k in range(1, width):
            acc *= np.uint64(0x9FB21C651E98DF25)
            acc += hashes[k : k + m]
        rolled[:m] = mix64(acc)
        valid[:m] = True
    last = first[1:]
    for back in range(1, width):
        at = last - back
        valid[at[at >= first[:-1]]] = False
    return rolled, valid


def shingle_sets(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has the whole sequence as its one shingle; a text
    without words has none.
    """
    texts = Texts(blobs)
    words = texts.word_hashes()
    rolled, valid = windows(words, texts.first, width)
    out = []
    for i in range(len(blobs)):
        a, b = int(texts.first[i]), int(texts.first[i + 1])
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            acc = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                acc *= np.uint64(0x9FB21C651E98DF25)
                acc += words[k]
            out.append(mix64(acc))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
