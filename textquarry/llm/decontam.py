"""Benchmark decontamination by greedy string tiling.

A passage of a benchmark can be copied in pieces and in another order.  Tiling
finds the longest common runs of a document and an item first, marks their words
as used on both sides, and goes on with shorter runs, down to ``min_tile`` words;
runs of a length are found by rolling Karp-Rabin hashes.  The share of the item's
words under tiles is its coverage by the document.  An item of fewer words is found
whole: its own length is the shortest tile.

Pairs come from an equi-join: hashes of ``min_tile``-word windows of the items
against those of the documents.  Every tile contains such a window, so no pair
that could have a tile is missed.  The item side, a benchmark, is broadcast when
its measured size allows, and then only its windows leave the document scan; a
window that many documents share only meets the few items that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.plans.joins import cut_lineage, fits_broadcast

MIN_TILE = 5
COVERAGE_PERCENT = 50
BROADCAST_BYTES = 32 << 20
BROADCAST_IDS = 1_000_000


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(document position, item position, length) of the tiles of two word-hash arrays.

    Longest matches first; among equal ones the earliest in the item, then in the
    document.  Tiles do not overlap on either side.
    """
    if len(doc) < min_tile or len(item) < min_tile:
        return []
    free_d, free_i = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    length = _longest(doc, item, free_d, free_i, min_tile)
    while length >= min_tile:
        before = len(tiles)
        for i, d in _matches(doc, item, free_d, free_i, length):
            if free_i[i : i + length].all() and free_d[d : d + length].all():
                free_i[i : i + length] = False
                free_d[d : d + length] = False
                tiles.append((d, i, length))
        if len(tiles) == before:  # equal hashes of different words
            break
        length = _longest(doc, item, free_d, free_i, min_tile)
    return tiles


def _runs(values: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hash of every window of free words, and where the windows begin."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    kept = kernels._tables()
    if width < len(kept["power"]) and len(values) < len(kept["power"]):
        power, inverse = kept["power"], kept["inverse"]
    else:
        power = kernels._powers(kept["base"], len(values) + 1)
        inverse = kernels._powers(kept["inverse_base"], len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])
    rolled = (sums[width:] - sums[:-width]) * inverse[:n]
    used = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(used[width:] == used[:-width])
    return rolled[at], at


def _longest(doc, item, free_d, free_i, least: int) -> int:
    """Length of the longest common run of free words, by bisection; 0 below ``least``."""
    low, high = least - 1, min(len(doc), len(item))
    while low < high:
        middle = (low + high + 1) // 2
        a, _ = _runs(item, free_i, middle)
        b, _ = _runs(doc, free_d, middle)
        if len(a) and len(b) and np.isin(a, b).any():
            low = middle
        else:
            high = middle - 1
    return low if low >= least else 0


def _matches(doc, item, free_d, free_i, width: int) -> Iterator[tuple[int, int]]:
    """Places of common runs of ``width`` words, in item order, confirmed word by word."""
    a, at = _runs(item, free_i, width)
    b, bt = _runs(doc, free_d, width)
    order = np.argsort(b, kind="stable")
    b, bt = b[order], bt[order]
    low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    for k in np.flatnonzero(high > low):
        i = int(at[k])
        if not free_i[i : i + width].all():
            continue
        for d in bt[low[k] : high[k]]:
            # A place taken meanwhile makes way for the next one.
            if free_d[d : d + width].all() and (doc[d : d + width] == item[i : i + width]).all():
                yield i, int(d)
                break


def _word_ids(width: int):
    """(id, word hashes as bytes, window hashes) of benchmark items."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches):
            blobs = kernels.blobs_of(batch.column(1))
            texts = kernels.Texts(blobs)
            words = texts.word_hashes()
            ends = texts.first
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([words[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    pa.array(np.diff(ends)),
                ],
                names=["item_id", "words", "n_item_words"],
            )

    return run


def _windows_of(words: np.ndarray, width: int) -> np.ndarray:
    rolled, valid = kernels.windows(words, np.array([0, len(words)]), width)
    return np.unique(rolled[valid])


def _tile_rows(doc_words: np.ndarray, owners, items: dict, min_tile: int):
    for key in sorted(owners):
        words = items[key]
        found = tile(doc_words, words, min(min_tile, len(words)))
        if found:
            covered = sum(t[2] for t in found)
            yield key, len(words), covered, found


COVER = (
    "item_id long, n_item_words long, n_covered long, "
    "tiles array<struct<doc_word: long, item_word: long, length: long>>"
)
NAMES = ["node", "item_id", "n_item_words", "n_covered", "tiles"]


def _as_batch(rows: list[tuple]):
    import pyarrow as pa

    triple = pa.struct([(n, pa.int64()) for n in ("doc_word", "item_word", "length")])
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    tiles = [
        [dict(zip(("doc_word", "item_word", "length"), map(int, t), strict=True)) for t in ts]
        for ts in columns[4]
    ]
    arrays = [pa.array(columns[k], pa.int64()) for k in range(4)] + [pa.array(tiles, pa.list_(triple))]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def _tile_sent(sent, min_tile: int):
    """Documents against all items, which the task holds."""

    def run(batches: Iterator) -> Iterator:
        kernels.forget_vocabulary()
        items = {k: np.frombuffer(b, np.uint64) for k, b in sent.value.items()}
        by_width: dict[int, dict[int, list[int]]] = {}
        for key, words in items.items():
            width = min(min_tile, len(words))
            seeds = by_width.setdefault(width, {})
            for h in _windows_of(words, width).tolist():
                seeds.setdefault(h, []).append(key)
        known = {w: np.array(sorted(seeds), dtype=np.uint64) for w, seeds in by_width.items()}
        for batch in kernels.cuts(batches):
            ids, blobs = batch.column(0).to_pylist(), kernels.blobs_of(batch.column(1))
            rows: list[tuple] = []
            for begin, part in kernels.slices(blobs):
                texts = kernels.Texts(part)
                words = texts.word_hashes()
                met: dict[int, set] = {}
                for width, seeds in by_width.items():
                    rolled, valid = kernels.windows(words, texts.first, width)
                    hit = np.flatnonzero(valid & np.isin(rolled, known[width]))
                    owner = np.searchsorted(texts.first, hit, "right") - 1
                    for i in np.unique(owner).tolist():
                        mine = np.unique(rolled[hit[owner == i]]).tolist()
                        met.setdefault(i, set()).update(k for h in mine for k in seeds[h])
                for i in sorted(met):
                    a, b = texts.first[i], texts.first[i + 1]
                    for found in _tile_rows(words[a:b], met[i], items, min_tile):
                        rows.append((ids[begin + i], *found))
            yield _as_batch(rows)

    return run


def _seeds(widths: list[int]):
    """(node, width, seed) windows of texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches):
            blobs = kernels.blobs_of(batch.column(1))
            for begin, part in kernels.slices(blobs):
                texts = kernels.Texts(part)
                words = texts.word_hashes()
                for width in widths:
                    rolled, valid = kernels.windows(words, texts.first, width)
                    at = np.flatnonzero(valid)
                    owner = np.searchsorted(texts.first, at, "right") - 1 + begin
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(owner)), pa.array(np.full(len(at), width)),
                            pa.array(rolled[at].view(np.int64)),
                        ],
                        names=["node", "width", "seed"],
                    )

    return run


def _tile_pairs(min_tile: int):
    """Tiles of (node, text, item_id, words) rows."""

    def run(batches: Iterator) -> Iterator:
        for batch in kernels.cuts(batches):
            nodes, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            blobs, sides = kernels.blobs_of(batch.column(1)), batch.column(3).to_pylist()
            rows = []
            for node, blob, key, side in zip(nodes, blobs, keys, sides, strict=True):
                words = kernels.Texts([blob]).word_hashes()
                item = {key: np.frombuffer(side, np.uint64)}
                rows += [(node, *f) for f in _tile_rows(words, [key], item, min_tile)]
            yield _as_batch(rows)

    return run


def tiled_pairs(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tile: int = MIN_TILE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, item_id, n_item_words, n_covered, tiles) of every pair that has a tile.

    Texts and items without words have no tiles, nor do texts without a run of
    ``min_tile`` words of an item, or of all its words where it has fewer; texts and
    items are taken whole at any length, and an empty side gives no pairs.  Rows with a null id, on either side, take no part.  Of items that
    share an id the row with the most words (then the larger hash) counts; rows
    of documents that share an id give a result each.  Other columns are not read.
    """
    items = (
        items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("t"))
        .where("item_id is not null")
        .mapInArrow(_word_ids(min_tile), "item_id long, words binary, n_item_words long")
        .groupBy("item_id")
        .agg(F.max(F.struct("n_item_words", "words")).alias("top"))
        .select("item_id", "top.n_item_words", "top.words")
        .where("n_item_words > 0")
    )
    items = cut_lineage(items, "items")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.where("node is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("words") + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast(
            {r["item_id"]: bytes(r["words"]) for r in items.collect()}
        )
        pairs = texts.mapInArrow(_tile_sent(sent, min_tile), f"node long, {COVER}")
    else:
        raw = items.select("item_id", "words").mapInArrow(
            _item_seeds(min_tile), "item_id long, width long, seed long"
        )
        widths = [r[0] for r in items.select(F.least("n_item_words", F.lit(min_tile))).distinct().collect()]
        seeds = texts.mapInArrow(_seeds(sorted(widths)), "node long, width long, seed long")
        met = seeds.join(raw, ["width", "seed"]).select("node", "item_id").distinct()
        wide = texts.join(met, "node").join(items.select("item_id", "words"), "item_id")
        pairs = wide.select("node", "text", "item_id", "words").mapInArrow(
            _tile_pairs(min_tile), f"node long, {COVER}"
        )
    return pairs.withColumnRenamed("node", id_col)


def _item_seeds(min_tile: int):
    """(item_id, width, seed) windows of items."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            items = [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
            widths = np.array([min(min_tile, len(i)) for i in items], dtype=np.int64)
            parts = [_windows_of(i, int(w)) for i, w in zip(items, widths, strict=True)]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            seeds = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(widths[owner]), pa.array(seeds.view(np.int64))],
                names=["item_id", "width", "seed"],
            )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    coverage_percent: int = COVERAGE_PERCENT,
    **settings,
) -> DataFrame:
    """(id, item_id, n_item_words, n_covered) of pairs whose document covers enough of the item.

    A pair counts when ``100 * n_covered >= coverage_percent * n_item_words``.
    """
    pairs = tiled_pairs(docs, items, id_col=id_col, **settings)
    return pairs.where(
        100 * F.col("n_covered") >= coverage_percent * F.col("n_item_words")
    ).select(id_col, "item_id", "n_item_words", "n_covered")


def clean_documents(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **settings
) -> DataFrame:
    """Rows of ``docs`` that contain no item.  Rows with a null id stay.

    The ids that go are written; measured to be few they travel to the texts.
    """
    found = contamination(docs, items, id_col=id_col, **settings)
    bad = cut_lineage(found.select(F.col(f"`{id_col}`").alias("_leaking")).distinct(), "leaking")
    bad = F.broadcast(bad) if fits_broadcast(bad, max_rows=BROADCAST_IDS) else bad
    return docs.join(bad, docs[f"`{id_col}`"].cast("long") == bad["_leaking"], "left_anti")
