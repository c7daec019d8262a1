"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature.  One permutation scatters the shingle hashes over Z_2^32; a second
one, shifted circularly by k, gives coordinate k: ``h_k(S) = min pi(sigma(v) + k
mod 2^32)``.  Two permutations thus make any number of coordinates.

Candidates.  Equal sets are folded to one representative first.  Coordinates
are grouped in bands of ``rows``; representatives that agree on a band share a
bucket.  With 30 bands of 4, a pair at similarity 0.8 shares none with
probability below 2e-7.

Verification without all pairs.  (1) Every member is compared with the smallest
document of its buckets, and the verified links are contracted to components.
(2) Only buckets that still hold two or more components go on: their members
outside the bucket's largest component are dealt to blocks, and each block is
compared with the members of other components, in tasks of bounded size.  Pairs
known to be connected are never compared, and no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.llm.components import components
from textquarry.plans.joins import cut_lineage, fits_broadcast

BANDS = 30
ROWS = 4
SEED = 0x2545F4914F6CDD1D
BLOCK = 128
CHUNK = 256
BROADCAST_IDS = 1_000_000


def signatures(sets: list[np.ndarray], coordinates: int, seed: int = SEED) -> np.ndarray:
    """(len(sets), coordinates) circulant MinHash values; empty sets give all ones."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    begin = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
    # Blocks of whole sets that stay in the processor's cache.
    at = 0
    while at < len(full):
        stop = at + 1
        while stop < len(full) and begin[stop] - begin[at] < 1 << 15:
            stop += 1
        last = begin[stop] if stop < len(full) else len(values)
        part = values[begin[at] : last]
        place = (kernels.mix64(part ^ np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
        where = begin[at:stop] - begin[at]
        x, y = np.empty_like(place), np.empty_like(place)
        rows = np.empty((coordinates, len(where)), dtype=np.uint32)
        for k in range(coordinates):
            np.add(place, np.uint32(k), out=x)  # the circular shift
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):  # the permutation pi
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.minimum.reduceat(x, where, out=rows[k])
        out[full[at:stop]] = rows.T
        at = stop
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys of the bands of signatures."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key *= np.uint64(0x9FB21C651E98DF25)
        key += parts[:, :, r]
        key = kernels.mix64(key)
    return key


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches):
            ids, blobs = batch.column(0), kernels.blobs_of(batch.column(1))
            for begin, part in kernels.slices(blobs):
                sets = kernels.shingle_sets(part, width)
                keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
                first = np.zeros(len(sets), dtype=np.uint64)
                second = np.zeros(len(sets), dtype=np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        first[i] = np.bitwise_xor.reduce(kernels.mix64(s + np.uint64(1)))
                        second[i] = np.add.reduce(kernels.mix64(s ^ np.uint64(SEED)))
                size = np.array([len(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, len(part)),
                        pa.array(size),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)),
                            pa.array(keys.ravel()),
                        ),
                    ],
                    names=["node", "n", "s1", "s2", "keys"],
                )

    return run


def _sets(width: int):
    """Shingle sets of texts, as 64-bit values in bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches):
            blobs = kernels.blobs_of(batch.column(1))
            for begin, part in kernels.slices(blobs):
                sets = [s.tobytes() for s in kernels.shingle_sets(part, width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(part)), pa.array(sets, pa.binary())],
                    names=["node", "shingles"],
                )

    return run


def _similar(percent: int):
    """Pairs of sets that reach the similarity."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernels.forget_vocabulary()
        for batch in kernels.cuts(batches):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(left), dtype=bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                if 100 * len(a) < percent * len(b):
                    continue
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]
            ).filter(pa.array(keep))

    return run


def block_links(percent: int):
    """Links between a block of documents and the members dealt to it.

    One group holds about BLOCK documents in question and CHUNK members of the
    bucket.  Of the links to one component one is enough for every document.
    """

    def run(table):
        import pyarrow as pa

        kernels.forget_vocabulary()
        role = np.array(table["asks"].to_pylist(), dtype=bool)
        nodes = np.array(table["node"].to_pylist(), dtype=np.int64)
        comps = np.array(table["comp"].to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        ask = np.flatnonzero(role)
        if not len(ask) or len(ask) == len(role):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate([sets[i] for i in ask])
        owners = np.repeat(np.arange(len(ask)), size[ask])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        found: dict[tuple[int, int], int] = {}
        for y in np.flatnonzero(~role):
            low = np.searchsorted(values, sets[y], "left")
            count = np.searchsorted(values, sets[y], "right") - low
            total = int(count.sum())
            if not total:
                continue
            shift = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            both = np.bincount(owners[np.arange(total) + shift], minlength=len(ask))
            hit = 100 * both >= percent * (size[ask] + size[y] - both)
            hit &= comps[ask] != comps[y]
            for k in np.flatnonzero(hit):
                found.setdefault((int(nodes[ask[k]]), int(comps[y])), int(nodes[y]))
        return pa.table(
            {
                "a": pa.array([a for a, _ in found], pa.int64()),
                "b": pa.array(list(found.values()), pa.int64()),
            }
        )

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` on
    their sets of distinct ``width``-word shingles (words lower-cased in A-Z; a
    shorter text is one shingle); component_id is the smallest id reachable over
    links, kept says whether that is the document itself.

    Texts that are null, empty or without words have no shingles and are linked
    with nothing.  Rows with a null id come back with their n_shingles, a null
    component and kept true.  Rows that share an id are one document: they
    stay or go together, and links of any of them count.  Columns besides id
    and text are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    sketch = cut_lineage(
        texts.mapInArrow(
            _sketch(width, bands, rows), "node long, n long, s1 long, s2 long, keys array<long>"
        ),
        "sketch",
    )
    named = sketch.where("node is not null and n > 0")
    classes = cut_lineage(
        named.groupBy("n", "s1", "s2").agg(F.min("node").alias("rep")), "classes"
    )
    member = named.select("node", "n", "s1", "s2").join(classes, ["n", "s1", "s2"])
    copies = member.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))

    # Buckets of representatives; a bucket of one is gone after the first fold.
    reps = named.join(
        classes.select(F.col("rep").alias("node"), "n", "s1", "s2"), ["node", "n", "s1", "s2"], "left_semi"
    )
    banded = reps.select("node", F.explode("keys").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("pivot"))
    buckets = buckets.where("m > 1")
    placed = cut_lineage(banded.join(buckets, "bucket"), "buckets")

    # Phase 1: every member with the smallest document of its buckets.
    stars = placed.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = cut_lineage(stars, "stars")
    asked = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node")))
    asked = cut_lineage(asked.distinct(), "asked")
    shingles = _written_sets(texts, asked, width)
    links = cut_lineage(
        stars.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .select("a", "b", "left", "right")
        .mapInArrow(_similar(percent), "a long, b long"),
        "links",
    )
    linked = links.union(copies)
    found = cut_lineage(components(linked), "components")

    # Phase 2: buckets that still hold more than one component.  Buckets of two
    # are settled: their one pair was compared.
    large = placed.where("m > 2")
    labelled = large.join(found, "node", "left").select(
        "bucket", "node", "m", F.coalesce("root", "node").alias("comp")
    )
    per_comp = labelled.groupBy("bucket", "comp", "m").agg(F.count("*").alias("c"))
    split = (
        per_comp.groupBy("bucket", "m")
        .agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"))
        .where("comps > 1")
        .select(
            "bucket",
            F.col("top.comp").alias("major"),
            F.ceil((F.col("m") - F.col("top.c")) / F.lit(BLOCK)).cast("int").alias("blocks"),
            F.ceil(F.col("m") / F.lit(CHUNK)).cast("int").alias("chunks"),
        )
    )
    open_members = cut_lineage(
        labelled.select("bucket", "node", "comp").join(split, "bucket"), "open"
    )
    more = _phase_two(texts, open_members, width, percent)
    if more is not None:
        found = cut_lineage(components(linked.union(more)), "components")

    roots = named.select("node").distinct().join(found, "node", "left")
    labels = roots.select("node", F.coalesce("root", "node").alias("root"))
    out = sketch.select("node", "n").join(labels, "node", "left")
    component = F.coalesce("root", "node")
    return out.select(
        F.col("node").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"),
    )


def _written_sets(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents named, written once.

    Ids measured to be few travel to the texts; else texts and ids meet by id.
    """
    few = fits_broadcast(nodes, max_rows=BROADCAST_IDS)
    wanted = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    return cut_lineage(wanted.mapInArrow(_sets(width), "node long, shingles binary"), "sets")


def _phase_two(texts: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame | None:
    if members.isEmpty():
        return None
    asked = cut_lineage(members.select("node").distinct(), "asked")
    shingles = _written_sets(texts, asked, width)
    digest = F.xxhash64("node", "bucket")
    home = F.pmod(digest, F.col("blocks").cast("long")).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(1), "node", "bucket"), F.col("chunks").cast("long")).cast("int")
    minor = members.where("comp <> major").withColumn("block", home)
    # A block asks every chunk; members answer to every block (minors to theirs and later ones).
    asks = minor.select(
        "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        "node", "comp", F.lit(True).alias("asks"),
    )
    low = F.when(F.col("comp") == F.col("major"), F.col("blocks") - 1).otherwise(home)
    answers = members.withColumn("chunk", chunk).select(
        "bucket", F.explode(F.sequence(F.lit(0), low)).alias("block"), "chunk",
        "node", "comp", F.lit(False).alias("asks"),
    )
    dealt = asks.union(answers).join(shingles, "node")
    return cut_lineage(
        dealt.groupBy("bucket", "block", "chunk").applyInArrow(
            block_links(percent), "a long, b long"
        ),
        "links",
    )
