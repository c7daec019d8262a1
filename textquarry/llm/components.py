"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.plans.joins import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable.

    Alternating star contraction: every node hangs its larger neighbours, then
    its smaller ones, onto the smallest node it sees, until nothing moves.  The
    number of rounds grows with the logarithm of a component's size.  A hub's
    neighbours are folded map-side to one minimum; the joins back on a hub are
    plain equi-joins, which adaptive execution splits.  Each round is written
    to the shared folder, so a lost executor re-reads one small table.
    """
    edges = cut_lineage(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = edges.where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a")
        edges = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))
        )
        edges = cut_lineage(edges.where("a <> b").distinct(), "links")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of a link table."""
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod("b", F.lit(1 << 20)))).first()
    )
