"""Joins and running sums that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import scratch_path

# A lookup side is broadcast only below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure whether a DataFrame is small enough to broadcast.

    Reads at most ``max_rows + 1`` rows, so the check itself stays cheap.
    """
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = (
        df.select(row_bytes.alias("b"))
        .limit(max_rows + 1)
        .agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    salts: int = 1,
    max_rows: int = BROADCAST_ROWS,
    measure: bool = True,
) -> DataFrame:
    """Join a large side to a lookup side whose keys may be hot on the left.

    A lookup measured to be small is broadcast.  Otherwise it is a plain equi-join,
    whose hot keys adaptive execution splits on the large side.  With ``salts``
    above 1, for a key known to be hot where that is not enough, every row of
    the large side gets a salt from its own content and the lookup is repeated
    once per salt.  All give the same rows.  ``how`` is any join that keeps or
    drops left rows: inner, left, left_semi, left_anti.  Measuring runs the lookup
    once; pass ``measure=False`` for a lookup as costly as the join itself.
    """
    if measure and fits_broadcast(lookup, max_rows):
        return rows.join(F.broadcast(lookup), on, how)
    if salts <= 1:
        return rows.join(lookup, on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(rows)]), F.lit(salts))
    salted = rows.withColumn("_salt", salt.cast("int"))
    spread = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    value: Column,
    name: str,
    *,
    largest: bool = False,
) -> DataFrame:
    """Inclusive running sum (or maximum) per key, computed in two levels.

    ``block`` must not decrease along ``order`` and must bound how many rows
    share one (key, block).  Rows are folded within their block and only one
    row per block takes part in the fold across blocks, so a key holding most
    of the table is spread over as many tasks as it has blocks.
    """
    fold = F.max if largest else F.sum
    staged = df.withColumn("_block", block).withColumn("_value", value)
    totals = staged.groupBy(*keys, "_block").agg(fold("_value").alias("_total"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(*keys, "_block", fold("_total").over(earlier).alias("_before"))
    within = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    if largest:
        combined = F.greatest("_before", "_within")
    else:
        combined = F.coalesce("_before", F.lit(0)) + F.col("_within")
    return (
        staged.withColumn("_within", fold("_value").over(within))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, combined)
        .drop("_block", "_value", "_within", "_before")
    )


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that comes in fewer splits than there are cores.

    A table of one row group would keep all narrow work in one task.  Inputs
    with enough splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
