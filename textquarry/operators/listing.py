"""File listings and directory trees, from paths alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.paths import (
    ancestors,
    depth_below,
    dir_name,
    glob_to_regex,
    relative_to,
    self_and_ancestors,
    under_path,
)

DEFAULT_DEPTH = 3


def directories_of(paths: DataFrame) -> DataFrame:
    """Distinct directories that hold any of the paths, ``/`` included.

    Only distinct directories are taken apart, not every path.
    """
    holders = paths.where(F.size(ancestors(F.col("path"))) > 0).select(dir_name(F.col("path")).alias("dir")).distinct()
    return holders.select(F.explode_outer(self_and_ancestors(F.col("dir"))).alias("path")).distinct()


def _strictly_below(root: str):
    return under_path(F.col("path"), root) & (F.col("path") != root)


def list_files(
    files: DataFrame, root: str, pattern: str = "*", *, include_dirs: bool = False
) -> DataFrame:
    """Paths below ``root`` matching a glob on the root-relative path.

    ``*`` lists the top level only; the match is case-sensitive.
    """
    root = root.rstrip("/") or "/"
    regex = "(?s)" + glob_to_regex(pattern or "*")
    listed = files.select("path").where(_strictly_below(root))
    if include_dirs:
        listed = listed.unionByName(directories_of(listed).where(_strictly_below(root)))
    return listed.where(relative_to(F.col("path"), F.lit(root)).rlike(regex)).distinct()


def directory_tree(files: DataFrame, root: str, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Flat tree below ``root``: ``path, parent, type, depth``.

    A directory at the depth limit is listed but not opened.
    """
    root = root.rstrip("/") or "/"
    depth = depth if depth > 0 else DEFAULT_DEPTH
    below = files.select("path").where(_strictly_below(root))
    entries = below.select("path", F.lit("file").alias("type")).unionByName(
        directories_of(below).where(_strictly_below(root)).select("path", F.lit("dir").alias("type"))
    )
    return (
        entries.withColumn("depth", depth_below(F.col("path"), root).cast("int"))
        .where(F.col("depth") <= depth)
        .select("path", dir_name(F.col("path")).alias("parent"), "type", "depth")
        .distinct()
    )
