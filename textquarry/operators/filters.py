"""Which files and turns take part: index rules, ignore files, recency, roles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.paths import (
    ancestors,
    base_name,
    dir_name,
    extension,
    ignore_groups,
    matches_any,
    relative_to,
    under_path,
)
from textquarry.plans.joins import cut_lineage, lookup_join

# What is indexed when a directory sets nothing of its own.
DEFAULT_EXTENSIONS = (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".rs", ".md")
DEFAULT_EXCLUDES = (
    "node_modules/**", ".git/**", "vendor/**", "dist/**", "build/**", "__pycache__/**",
)
DEFAULT_MAX_FILE_SIZE_MB = 5


@dataclass(frozen=True)
class IndexRules:
    """Rules of one indexed directory.

    Own extensions replace the defaults, own excludes add to them.
    """

    extensions: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_file_size_mb: int = DEFAULT_MAX_FILE_SIZE_MB
    default_extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    default_excludes: tuple[str, ...] = DEFAULT_EXCLUDES

    def accepts(self, rel_path: Column, size: Column) -> Column:
        """Whether a file is indexed, from its relative path and size.

        Patterns see the lower-cased path but are not lower-cased themselves,
        so a pattern with capitals never matches.
        """
        lower = F.lower(rel_path)
        allowed = [e.lower() for e in (self.extensions or self.default_extensions) if e]
        rule = extension(rel_path).isin(allowed)
        if self.include:
            rule = rule & matches_any(lower, self.include)
        excludes = (*self.default_excludes, *self.exclude)
        if excludes:
            rule = rule & ~matches_any(lower, excludes)
        if self.max_file_size_mb > 0:
            rule = rule & (size <= self.max_file_size_mb * 1024 * 1024)
        return rule


def index_filter(files: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """Files the rules accept; needs ``rel_path`` and ``size``."""
    return files.where(rules.accepts(F.col("rel_path"), F.col("size")))


# --- ignore files ----------------------------------------------------------

GROUPS = "array<struct<negate: boolean, regex: string>>"


def _parsed(rules: DataFrame) -> DataFrame:
    """(rule_dir, groups) of ignore files; a table as small as there are such files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.list_(pa.struct([("negate", pa.bool_()), ("regex", pa.string())]))
        for batch in batches:
            parsed = [
                [{"negate": n, "regex": r} for n, r in ignore_groups(text or "")]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(parsed, shape)], names=["rule_dir", "groups"]
            )

    return rules.select("rule_dir", "content").mapInArrow(run, f"rule_dir string, groups {GROUPS}")


def gitignore_filter(
    files: DataFrame, root: str = "/", rule_files: DataFrame | None = None
) -> DataFrame:
    """Drop files ignored by any ``.gitignore`` between ``root`` and the file.

    Within one ignore file the last matching rule wins; a rule of a deeper file
    cannot rescue what a file higher up ignores.  The rules that apply are
    worked out once per directory, not per file, and reach the files through a
    join on their directory.  ``rule_files`` may bring the ignore files when
    ``files`` does not hold them.
    """
    rules = (
        (files if rule_files is None else rule_files)
        .where(base_name(F.col("path")) == ".gitignore")
        .where(under_path(F.col("path"), root))
        .select(dir_name(F.col("path")).alias("rule_dir"), F.col("content").cast("string").alias("content"))
    )
    # Small next to the files, and read more than once from here on.
    rules = cut_lineage(_parsed(rules).where(F.size("groups") > 0), "ignore-rules")
    directories = files.select(dir_name(F.col("path")).alias("dir")).distinct()
    lineage = directories.select(
        "dir",
        F.explode_outer(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("rule_dir"),
    ).where(under_path(F.col("rule_dir"), root))
    # Directories carry the names of their ignore files; the regexes are kept once a set.
    per_directory = (
        lookup_join(lineage, rules.select("rule_dir"), ["rule_dir"])
        .groupBy("dir")
        .agg(F.array_sort(F.collect_set("rule_dir")).alias("rule_dirs"))
    )
    per_directory = cut_lineage(per_directory, "ignore-dirs")
    sets = (
        per_directory.select("rule_dirs").distinct()
        .select("rule_dirs", F.explode("rule_dirs").alias("rule_dir"))
        .join(rules, "rule_dir")
        .groupBy("rule_dirs")
        .agg(F.collect_list(F.struct("rule_dir", "groups")).alias("rule_files"))
    )
    sets = cut_lineage(sets, "ignore-sets")

    def ignored_by(rule_file: Column) -> Column:
        rel = relative_to(F.col("path"), rule_file["rule_dir"])
        return F.aggregate(
            rule_file["groups"],
            F.lit(False),
            lambda state, g: F.when(F.regexp_like(rel, g["regex"]), ~g["negate"]).otherwise(state),
        )

    placed = files.withColumn("dir", dir_name(F.col("path")))
    placed = lookup_join(placed, per_directory, ["dir"], "left")
    ignored = F.exists(F.col("rule_files"), ignored_by)
    return (
        lookup_join(placed, sets, ["rule_dirs"], "left")
        .where(F.coalesce(~ignored, F.lit(True)))
        .drop("dir", "rule_dirs", "rule_files")
    )


# --- smaller filters -------------------------------------------------------


def text_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files without a NUL anywhere and, if asked for, no longer than ``max_bytes``."""
    has_nul = F.contains(F.col("content").cast("binary"), F.lit(bytearray(1)))
    found = files.where(~has_nul)
    return found if max_bytes is None else found.where(F.col("size") <= max_bytes)


def recent_changes(
    files: DataFrame, now: Column, minutes: int = 60, root: str = "/"
) -> DataFrame:
    """Files modified strictly after ``now - minutes`` below ``root``."""
    minutes = minutes if minutes > 0 else 60
    cutoff = now - F.make_dt_interval(mins=F.lit(minutes))
    return files.where(under_path(F.col("path"), root) & (F.col("mod_time") > cutoff)).select(
        "path", "mod_time"
    )


def keeps_turn(min_user_bytes: int) -> Column:
    """False for user turns shorter than ``min_user_bytes`` bytes; 0 keeps all."""
    return ~((F.col("role") == "user") & (F.octet_length("text") < min_user_bytes))


def filter_turns(turns: DataFrame, min_user_bytes: int = 10) -> DataFrame:
    """Drop short user turns."""
    return turns.where(keeps_turn(min_user_bytes))


def metadata_filter(chunks: DataFrame, project: str = "", language: str = "") -> DataFrame:
    """Exact project and (lower-cased) language; ``""`` means any."""
    if project:
        chunks = chunks.where(F.col("project_id") == project)
    if language:
        chunks = chunks.where(F.col("language") == language.lower())
    return chunks


def in_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files lying in or below the root of any project.

    Membership is worked out per directory; files then join on their directory.
    """
    roots = projects.select(F.col("root").alias("owner")).distinct()
    placed = files.withColumn("dir", dir_name(F.col("path")))
    directories = placed.select("dir").distinct()
    covered = lookup_join(
        directories.select(
            "dir", F.explode_outer(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("owner")
        ),
        roots,
        ["owner"],
        "left_semi",
    ).select("dir").distinct()
    covered = cut_lineage(covered, "project-dirs")
    return lookup_join(placed, covered, ["dir"], "left_semi").drop("dir")
