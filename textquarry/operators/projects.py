"""Projects: which one a file belongs to, finding new ones, naming them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.paths import (
    ancestors,
    base_name,
    depth_below,
    dir_name,
    relative_to,
    self_and_ancestors,
    under_path,
    walk_key,
)
from textquarry.operators.listing import directories_of
from textquarry.plans.joins import cut_lineage, lookup_join, running

# Directories that are never projects themselves.
SKIPPED_NAMES = (".git", "node_modules", ".venv", "vendor", "dist", "build", "tmp")
WORKSPACE_SUFFIX = ".code-workspace"
ORDER_BLOCK = 100_000


def assign_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Set ``project_id`` to the first listed project whose root holds the file.

    ``projects`` has ``project_id, root, ord``.  A file outside every root
    belongs to a project named after its directory.
    """
    placed = files.drop("project_id").withColumn("dir", dir_name(F.col("path")))
    owners = projects.select(
        F.col("project_id").alias("owner"), F.col("root").alias("up"), "ord"
    )
    per_directory = (
        lookup_join(
            placed.select("dir").distinct().select(
                "dir", F.explode_outer(self_and_ancestors(F.col("dir"))).alias("up")
            ),
            owners,
            ["up"],
        )
        .groupBy("dir")
        .agg(F.min_by("owner", F.struct("ord", "owner")).alias("owner"))
    )
    per_directory = cut_lineage(per_directory, "owners")
    own_name = F.when(F.col("dir") == "/", "/").otherwise(base_name(F.col("dir")))
    return (
        lookup_join(placed, per_directory, ["dir"], "left")
        .withColumn("project_id", F.coalesce("owner", own_name))
        .drop("owner", "dir")
    )


# --- names -----------------------------------------------------------------


def _candidate(base: Column, pos: Column) -> Column:
    return F.when(pos == 0, base).otherwise(F.concat(base, F.lit("-"), pos.cast("string")))


def unique_names(projects: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every project a name nobody else has.

    ``projects`` has ``ord, path, name``, ``existing`` the taken ``name``s.  In
    the order of ``ord`` each project gets its name or the first free one of
    ``name-1``, ``name-2``, …  A name another project of the list is born with
    can also be made up for an earlier one.

    First every project takes the free name its position among its namesakes
    points to.  Projects then only collide where one's own name is another's
    made-up one; the earlier keeps it, the later moves on, until nobody moves.
    """
    rows = projects.select("ord", "path", F.col("name").alias("base"))
    order_block = F.floor(F.col("ord") / ORDER_BLOCK)
    numbered = running(rows, ["base"], ["ord"], order_block, F.lit(1), "n").withColumn(
        "idx", (F.col("n") - 1).cast("bigint")
    ).drop("n")

    # Positions of the list base, base-1, base-2, … that are taken already.
    taken_names = existing.select("name").distinct()
    suffix = r"(?s)^(.*)-([1-9][0-9]{0,17})$"
    taken = taken_names.select(
        F.explode(
            F.array(
                F.struct(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("t")),
                F.struct(
                    F.regexp_extract("name", suffix, 1).alias("base"),
                    F.regexp_extract("name", suffix, 2).try_cast("bigint").alias("t"),
                ),
            )
        ).alias("x")
    ).select("x.*").where(F.col("t").isNotNull())
    taken = lookup_join(taken, rows.select("base").distinct(), ["base"], "left_semi", measure=False)
    ranked = running(
        taken, ["base"], ["t"], F.floor(F.col("t") / ORDER_BLOCK), F.lit(1), "r"
    )
    # Free positions before t are t - (r - 1): everything from there on moves up by one.
    steps = ranked.select("base", (F.col("t") - F.col("r") + 1).alias("idx"), F.lit(1).alias("step"))
    merged = numbered.withColumn("step", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    placed = (
        running(
            merged.withColumn("_item", 1 - F.col("step")), ["base"], ["idx", "_item"],
            F.floor(F.col("idx") / ORDER_BLOCK), F.col("step"), "moved",
        )
        .where(F.col("step") == 0)
        .select("ord", "path", "base", "idx", (F.col("idx") + F.col("moved")).alias("pos"))
    )

    while True:
        state = cut_lineage(placed.withColumn("name", _candidate(F.col("base"), F.col("pos"))), "names")
        holders = (
            state.select("name", "ord")
            .unionByName(taken_names.select("name", F.lit(-1).cast("bigint").alias("ord")))
            .groupBy("name")
            .agg(F.min("ord").alias("holder"), F.count("*").alias("claims"))
            .where(F.col("claims") > 1)
        )
        losing = state.join(holders, "name").where(F.col("ord") > F.col("holder"))
        losing = cut_lineage(losing.select("ord", "base"), "losing")
        if losing.isEmpty():
            return state.select("ord", "path", "name")
        moved = (
            state.join(losing.select("ord", F.lit(1).alias("lost")), "ord", "left")
            .withColumn("pos", F.col("pos") + F.coalesce("lost", F.lit(0)))
        )
        # Namesakes keep their order: each is at least one behind the one before.
        placed = running(
            moved, ["base"], ["idx"], F.floor(F.col("idx") / ORDER_BLOCK),
            F.col("pos") - F.col("idx"), "shift", largest=True,
        ).select("ord", "path", "base", "idx", (F.col("idx") + F.col("shift")).alias("pos"))


def add_project(projects: DataFrame, root: str, name: str = "") -> DataFrame:
    """Projects with one more, named after its directory unless told otherwise.

    The name is made unique; a root that is already listed is an error.
    """
    root = root.rstrip("/") or "/"
    if not projects.where(F.col("root") == root).isEmpty():
        raise ValueError(f"a project with root {root!r} already exists")
    spark = projects.sparkSession
    asked = spark.createDataFrame(
        [(0, root, name or base_of(root))], "ord bigint, path string, name string"
    )
    named = unique_names(asked, projects.select(F.col("project_id").alias("name")))
    last = projects.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    return projects.unionByName(
        named.select(
            F.col("name").alias("project_id"), F.col("path").alias("root"),
            F.lit(last + 1).cast("bigint").alias("ord"),
        )
    )


# --- discovery -------------------------------------------------------------


@dataclass(frozen=True)
class Discovery:
    """What makes a directory a project; with no flag every top directory is one."""

    git: bool = False
    go: bool = False
    node_modules: bool = False
    venv: bool = False
    workspace: bool = False
    depth: int = 1

    def markers(self) -> list[str]:
        named = {
            ".git": self.git, "go.mod": self.go, "node_modules": self.node_modules,
            ".venv": self.venv,
        }
        return [name for name, on in named.items() if on]


def _clean(path: Column) -> Column:
    """Absolute path without ``.``, ``..`` and empty elements."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def _project_name(path: Column, root: str) -> Column:
    """Root-relative path with ``-`` for ``/``; the base name for the root itself."""
    parts = root.strip("/").split("/") if root != "/" else []
    rel = F.concat(F.lit("../" * len(parts)), relative_to(path, F.lit("/")))
    for n in range(1, len(parts) + 1):
        upper = "/" + "/".join(parts[:n])
        up = "../" * (len(parts) - n)
        rel = F.when(
            under_path(path, upper) & (path != upper),
            F.concat(F.lit(up), relative_to(path, F.lit(upper))),
        ).when(path == upper, F.lit(up.rstrip("/") or base_of(root))).otherwise(rel)
    return F.replace(rel, F.lit("/"), F.lit("-"))


def base_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1] or "/"


def workspace_folders(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Folders named by the first workspace file of each directory.

    Output ``workspace, folder``; folders must exist.  Unreadable files name none.
    """
    first = (
        files.where(F.endswith(base_name(F.col("path")), F.lit(WORKSPACE_SUFFIX)))
        .groupBy(dir_name(F.col("path")).alias("workspace"))
        .agg(F.min_by("content", "path").alias("content"))
    )
    listed = F.from_json(F.col("content").cast("string"), "folders array<struct<name:string,path:string>>")
    place = F.col("f.path")
    named = (
        first.select("workspace", F.explode_outer(listed["folders"]).alias("f"))
        .where(F.coalesce(place, F.lit("")) != "")
        .select(
            "workspace",
            _clean(
                F.when(F.startswith(place, F.lit("/")), place).otherwise(
                    F.concat(F.col("workspace"), F.lit("/"), place)
                )
            ).alias("path"),
        )
        .distinct()
    )
    return named.join(directories.select("path"), "path", "left_semi").select(
        "workspace", F.col("path").alias("folder")
    )


def _hidden(paths: DataFrame, stops: DataFrame, *, at_stop: bool) -> DataFrame:
    """Paths that lie below a stop (``at_stop``: or on it)."""
    up = self_and_ancestors(F.col("path")) if at_stop else ancestors(F.col("path"))
    exploded = paths.select("path", F.explode_outer(up).alias("stop"))
    return lookup_join(
        exploded, stops.select(F.col("path").alias("stop")).distinct(), ["stop"], "left_semi"
    ).select("path").distinct()


def _without(paths: DataFrame, gone: DataFrame) -> DataFrame:
    return paths.join(gone, "path", "left_anti")


def _mark(paths: DataFrame) -> tuple:
    """Count and order-free digest of some paths."""
    return tuple(paths.agg(F.count("*"), F.bit_xor(F.xxhash64("path")), F.bit_xor(F.xxhash64(F.lit(1), "path"))).first())


def _directory_facts(files: DataFrame, options: Discovery) -> DataFrame:
    """Every directory once: ``path, marked, workspace``.

    ``marked``: it holds a marker file or directory; ``workspace``: it holds a
    workspace file.  One pass over the paths, written out because discovery
    looks at it several times.
    """
    name = base_name(F.col("path"))
    parent = dir_name(F.col("path"))
    marker = name.isin(*options.markers()) if options.markers() else F.lit(False)
    holds_workspace = F.endswith(name, F.lit(WORKSPACE_SUFFIX))
    directories = directories_of(files)
    said = (
        files.select(
            parent.alias("path"), marker.alias("marked"), holds_workspace.alias("workspace")
        )
        .unionByName(
            directories.select(
                parent.alias("path"), marker.alias("marked"), F.lit(False).alias("workspace")
            )
        )
        .where(F.col("marked") | F.col("workspace"))
        .unionByName(
            directories.select(
                "path", F.lit(False).alias("marked"), F.lit(False).alias("workspace")
            )
        )
    )
    facts = said.groupBy("path").agg(
        F.bool_or("marked").alias("marked"), F.bool_or("workspace").alias("workspace")
    )
    return cut_lineage(facts, "directories")


def discover_projects(
    files: DataFrame, root: str, options: Discovery = Discovery(), existing: DataFrame | None = None
) -> DataFrame:
    """Directories below ``root`` that look like projects.

    Output ``path, name, already_added``.  Directories are visited from the top
    down to ``options.depth``; a project hides everything below it, and one
    named by a workspace file hides what is visited after that file.
    """
    root = root.rstrip("/") or "/"
    depth = options.depth or 1
    name = base_name(F.col("path"))
    at_root = F.col("path") == root
    level = F.when(at_root, 0).otherwise(depth_below(F.col("path"), root))

    def visitable(dirs: DataFrame) -> DataFrame:
        inside = dirs.where(under_path(F.col("path"), root)).where(level <= depth)
        return inside.where(~name.isin(*SKIPPED_NAMES))

    if not (options.markers() or options.workspace):
        above = F.split(relative_to(F.col("path"), F.lit(root)), "/", -1)
        passed = F.forall(
            F.slice(above, 1, F.size(above) - 1), lambda x: x.isin(*SKIPPED_NAMES)
        )
        found = visitable(directories_of(files)).where(~at_root & passed)
    else:
        directories = _directory_facts(files, options)
        open_dirs = visitable(directories)
        stops = open_dirs.where(F.col("marked") & ~F.col("workspace")).select("path")
        if options.workspace:
            holders = open_dirs.where("workspace").select("path")
            holders = cut_lineage(
                _without(holders, _hidden(holders, stops, at_stop=False)), "workspaces"
            )
            folders = cut_lineage(workspace_folders(files, directories), "folders")
            visited, now = holders, _mark(holders)
            while True:  # once per link of workspaces that hide each other's folders
                listed = folders.join(
                    visited.select(F.col("path").alias("workspace")), "workspace", "left_semi"
                )
                seen = listed.where(
                    (walk_key(F.col("workspace")) < walk_key(F.col("folder")))
                    & ~base_name(F.col("folder")).isin(*SKIPPED_NAMES)
                ).select(F.col("folder").alias("path")).distinct()
                hidden = _hidden(holders, seen, at_stop=True)
                kept = cut_lineage(_without(holders, hidden), "visited")
                before, now = now, _mark(kept)
                if now == before:
                    break
                visited = kept
            stops = cut_lineage(_without(stops, _hidden(stops, seen, at_stop=True)), "stops")
            found = _without(stops, _hidden(stops, stops, at_stop=False)).unionByName(
                listed.select(F.col("folder").alias("path"))
            ).distinct()
        else:
            found = _without(stops, _hidden(stops, stops, at_stop=False))

    found = found.where(~at_root).select(
        "path", _project_name(F.col("path"), root).alias("name")
    )
    if existing is None:
        return found.withColumn("already_added", F.lit(False))
    known = existing.select(F.col("root").alias("path"), F.lit(True).alias("known")).distinct()
    return found.join(known, "path", "left").select(
        "path", "name", F.coalesce("known", F.lit(False)).alias("already_added")
    )
