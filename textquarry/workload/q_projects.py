"""Queries over projects: membership, listing, discovery and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import filters, index, projects
from textquarry.workload.q_files import ANCESTORS
from textquarry.workload.registry import query


@query("list_projects", "SELECT project_id AS name, root AS path FROM projects")
def list_projects(t):
    return index.list_projects(t.projects)


@query(
    "in_project",
    """
SELECT path FROM files f
WHERE EXISTS (SELECT 1 FROM projects p WHERE f.path = p.root OR starts_with(f.path, p.root || '/'))""",
)
def in_project(t):
    return filters.in_project(t.files, t.projects).select("path")


OWNED = """
SELECT path, coalesce(
    (SELECT min_by(p.project_id, p.ord) FROM all_roots p WHERE starts_with(f.path, p.root || '/')),
    regexp_extract(path, '([^/]*)/[^/]*$', 1)) AS project_id
FROM files f"""


@query(
    "assign_project",
    f"""
WITH all_roots AS (
  SELECT project_id, root, ord FROM projects
  UNION ALL
  SELECT project_id, root, ord + 50 AS ord FROM sources WHERE project_id < 'src15'){OWNED}""",
)
def assign_project(t):
    roots = t.projects.unionByName(
        t.sources.where("project_id < 'src15'").withColumn("ord", F.col("ord") + 50)
    )
    return projects.assign_project(t.files, roots).select("path", "project_id")


@query(
    "add_project",
    """
SELECT project_id, root, ord FROM projects
UNION ALL
SELECT min(project_id) || '-1' AS project_id, '/elsewhere/' || min(project_id) AS root, max(ord) + 1 AS ord FROM projects""",
)
def add_project(t):
    """One more project, whose directory has the name of one that is there."""
    name = t.projects.agg(F.min("project_id")).first()[0]
    return projects.add_project(t.projects, f"/elsewhere/{name}/")


# The directories of the tree with what discovery needs to know about each.
DISCOVERED = f"""
WITH entries AS (
  SELECT path, false AS is_dir FROM tree_files
  UNION
  SELECT unnest({ANCESTORS}) AS path, true AS is_dir FROM tree_files),
marked AS (
  SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM entries
  WHERE regexp_extract(path, '([^/]*)$', 1) IN ('.git', 'go.mod', '.venv')),
holders AS (
  SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path, regexp_extract(path, '^/corpus/([^/]*)/', 1) AS source
  FROM tree_files WHERE path LIKE '%.code-workspace'),
folders AS (
  SELECT h.path || '/' || x.f AS path
  FROM holders h, (VALUES ('en'), ('de'), ('fr/q1')) x(f)
  WHERE h.path || '/' || x.f IN (SELECT path FROM entries WHERE is_dir)),
stops AS (
  SELECT path FROM marked
  WHERE path NOT IN (SELECT path FROM holders) AND starts_with(path, '/corpus/')
    AND len(string_split(path, '/')) - 2 <= 3
    AND regexp_extract(path, '([^/]*)$', 1) NOT IN ('.git', 'node_modules', '.venv', 'vendor', 'dist', 'build', 'tmp')
    AND NOT EXISTS (SELECT 1 FROM folders f WHERE starts_with(marked.path, f.path || '/'))),
found AS (
  SELECT path FROM stops s
  WHERE NOT EXISTS (SELECT 1 FROM stops o WHERE starts_with(s.path, o.path || '/'))
  UNION
  SELECT path FROM folders)
SELECT path, replace(substr(path, 9), '/', '-') AS name, path IN (SELECT root FROM projects) AS already_added
FROM found"""


@query("discover_projects", DISCOVERED)
def discover_projects(t):
    options = projects.Discovery(git=True, go=True, venv=True, workspace=True, depth=3)
    return projects.discover_projects(t.tree_files, "/corpus", options, t.projects)


@query(
    "discover_top_level",
    """
SELECT DISTINCT '/corpus/' || source AS path, source AS name, false AS already_added FROM documents""",
)
def discover_top_level(t):
    return projects.discover_projects(t.tree_files, "/corpus")


# Names are handed out one after the other; in SQL that needs recursion, which
# over all documents would be slow, so the oracle uses that here no name made
# up for one project is another's own: the n-th namesake takes the n-th free name.
@query(
    "unique_names",
    """
WITH wanted AS (SELECT doc_id AS ord, source || '-' || lang AS base FROM documents),
taken AS (
  SELECT source || '-' || lang AS base, CAST(substr(source, 4) AS BIGINT) AS t
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND source <> 'src0'
  UNION
  SELECT source || '-' || lang, 0 FROM documents WHERE n_chars > 3000),
numbered AS (SELECT ord, base, row_number() OVER (PARTITION BY base ORDER BY ord) - 1 AS idx FROM wanted),
free AS (
  SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) - 1 AS idx
  FROM (SELECT DISTINCT base FROM wanted) b,
       (SELECT unnest(range((SELECT count(*) FROM documents) + 50)) AS n) r
  WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE k.base = b.base AND k.t = r.n))
SELECT w.ord, w.base || CASE WHEN f.n = 0 THEN '' ELSE '-' || f.n END AS name
FROM numbered w JOIN free f ON f.base = w.base AND f.idx = w.idx""",
)
def unique_names(t):
    base = F.concat_ws("-", "source", "lang")
    wanted = t.documents.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("path"), base.alias("name")
    )
    numbered = t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select(
        F.concat(base, F.lit("-"), F.substring("source", 4, 9)).alias("name")
    )
    # A suffix 0 is never handed out, so such names leave the free ones alone.
    existing = numbered.union(t.documents.where("n_chars > 3000").select(base))
    return projects.unique_names(wanted, existing).select("ord", "name")
