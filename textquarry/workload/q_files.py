"""Queries over files: scanning, filtering, listing, line search, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.paths import matches_any, relative_to, under_path
from textquarry.operators import filters, grep, listing
from textquarry.plans.joins import cut_lineage
from textquarry.session import scratch_path
from textquarry.sources import sessions
from textquarry.sources.files import file_rows, read_contents, scan_project
from textquarry.sources.tree import file_system, list_tree
from textquarry.workload.registry import query

LAST_ELEMENT = r"regexp_extract(path, '([^/]*)$', 1)"
EXTENSION = rf"regexp_extract(lower({LAST_ELEMENT}), '(\.[^.]*)$', 1)"
# Ancestor directories of a path as a DuckDB list, '/' first.
ANCESTORS = (
    "list_transform(range(1, len(string_split(path, '/'))), lambda n: CASE WHEN n = 1 THEN '/' "
    "ELSE array_to_string(list_slice(string_split(path, '/'), 1, n), '/') END)"
)


def write_tree(files):
    """Write ``path, content`` as a tree of real files; returns its root."""
    root = scratch_path(files.sparkSession, "tree")

    def write(batches):
        system, top = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                place = top + row["path"]
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place, compression=None) as out:
                    out.write(row["content"].encode())
            yield batch.select(["path"])

    rows = files.select("path", "content")
    rows.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


def written_tree(t):
    """The files of the view as real files, with an ignore file in one directory."""
    ignore = t.files.limit(1).select(F.lit("/corpus/src1/.gitignore").alias("path"), F.lit("en/\n").alias("content"))
    return write_tree(t.files.select("path", "content").unionByName(ignore)) + "/corpus"


SCANNED = ["project_id", "path", "rel_path", "content", "size", "file_hash"]


def scanned(files):
    """Scanned files under the names of the view."""
    files = files.withColumn("path", F.concat(F.lit("/corpus/"), "rel_path"))
    return files.withColumn("project_id", F.split_part("rel_path", F.lit("/"), F.lit(1))).select(*SCANNED)


@query(
    "file_scan",
    """
SELECT source AS project_id, path, substr(path, 9) AS rel_path, content,
       CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS file_hash
FROM (SELECT project_id AS source, path, content FROM files) f""",
)
def file_scan(t):
    """All files of a tree on disk: listed, then read by the tasks."""
    root = written_tree(t)
    listing = list_tree(t.spark, root).where(~F.endswith("path", F.lit(".gitignore")))
    return scanned(file_rows(read_contents(cut_lineage(listing, "listing"), root), "", file_system(root)[1]))


@query(
    "scan_project",
    """
SELECT project_id, path, substr(path, 9) AS rel_path, content,
       CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS file_hash
FROM files WHERE lower(path) SIMILAR TO '.*[.](md|py)' AND NOT starts_with(path, '/corpus/src1/en/')""",
)
def scanned_project(t):
    """Indexable files of a tree on disk, by rules and ignore files."""
    return scanned(scan_project(t.spark, "", written_tree(t)))


@query("text_files", "SELECT path, size FROM files WHERE NOT path LIKE '%7'")
def text_files(t):
    """Every seventh-named file gets a NUL at its very end."""
    binary = F.when(F.endswith("path", F.lit("7")), F.concat("content", F.lit("\u0000")))
    files = t.files.withColumn("content", F.coalesce(binary, "content"))
    return filters.text_files(files).select("path", "size")


RULES = filters.IndexRules(
    extensions=(".md", ".PY"),
    include=("src1*/**", "src2/**", "src3/en/**"),
    exclude=("**/doc_*7.md", "src12", "**/fr/doc_[1-3]*", "SRC2/**"),
    max_file_size_mb=1,
)


@query(
    "index_filter",
    rf"""
SELECT path, size
FROM (SELECT path, size, lower(substr(path, 9)) AS rel FROM files) f
WHERE regexp_matches(rel, '^(src1[^/]*(/.*)?|src2(/.*)?|src3/en(/.*)?)$')
  AND NOT regexp_matches(rel, '^((.*/)?doc_[^/]*7\.md|src12|src12/.*|(.*/)?fr/doc_[1-3][^/]*)$')
  AND {EXTENSION} IN ('.md', '.py') AND size <= 1048576""",
)
def index_filter(t):
    rel = relative_to(F.col("path"), F.lit("/corpus"))
    placed = t.files.withColumn("rel_path", rel)
    return filters.index_filter(placed, RULES).select("path", "size")


@query(
    "glob_match",
    r"""
SELECT path,
       regexp_matches(path, '^/corpus/[^/]*/en/[^/]*$') AS one_level,
       regexp_matches(path, '^(.*/)?(de|es)/[^/]*\.md$') AS either,
       regexp_matches(path, '^/corpus/src[0-4](/.*)?$') AS subtree,
       regexp_matches(path, '^/corpus/src1[^/]/(.*/)?doc_[^/][^/]$') AS singles
FROM files""",
)
def glob_match(t):
    path = F.col("path")
    return t.files.select(
        "path",
        matches_any(path, ["/corpus/*/en/*"]).alias("one_level"),
        matches_any(path, ["**/{de,es}/*.md"]).alias("either"),
        matches_any(path, ["/corpus/src[0-4]/**", "broken["]).alias("subtree"),
        matches_any(path, ["/corpus/src1?/**/doc_??"]).alias("singles"),
    )


@query(
    "gitignore_filter",
    r"""
WITH hits AS (
  SELECT path, substr(path, 9) AS rel, string_split(path, '/') AS parts FROM ignore_files),
levels AS (
  SELECT path, rel,
         substr(rel, length(parts[3]) + 2) AS rel_source,
         substr(rel, length(parts[3]) + length(coalesce(parts[4], '')) + 3) AS rel_lang,
         '/corpus/' || parts[3] || '/.gitignore' AS source_file,
         '/corpus/' || parts[3] || '/' || coalesce(parts[4], '') || '/.gitignore' AS lang_file
  FROM hits),
present AS (SELECT path AS rule FROM ignore_files WHERE path LIKE '%/.gitignore')
SELECT path FROM levels
WHERE NOT (
      regexp_matches(rel, '\.MD$')
   OR regexp_matches(rel, '^src1/de/')
   OR regexp_matches(rel, '(^|/)doc_[^/]\.md$')
   OR regexp_matches(rel, '^src2/(.*/)?doc_[^/]*7\.txt$')
   OR regexp_matches(rel, '^src3/fr(/|$)')
   OR regexp_matches(rel, '(^|/)#doc(/|$)')
   OR regexp_matches(rel, '(^|/)doc_[^1-7/][^/]\.py$')
   OR regexp_matches(rel, '(^|/)src4/(.*/)?doc_1[^/]*$'))
  AND NOT (source_file IN (SELECT rule FROM present) AND (
      CASE WHEN regexp_matches(rel_source, '(^|/)es(/|$)') THEN true
           WHEN regexp_matches(rel_source, '(^|/)doc_1[^/]*\.txt$') THEN false
           WHEN regexp_matches(rel_source, '(^|/)doc_1[^/]*$') THEN true
           WHEN regexp_matches(rel_source, '(^|/)doc_[^/]*2\.py$') THEN false
           ELSE regexp_matches(rel_source, '^fr/[^/]*\.py$') END))
  AND NOT (lang_file IN (SELECT rule FROM present) AND (
      CASE WHEN regexp_matches(rel_lang, '(^|/)doc_[^/]*6\.txt$') THEN false
           ELSE regexp_matches(rel_lang, '\.txt$') END))""",
)
def gitignore_filter(t):
    return filters.gitignore_filter(t.ignore_files, "/corpus").select("path")


@query(
    "path_prefix",
    """
SELECT path, path = '/corpus/src1' OR starts_with(path, '/corpus/src1/') AS in_src1,
       true AS in_root, path = '/corpus' OR starts_with(path, '/corpus/') AS in_corpus
FROM files""",
)
def path_prefix(t):
    path = F.col("path")
    return t.files.select(
        "path",
        under_path(path, "/corpus/src1").alias("in_src1"),
        under_path(path, "/").alias("in_root"),
        under_path(path, "/corpus").alias("in_corpus"),
    )


@query(
    "recent_changes",
    """
SELECT path, CAST(mod_time AS VARCHAR) AS modified FROM files
WHERE mod_time > (SELECT max(mod_time) FROM files) - INTERVAL 90 MINUTE""",
)
def recent_changes(t):
    newest = t.files.agg(F.max("mod_time")).first()[0]
    now = F.lit(newest).cast("timestamp_ntz")
    found = filters.recent_changes(t.files, now, minutes=90)
    return found.select("path", F.col("mod_time").cast("string").alias("modified"))


@query(
    "filter_turns",
    """
SELECT conv_id, turn, role, text FROM conversations
WHERE NOT (role = 'user' AND strlen(text) < 80)""",
)
def filter_turns(t):
    return filters.filter_turns(t.conversations, 80).select("conv_id", "turn", "role", "text")


@query(
    "detect_language",
    f"""
SELECT path, CASE {EXTENSION}
    WHEN '.go' THEN 'go' WHEN '.py' THEN 'python'
    WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript'
    WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript'
    WHEN '.rs' THEN 'rust' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown'
    ELSE '' END AS language
FROM (SELECT path FROM files UNION ALL SELECT path FROM code_files) f""",
)
def detect_language(t):
    paths = t.files.select("path").unionByName(t.code_files.select("path"))
    return paths.select("path", T.detect_language(F.col("path")).alias("language"))


@query("chunk_id", "SELECT path, sha256(path || chr(10) || content) AS chunk_id FROM files")
def chunk_id(t):
    return t.files.select("path", T.chunk_id(F.col("path"), F.col("content")).alias("chunk_id"))


@query(
    "guess_symbol",
    r"""
SELECT path, line_no, regexp_extract(line,
       '(?:func|def|fn|class|struct|enum|trait|impl|type|const|var)\s+(\w+)', 1) AS symbol
FROM (SELECT path, unnest(string_split(content, chr(10))) AS line,
             generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM code_files) l
WHERE line <> ''""",
)
def guess_symbol(t):
    lines = t.code_files.select("path", F.posexplode_outer(T.lines(F.col("content"))).alias("i", "line"))
    return lines.where("line <> ''").select(
        "path",
        (F.col("i") + 1).cast("bigint").alias("line_no"),
        T.guess_symbol(F.col("line")).alias("symbol"),
    )


@query(
    "slugify",
    r"""
SELECT doc_id, CASE WHEN slug = '' THEN 'note' ELSE slug END AS slug
FROM (SELECT doc_id, substr(trim(regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
             '[^a-z0-9-]', '-', 'g'), '-'), 1, 60) AS slug FROM documents) s""",
)
def slugify(t):
    return t.documents.select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(
    "printable_strings",
    r"""
SELECT doc_id, n, run
FROM (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) - 1 AS n
      FROM (SELECT doc_id, regexp_extract_all(text, '[\t\n\r -~]{4,}') AS runs FROM documents) r) x""",
)
def printable_strings(t):
    runs = T.printable_runs(F.col("text"))
    return t.documents.select("doc_id", F.posexplode_outer(runs).alias("n", "run")).where(
        "n IS NOT NULL"
    ).select(
        "doc_id", F.col("n").cast("bigint").alias("n"), "run"
    )


@query(
    "line_ranges",
    """
SELECT path, start_line, end_line,
       CASE WHEN content IS NULL OR first > last THEN ''
            ELSE array_to_string(list_slice(lines, first, last), chr(10)) END AS text,
       CASE WHEN content IS NULL THEN 'not_found' WHEN first > last THEN 'invalid_range' ELSE 'ok' END AS status
FROM (
  SELECT r.path, r.start_line, r.end_line, f.content, string_split(f.content, chr(10)) AS lines,
         greatest(r.start_line, 1) AS first,
         CASE WHEN r.end_line <= 0 OR r.end_line > len(string_split(f.content, chr(10)))
              THEN len(string_split(f.content, chr(10))) ELSE r.end_line END AS last
  FROM (SELECT path, CAST(size % 7 - 1 AS INT) AS start_line, CAST(size % 5 AS INT) AS end_line FROM files
        UNION ALL
        SELECT '/corpus/old/page_' || CAST(page_id AS VARCHAR), 1, 2 FROM pages) r
  LEFT JOIN files f ON f.path = r.path) x""",
)
def line_ranges(t):
    ranges = t.files.select(
        "path",
        (F.col("size") % 7 - 1).cast("int").alias("start_line"),
        (F.col("size") % 5).cast("int").alias("end_line"),
    ).unionByName(
        t.pages.select(
            F.concat(F.lit("/corpus/old/page_"), F.col("page_id").cast("string")).alias("path"),
            F.lit(1).alias("start_line"),
            F.lit(2).alias("end_line"),
        )
    )
    return grep.line_ranges(t.files, ranges)


LINES = """
SELECT path, unnest(string_split(content, chr(10))) AS content,
       CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line
FROM files"""


@query(
    "grep_substring",
    f"""
SELECT path, line, content FROM ({LINES}) l WHERE contains(content, 'tion ')
ORDER BY string_split(path, '/'), line LIMIT 20""",
)
def grep_substring(t):
    return grep.grep(t.files, "tion ")


@query(
    "grep_regex",
    rf"""
SELECT path, line, content FROM ({LINES}) l
WHERE regexp_matches(content, '^[A-Z][a-z]+ .*(ing|heit)\b') AND starts_with(path, '/corpus/')""",
)
def grep_regex(t):
    return grep.grep_lines(t.files, r"^[A-Z][a-z]+ .*(ing|heit)\b", regex=True, root="/corpus")


@query(
    "list_files",
    rf"""
WITH below AS (SELECT path FROM tree_files WHERE starts_with(path, '/corpus/')),
entries AS (
  SELECT path FROM below
  UNION
  SELECT unnest({ANCESTORS}) AS path FROM below)
SELECT path FROM entries
WHERE starts_with(path, '/corpus/') AND regexp_matches(substr(path, 9), '^(.*/)?(en|de)[^/]*(/[^/]*\.md)?$')
  AND (regexp_matches(substr(path, 9), '^(.*/)?en[^/]*$') OR regexp_matches(substr(path, 9), '^(.*/)?de/[^/]*\.md$'))""",
)
def list_files(t):
    return listing.list_files(
        t.tree_files, "/corpus", "{**/en*,**/de/*.md}", include_dirs=True
    )


@query(
    "directory_tree",
    f"""
WITH entries AS (
  SELECT path, 'file' AS type FROM tree_files
  UNION
  SELECT unnest({ANCESTORS}) AS path, 'dir' AS type FROM tree_files)
SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, type,
       CAST(len(string_split(path, '/')) - 2 AS INT) AS depth
FROM entries
WHERE starts_with(path, '/corpus/') AND len(string_split(path, '/')) - 2 <= 3""",
)
def directory_tree(t):
    return listing.directory_tree(t.tree_files, "/corpus")


NOTE_SQL = """
SELECT 'memory-' || provider AS project_id,
       '/memory/' || strftime(saved_at, '%Y%m%d-%H%M%S') || '-' || CASE WHEN slug = '' THEN 'note' ELSE slug END || '.md' AS path,
       '# ' || title || chr(10) || chr(10) || '- **Provider:** ' || provider || chr(10)
         || CASE WHEN tags <> '' THEN '- **Tags:** ' || replace(tags, ',', ', ') || chr(10) ELSE '' END
         || '- **Saved:** ' || strftime(saved_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || chr(10) || content || chr(10) AS content
FROM (SELECT *, substr(trim(regexp_replace(lower(trim(title)), '[^a-z0-9-]', '-', 'g'), '-'), 1, 60) AS slug
      FROM (SELECT title, content, tags, saved_at,
                   CASE WHEN provider = '' THEN 'cascade' ELSE provider END AS provider FROM notes) a) b"""


def note_files(t):
    tags = F.filter(F.split("tags", ","), lambda x: x != "")
    return sessions.notes_to_files(t.notes.withColumn("tags", tags))


@query("notes_markdown", NOTE_SQL)
def notes_markdown(t):
    return note_files(t).drop("mod_time")


@query(
    "memory_list",
    f"""
SELECT path, provider FROM (
  SELECT path, CASE WHEN contains(content, '- **Provider:** cursor') THEN 'cursor' ELSE 'cascade' END AS provider
  FROM ({NOTE_SQL}) n) p
WHERE provider = 'cascade'""",
)
def memory_list(t):
    return sessions.memory_list(note_files(t))


@query(
    "dedupe_strings",
    r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_n) - 1 AS BIGINT) AS n, line
FROM (SELECT doc_id, line, min(n) AS first_n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) l
      GROUP BY doc_id, line) d""",
)
def dedupe_strings(t):
    distinct = sessions.dedupe_strings(T.lines(F.col("text")))
    return t.documents.select("doc_id", F.posexplode_outer(distinct).alias("n", "line")).select(
        "doc_id", F.col("n").cast("bigint").alias("n"), "line"
    )
