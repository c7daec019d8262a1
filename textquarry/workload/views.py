"""Views over the given tables, in SQL both engines run.

Every view covers its whole source table; modulo only spreads attributes (a
file suffix, a language) over the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}


@dataclass(frozen=True)
class Dialect:
    name: str
    byte_length: str
    timestamp: str

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.name == "spark" else f"sha256({text})"

    def minutes(self, count: str) -> str:
        return f"CAST('2024-01-01 00:00:00' AS {self.timestamp}) + INTERVAL '1' MINUTE * {count}"


SPARK = Dialect("spark", "octet_length", "TIMESTAMP_NTZ")
DUCK = Dialect("duck", "strlen", "TIMESTAMP")


def text_of(column: str) -> str:
    return f"CAST({column} AS VARCHAR(40))"


DOC_PATH = (
    "'/corpus/' || source || '/' || lang || '/doc_' || " + text_of("doc_id") + " || "
    "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.md' WHEN 1 THEN '.txt' "
    "WHEN 2 THEN '.py' WHEN 3 THEN '.MD' ELSE '' END"
)


def files(d: Dialect) -> str:
    """One file per document."""
    return f"""
SELECT project_id, path, substring(path, 9) AS rel_path, content, size, mod_time, file_hash
FROM (SELECT source AS project_id, {DOC_PATH} AS path, text AS content,
             CAST({d.byte_length}(text) AS BIGINT) AS size,
             {d.minutes('doc_id')} AS mod_time, {d.sha('text')} AS file_hash
      FROM documents) x"""


def md_files(d: Dialect) -> str:
    """Documents as Markdown: every sentence opens a section, some of them bare."""
    content = (
        "'# Document ' || " + text_of("doc_id") + " || chr(10) || chr(10) || "
        "replace(replace(text, '. ', '.' || chr(10) || chr(10) || '## '), '? ', "
        "'?' || chr(10) || '#' || chr(10))"
    )
    return f"""
SELECT project_id, path, content, {d.sha('content')} AS file_hash
FROM (SELECT source AS project_id, '/notes/' || source || '/doc_' || {text_of('doc_id')} || '.md' AS path,
             {content} AS content
      FROM documents) x"""


def code_files(d: Dialect) -> str:
    """A source file per part, in the language its size picks."""
    key, size = text_of("p_partkey"), text_of("p_size")
    go = (
        f"concat('package parts', chr(10), chr(10), '// ', p_name, chr(10), 'func Part', {key}, '() int {{', chr(10), "
        f"chr(9), 'return ', {size}, chr(10), '}}', chr(10), chr(10), 'type T', {key}, ' struct {{', chr(10), '}}', chr(10), "
        f"'func (t *T', {key}, ') Name(', chr(10), chr(9), 's string,', chr(10), ') string {{', chr(10), 'func inner() {{', chr(10), '}}', chr(10), "
        f"'type Alias', {key}, ' = int', chr(10))"
    )
    py = (
        f"concat('import os', chr(10), chr(10), '@cached', chr(10), 'def part_', {key}, '(', chr(10), '    x,', chr(10), '):', chr(10), "
        f"'    return ', {size}, chr(10), chr(10), chr(10), 'class P', {key}, ':', chr(10), '    def name(self):', chr(10), "
        f"'        return \"', p_name, '\"', chr(10), chr(10), 'LIMIT = ', {size}, chr(10), 'async def tail():', chr(10), '    pass   ', chr(10), "
        f"'if LIMIT:', chr(10), '    def under_', {key}, '(a):', chr(10), '        class Deep:', chr(10), '            pass', chr(10), "
        f"'    again = 1', chr(10), 'else:', chr(10), chr(9), 'class Other(', chr(10), chr(9), '): pass', chr(10))"
    )
    ts = (
        f"concat('// ', p_name, chr(10), 'export class Part', {key}, ' {{', chr(10), '  size = ', {size}, ';', chr(10), '}}', chr(10), "
        f"'export const SIZE', {key}, ' = ', {size}, ';', chr(10), 'function make', {key}, '() {{', chr(10), '  return 1;', chr(10), '}}', chr(10), "
        f"'const table = {{', chr(10), '  size: ', {size}, ',', chr(10), '  async total(a, b) {{', chr(10), '    if (a) {{', chr(10), "
        f"'      return b;', chr(10), '    }}', chr(10), '  }},', chr(10), '}};', chr(10), 'if (table) {{', chr(10), '  while (x) {{', chr(10), "
        f"'    function late_', {key}, '() {{', chr(10), '    }}', chr(10), '  }}', chr(10), '}}', chr(10))"
    )
    rs = (
        f"concat('use std::fmt;', chr(10), 'pub struct Part', {key}, ' {{', chr(10), '    size: u32,', chr(10), '}}', chr(10), "
        f"'impl Part', {key}, ' {{', chr(10), '    fn get() {{}}', chr(10), '}}', chr(10), 'mod tests {{', chr(10), '    use super::*;', chr(10), '    fn check_', {key}, '() {{', chr(10), '        fn deep() {{', chr(10), "
        f"'        }}', chr(10), '    }}', chr(10), '}}', chr(10), 'pub(crate) fn open_', {key}, '() {{', chr(10), '    1')"
    )
    return f"""
SELECT project_id, path, content, {d.sha('content')} AS file_hash,
       CAST({d.byte_length}(content) AS BIGINT) AS size
FROM (SELECT 'code' || {text_of('p_partkey % 7')} AS project_id,
             '/code/p' || {text_of('p_partkey % 7')} || '/part_' || {key}
               || CASE WHEN p_size <= 20 THEN '.go' WHEN p_size <= 30 THEN '.py' WHEN p_size <= 40 THEN '.ts' ELSE '.rs' END AS path,
             CASE WHEN p_size <= 20 THEN {go} WHEN p_size <= 30 THEN {py} WHEN p_size <= 40 THEN {ts} ELSE {rs} END AS content
      FROM part) x"""


def file_state(d: Dialect) -> str:
    """An earlier index: labelled documents, of which those of low quality have
    changed since, and pages that are gone."""
    return f"""
SELECT {DOC_PATH} AS path, source AS project_id,
       CASE WHEN quality = 1 THEN {d.sha('text')} ELSE {d.sha("'before'")} END AS file_hash,
       {d.minutes('doc_id')} AS indexed_at
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT '/corpus/old/page_' || {text_of('page_id')} || '.md' AS path, 'old' AS project_id,
       {d.sha('url')} AS file_hash, {d.minutes('page_id')} AS indexed_at
FROM pages"""


def projects(d: Dialect) -> str:
    """A project per source and language that has a toxic document."""
    return """
SELECT source || '-' || lang AS project_id, '/corpus/' || source || '/' || lang AS root,
       CAST(MIN(doc_id) AS BIGINT) AS ord
FROM documents JOIN labels USING (doc_id)
WHERE toxic = 1
GROUP BY source, lang"""


def sources(d: Dialect) -> str:
    """A project per source, and one nothing belongs to."""
    return """
SELECT source AS project_id, '/corpus/' || source AS root, MIN(doc_id) AS ord
FROM documents GROUP BY source
UNION ALL
SELECT 'none' AS project_id, '/none' AS root, MAX(doc_id) + 1 AS ord FROM documents"""


def chunk_vectors(d: Dialect) -> str:
    """The given vectors as stored chunks."""
    key, label = text_of("vec_id"), text_of("label")
    return f"""
SELECT {key} AS chunk_id, 'p' || {label} AS project_id,
       '/p' || {label} || '/f' || {text_of('vec_id % 50')}
         || CASE CAST(vec_id % 3 AS INT) WHEN 0 THEN '.md' WHEN 1 THEN '.go' ELSE '' END AS path,
       {d.sha(key)} AS file_hash,
       CASE CAST(vec_id % 3 AS INT) WHEN 0 THEN 'markdown' WHEN 1 THEN 'go' ELSE '' END AS language,
       'Sym_' || {key} AS symbol, 'func Sym_' || {key} || '()' AS signature,
       'vector ' || {key} AS content,
       CAST(vec_id % 100 + 1 AS INT) AS start_line, CAST(vec_id % 100 + 9 AS INT) AS end_line,
       embedding
FROM embeddings"""


def changes(d: Dialect) -> str:
    """User events as file changes."""
    return f"""
SELECT 'g' || {text_of('user_id % 10')} AS project_id,
       '/u' || {text_of('user_id')} || '/f' || {text_of('event_id % 20')} AS path,
       CASE event_type WHEN 'view' THEN 'chmod' WHEN 'signup' THEN 'create'
            WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'remove' ELSE 'rename' END AS op,
       ts
FROM events"""


def doc_changes(d: Dialect) -> str:
    """Changes of labelled documents (toxic ones are removed) and of lost pages."""
    return f"""
SELECT {DOC_PATH} AS path, 'write' AS op, {d.minutes('doc_id')} AS ts
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT {DOC_PATH} AS path, CASE WHEN toxic = 1 THEN 'remove' ELSE 'chmod' END AS op,
       {d.minutes('(doc_id + 1)')} AS ts
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT '/corpus/old/page_' || {text_of('page_id')} || '.md' AS path, 'remove' AS op,
       {d.minutes('page_id')} AS ts
FROM pages"""


def present_files(d: Dialect) -> str:
    """The tree after ``doc_changes``: toxic documents are gone."""
    return f"""
SELECT files.* FROM files
LEFT JOIN (SELECT {DOC_PATH} AS gone FROM documents JOIN labels USING (doc_id)
           WHERE toxic = 1) g ON files.path = g.gone
WHERE g.gone IS NULL"""


def tree_files(d: Dialect) -> str:
    """Documents, marker files beside labelled ones, and workspace files."""
    marker = (
        "'/corpus/' || source || '/' || lang || CASE WHEN toxic = 1 THEN '/.git/HEAD' "
        "WHEN quality = 1 THEN '/q1/go.mod' ELSE '/q0/.venv/pyvenv.cfg' END"
    )
    return f"""
SELECT path, content, size FROM files
UNION ALL
SELECT DISTINCT {marker} AS path, '' AS content, CAST(0 AS BIGINT) AS size
FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT DISTINCT '/corpus/' || source || '/all.code-workspace' AS path,
       '{{"folders":[{{"path":"en"}},{{"path":"./de"}},{{"path":"../' || source || '/fr/q1"}},{{"path":"nowhere"}},{{"path":""}}]}}' AS content,
       CAST(100 AS BIGINT) AS size
FROM documents WHERE n_chars > 8000"""


def ignore_files(d: Dialect) -> str:
    """Documents plus ignore files at the root, per source and per language."""
    return """
SELECT path, content, size FROM files
UNION ALL
SELECT DISTINCT '/corpus/.gitignore' AS path,
       concat('# comment', chr(10), '*.MD', chr(10), '/src1/de/', chr(10), chr(10), 'doc_?.md', chr(13), chr(10), 'src2/**/doc_*7.txt', chr(10),
              'src3/fr', chr(10), chr(92), '#doc', chr(10), 'doc_[!1-7]?.py  ', chr(10), '**/src4/**/doc_1*', chr(10)) AS content,
       CAST(50 AS BIGINT) AS size
FROM documents
UNION ALL
SELECT DISTINCT '/corpus/' || source || '/.gitignore' AS path,
       concat('fr/*.py', chr(10), '!doc_*2.py', chr(10), 'doc_1*', chr(10), '!doc_1*.txt', chr(10), '**/es', chr(10)) AS content,
       CAST(50 AS BIGINT) AS size
FROM documents WHERE n_chars > 500
UNION ALL
SELECT DISTINCT '/corpus/' || source || '/' || lang || '/.gitignore' AS path,
       concat('*.txt', chr(10), '!doc_*6.txt', chr(10)) AS content, CAST(50 AS BIGINT) AS size
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"""


def notes(d: Dialect) -> str:
    """Benchmark passages as notes."""
    return f"""
SELECT item_id, 'Note: ' || substring(text, 1, 70) AS title, text AS content,
       CASE CAST(item_id % 3 AS INT) WHEN 0 THEN 'cascade' WHEN 1 THEN 'cursor' ELSE '' END AS provider,
       CASE CAST(item_id % 2 AS INT) WHEN 0 THEN 'decision,search' ELSE '' END AS tags,
       {d.minutes('item_id')} AS saved_at
FROM benchmark"""


def requests(d: Dialect) -> str:
    """Search requests: every benchmark passage, with filters for some."""
    return """
SELECT 'q' || CAST(item_id AS VARCHAR(40)) AS query_id, text, '' AS project_id,
       CASE CAST(item_id % 3 AS INT) WHEN 1 THEN 'Markdown' WHEN 2 THEN 'PYTHON' ELSE '' END AS language,
       CASE CAST(item_id % 4 AS INT) WHEN 1 THEN '/corpus/src1' WHEN 2 THEN '/corpus' ELSE '' END AS path_prefix
FROM benchmark"""


VIEWS: dict[str, Callable[[Dialect], str]] = {
    fn.__name__: fn
    for fn in (
        files, md_files, code_files, file_state, projects, sources, chunk_vectors, changes,
        doc_changes, present_files, tree_files, ignore_files, notes, requests,
    )
}
KNOWN = TABLES | set(VIEWS)
