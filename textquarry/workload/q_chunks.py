"""Queries over chunking, sessions and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.embed import DEFAULT_DIM, hash_embedding
from textquarry.operators import chunking
from textquarry.sources import sessions
from textquarry.sources.files import file_rows
from textquarry.workload.registry import query

CHUNKS = (
    "sha256(path || chr(10) || content) AS chunk_id, project_id, path, file_hash, language, "
    "symbol, signature, content, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line"
)
BASE_NAME = "regexp_extract(path, '([^/]*)$', 1)"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# Any moment works, as long as it does not change from run to run.
EXPORTED_AT = "2024-02-01 00:00:00"
MIN_USER_BYTES = 80


def whole_file_sql(source: str) -> str:
    return f"""
SELECT project_id, path, file_hash, content, {BASE_NAME} AS symbol, {BASE_NAME} AS signature,
       1 AS start_line, len(string_split(content, chr(10))) AS end_line,
       CASE lower(regexp_extract({BASE_NAME}, '(\\.[^.]*)$', 1))
         WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript'
         WHEN '.rs' THEN 'rust' WHEN '.md' THEN 'markdown' ELSE '' END AS language
FROM {source}"""


def sections_sql(source: str) -> str:
    """Markdown sections of a files relation (all of it must have headings)."""
    return rf"""
SELECT project_id, path, file_hash, 'markdown' AS language, start_line, end_line, content,
       trim(regexp_extract(content, '(?m)^(#{{1,6}}\s+.+)$', 1), {BLANKS}) AS symbol,
       trim(regexp_extract(content, '(?m)^(#{{1,6}}\s+.+)$', 1), {BLANKS}) AS signature
FROM (
  SELECT project_id, path, file_hash, min(ln) AS start_line,
         CASE WHEN max(ln) = any_value(total) THEN max(ln) ELSE max(ln) + 1 END AS end_line,
         substr(string_agg(line, chr(10) ORDER BY ln), 2)
           || CASE WHEN max(ln) = any_value(total) THEN '' ELSE chr(10) END AS content
  FROM (
    SELECT *, sum(CASE WHEN starts_with(line, chr(1)) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) AS section
    FROM (
      SELECT project_id, path, file_hash, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln,
             len(lines) AS total
      FROM (SELECT project_id, path, file_hash,
                   string_split(regexp_replace(content, '(?m)^(#{{1,6}}\s+.+)$', chr(1) || '\1', 'g'), chr(10)) AS lines
            FROM {source}) l) n) m
  WHERE section > 0
  GROUP BY project_id, path, file_hash, section) s"""


DECLARATIONS = rf"""
WITH RECURSIVE lines AS (
  SELECT project_id, path, file_hash, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln, len(ls) AS total,
         CASE regexp_extract(path, '(\.[^.]*)$', 1) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python'
              WHEN '.ts' THEN 'typescript' ELSE 'rust' END AS language
  FROM (SELECT *, string_split(content, chr(10)) AS ls FROM code_files) l),
marked AS (
  SELECT *,
    length(line) - length(ltrim(line, chr(9) || ' '))
      + 7 * (length(regexp_extract(line, '^[ \t]*')) - length(replace(regexp_extract(line, '^[ \t]*'), chr(9), ''))) AS indent,
    CASE language
      WHEN 'go' THEN regexp_matches(line, '^(func|type)[ \t(]')
      WHEN 'python' THEN regexp_matches(line, '^[ \t]*((async[ \t]+)?def|class)[ \t]')
      WHEN 'typescript' THEN regexp_matches(line, '^[ \t]*((async[ \t]+)?function|class|export)[ \t*{{]')
        OR regexp_matches(line, '^[ \t]+((static|async|get|set)[ \t]+)*[*#]?[A-Za-z_$][0-9A-Za-z_$]*[ \t]*\([^(){{}}]*\)[ \t]*\{{[ \t\r]*$')
        AND NOT regexp_matches(line, '^[ \t]*(if|for|while|switch|catch|with|function|return|do|else)\b')
      ELSE regexp_matches(line, '^[ \t]*(pub(\([^)]*\))?[ \t]+)?((default|const|async|unsafe)[ \t]+)*(fn|impl|trait|struct|enum)[ \t<]')
    END AS starts,
    CASE language WHEN 'python' THEN regexp_matches(line, '^[ \t]*[^ \t\r\f#)\]}}]')
      ELSE regexp_matches(line, '^[ \t]*[}})]') AND NOT regexp_matches(line, '\{{[ \t\r]*$') END AS closes,
    regexp_matches(line, '[{{(,][ \t\r]*$') AS opens
  FROM lines),
starts AS (
  SELECT path, language, total, indent, opens, ln AS a FROM marked
  WHERE starts AND (language = 'python' OR NOT closes)),
ended AS (
  SELECT s.path, s.a, CASE WHEN language = 'python' THEN coalesce(min(m.ln) - 1, any_value(total))
           WHEN any_value(s.opens) THEN coalesce(min(m.ln), any_value(total)) ELSE s.a END AS b
  FROM starts s LEFT JOIN (SELECT path, ln, indent FROM marked WHERE closes) m
    ON m.path = s.path AND m.ln > s.a AND m.indent <= s.indent
  GROUP BY s.path, s.a, s.language),
after AS (
  SELECT e.path, e.a, e.b, min(n.a) AS following
  FROM ended e LEFT JOIN starts n ON n.path = e.path AND n.a > e.b GROUP BY e.path, e.a, e.b),
spans AS (
  SELECT path, a, b, following FROM after WHERE (path, a) IN (SELECT path, min(a) FROM starts GROUP BY path)
  UNION ALL
  SELECT n.path, n.a, n.b, n.following FROM spans s JOIN after n ON n.path = s.path AND n.a = s.following),
bodies AS (
  SELECT m.project_id, m.path, m.file_hash, m.language, s.a,
         string_agg(m.line, chr(10) ORDER BY m.ln) AS body, min_by(m.line, m.ln) AS head
  FROM spans s JOIN marked m ON m.path = s.path AND m.ln BETWEEN s.a AND s.b
  GROUP BY m.project_id, m.path, m.file_hash, m.language, s.a),
trimmed AS (
  SELECT project_id, path, file_hash, language, a AS start_line, trim(head, {BLANKS}) AS signature,
         ltrim(CASE WHEN language = 'python' THEN rtrim(body, {BLANKS}) ELSE body END, chr(9) || ' ') AS content
  FROM bodies),
named AS (
  SELECT *, start_line + len(string_split(content, chr(10))) - 1 AS end_line,
    CASE language WHEN 'go' THEN regexp_extract(signature, '^func[ \t]*(?:\([^)]*\)[ \t]*)?([0-9A-Za-z_]+)', 1)
      WHEN 'typescript' THEN regexp_extract(signature, '^(?:async[ \t]+)?(?:function|class)[ \t]*\*?[ \t]*([0-9A-Za-z_$]+)', 1)
      WHEN 'rust' THEN regexp_extract(signature, '\b(?:fn|trait|struct|enum)[ \t]+([0-9A-Za-z_]+)', 1)
      ELSE '' END AS own_name
  FROM trimmed),
guesses AS (
  SELECT *, CASE WHEN own_name <> '' THEN own_name ELSE regexp_extract(signature,
    '(?:func|def|fn|class|struct|enum|trait|impl|type|const|var)\s+(\w+)', 1) END AS guessed
  FROM named),
found AS (
  SELECT *, CASE WHEN guessed = '' AND language = 'typescript' THEN
    regexp_extract(signature, '^(?:(?:static|async|get|set)[ \t]+)*[*#]?([A-Za-z_$][0-9A-Za-z_$]*)[ \t]*\(', 1)
    ELSE guessed END AS symbol
  FROM guesses)"""


def embedding_sql(source: str, key: str, text: str) -> str:
    """Hashed embedding as ``key, embedding`` (64 DOUBLEs) of every row."""
    return rf"""
SELECT k AS {key}, list(coalesce(n / nullif(norm, 0), 0) ORDER BY d) AS embedding
FROM (
  SELECT k, d, n, sqrt(sum(n * n) OVER (PARTITION BY k)) AS norm
  FROM (
    SELECT k, d, CAST(count(tok) AS DOUBLE) AS n
    FROM (SELECT DISTINCT {key} AS k, unnest(range(64)) AS d FROM {source}) dims
    LEFT JOIN (
      SELECT key2, tok, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket
      FROM (SELECT {key} AS key2, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) AS tok FROM {source}) t
      WHERE tok <> '') b ON b.key2 = dims.k AND b.bucket = dims.d
    GROUP BY k, d) c) v
GROUP BY k"""


# Turns a file of a session holds in the registered queries: most sessions have parts.
TURNS = 3
SESSIONS = rf"""
SELECT 'memory-cascade' AS project_id,
  '/memory/' || conv_id || CASE WHEN part > 0 THEN '.part' || part ELSE '' END || '.md' AS path,
  '# Chat trajectory: ' || conv_id || chr(10) || chr(10) || '- **Provider:** cascade' || chr(10)
  || '- **Source:** `' || conv_id || '`' || chr(10)
  || '- **Decrypted size:** ' || sum(strlen(text)) || ' bytes' || chr(10)
  || '- **Dialogue turns:** ' || count(*) FILTER (WHERE kept) || chr(10)
  || '- **Extracted strings:** ' || count(*) FILTER (WHERE first_turn = turn) || chr(10)
  || '- **Exported:** 2024-02-01T00:00:00Z' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || CASE WHEN count(*) FILTER (WHERE kept) > 0 THEN '## Dialogue' || chr(10) || chr(10)
     || string_agg('### ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10)
        || replace(text, '#', '\#') || chr(10) || chr(10), '' ORDER BY turn) FILTER (WHERE kept) ELSE '' END
  || '## All extracted strings' || chr(10) || chr(10)
  || string_agg(replace(text, '#', '\#') || chr(10) || chr(10), '' ORDER BY turn) FILTER (WHERE first_turn = turn) AS content
FROM (SELECT *, NOT (role = 'user' AND strlen(text) < {MIN_USER_BYTES}) AS kept,
             min(turn) OVER (PARTITION BY conv_id, part, text) AS first_turn
      FROM (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // {TURNS} AS BIGINT) AS part
            FROM conversations) c) t
GROUP BY conv_id, part"""


def session_files(t):
    exported = sessions.export_sessions(
        t.conversations, F.to_timestamp_ntz(F.lit(EXPORTED_AT)), min_user_bytes=MIN_USER_BYTES, turns_per_file=TURNS
    )
    return file_rows(exported)


def session_chunks(t):
    return chunking.chunk_files(session_files(t))


SESSION_FILES = f"SELECT *, sha256(content) AS file_hash FROM ({SESSIONS}) s"
MEMORY_CHUNKS = f"SELECT {CHUNKS} FROM ({sections_sql('(' + SESSION_FILES + ') f')}) c"


@query("dialogue_markdown", SESSIONS)
def dialogue_markdown(t):
    return session_files(t).select("project_id", "path", "content")


@query("markdown_sections", f"SELECT {CHUNKS} FROM ({sections_sql('md_files')}) c")
def markdown_sections(t):
    return chunking.markdown_sections(t.md_files)


@query("session_sections", MEMORY_CHUNKS)
def session_sections(t):
    return session_chunks(t)


@query("whole_file_chunk", f"SELECT {CHUNKS} FROM ({whole_file_sql('files')}) c")
def whole_file_chunk(t):
    return chunking.whole_file_chunks(t.files)


@query("declaration_chunks", f"{DECLARATIONS}\nSELECT {CHUNKS} FROM found")
def declaration_chunks(t):
    return chunking.declaration_chunks(t.code_files)


@query(
    "hash_embed",
    f"""
SELECT doc_id, d, round(v, 6) AS v
FROM (SELECT doc_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d
      FROM ({embedding_sql('documents', 'doc_id', 'text')}) e) x
WHERE v <> 0""",
)
def hash_embed(t):
    vectors = t.documents.select("doc_id", hash_embedding(F.col("text"), DEFAULT_DIM).alias("e"))
    return (
        vectors.select("doc_id", F.posexplode_outer("e").alias("d", "v"))
        .where("v <> 0")
        .select("doc_id", F.col("d").cast("bigint").alias("d"), F.round("v", 6).alias("v"))
    )
