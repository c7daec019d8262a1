"""Queries over vectors: exact top-k, re-ranking and the search requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import filters, search, symbols
from textquarry.operators.index import symbol_table
from textquarry.operators.knn import vector_topk
from textquarry.plans.joins import cut_lineage
from textquarry.plans.refresh import build_chunk_vectors
from textquarry.workload.q_chunks import (
    CHUNKS,
    MEMORY_CHUNKS,
    embedding_sql,
    session_files,
    whole_file_sql,
)
from textquarry.workload.registry import query


# --- the given vectors -----------------------------------------------------


def _mean_vectors(t, *keys):
    """Mean vector of the whole table, or of every group of it."""
    return (
        t.embeddings.select(*keys, F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "v"))
        .groupBy(*keys, "d")
        .agg(F.avg("v").alias("v"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("embedding"))
    )


MEANS = """
SELECT label, list(v ORDER BY d) AS embedding FROM (
  SELECT label, d, avg(CAST(v AS DOUBLE)) AS v FROM (
    SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) e
  GROUP BY label, d) m
GROUP BY label"""

# Cosine of two lists of DOUBLE; 0 when one has no length.
COSINE = (
    "round(coalesce(list_inner_product(a, b) / nullif(sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 0), 0), 6)"
)


def scored_sql(queries: str, chunks: str, where: str = "true") -> str:
    """Every query against every chunk, for small tables in DuckDB only.

    ``queries``: query_id, embedding and filters; ``chunks``: the chunk columns.
    """
    return f"""
SELECT * EXCLUDE (a, b), {COSINE} AS score FROM (
  SELECT q.query_id, q.text, q.path_prefix, c.* EXCLUDE (embedding),
         CAST(q.embedding AS DOUBLE[]) AS a, CAST(c.embedding AS DOUBLE[]) AS b
  FROM ({queries}) q, ({chunks}) c
  WHERE {where}) s"""


LABEL_QUERIES = f"""
SELECT 'c' || label AS query_id, 'sym_' || label AS text, embedding,
       CASE CAST(label % 3 AS INT) WHEN 1 THEN 'p' || label ELSE '' END AS project_id,
       CASE CAST(label % 4 AS INT) WHEN 2 THEN 'go' ELSE '' END AS language,
       CASE CAST(label % 2 AS INT) WHEN 1 THEN '/p' || label ELSE '' END AS path_prefix
FROM ({MEANS}) m"""
SAME_FILTERS = (
    "(q.project_id = '' OR q.project_id = c.project_id) AND (q.language = '' OR q.language = c.language)"
)


def label_queries(t):
    label = F.col("label").cast("string")
    return _mean_vectors(t, "label").select(
        F.concat(F.lit("c"), label).alias("query_id"),
        F.concat(F.lit("sym_"), label).alias("text"),
        "embedding",
        F.when(F.col("label") % 3 == 1, F.concat(F.lit("p"), label)).otherwise("").alias("project_id"),
        F.when(F.col("label") % 4 == 2, "go").otherwise("").alias("language"),
        F.when(F.col("label") % 2 == 1, F.concat(F.lit("/p"), label)).otherwise("").alias("path_prefix"),
    )


@query(
    "vector_topk",
    f"""
SELECT chunk_id, score FROM (
  {scored_sql("SELECT 'all' AS query_id, '' AS text, '' AS path_prefix, list(v ORDER BY d) AS embedding FROM (SELECT d, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) e GROUP BY d) m", "SELECT * FROM chunk_vectors")}) r
ORDER BY score DESC, chunk_id LIMIT 10""",
)
def topk(t):
    one = _mean_vectors(t).withColumn("query_id", F.lit("all"))
    return vector_topk(t.chunk_vectors, one, 10)[0].select("chunk_id", "score")


@query(
    "vector_topk_batch",
    f"""
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM ({scored_sql(LABEL_QUERIES, "SELECT * FROM chunk_vectors")}) s) r
WHERE rank <= 10""",
)
def topk_batch(t):
    queries = label_queries(t).select("query_id", "embedding")
    return vector_topk(t.chunk_vectors, queries, 10)[0].select("query_id", "chunk_id", "score", "rank")


EVERY_CHUNK = """
SELECT kind || chunk_id AS query_id, '' AS text, '' AS path_prefix, embedding,
       CASE WHEN kind = 'p' THEN project_id ELSE '' END AS project_id,
       CASE WHEN kind = 'l' THEN language ELSE '' END AS language
FROM chunk_vectors, (SELECT unnest(['a', 'p', 'l']) AS kind) k"""


@query(
    "vector_topk_grid",
    f"""
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM ({scored_sql(EVERY_CHUNK, "SELECT * FROM chunk_vectors", SAME_FILTERS)}) s) r
WHERE rank <= 10""",
)
def topk_grid(t):
    """The nearest chunks of every chunk: of all, of its project, and of its language."""
    kinds = F.explode(F.array(*map(F.lit, "apl")))
    queries = t.chunk_vectors.withColumn("kind", kinds).select(
        F.concat("kind", "chunk_id").alias("query_id"),
        "embedding",
        F.when(F.col("kind") == "p", F.col("project_id")).otherwise("").alias("project_id"),
        F.when(F.col("kind") == "l", F.col("language")).otherwise("").alias("language"),
    )
    return vector_topk(t.chunk_vectors, queries, 10)[0].select("query_id", "chunk_id", "score", "rank")


@query(
    "filtered_search",
    f"""
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM ({scored_sql(LABEL_QUERIES, "SELECT * FROM chunk_vectors WHERE language = 'go'", SAME_FILTERS)}) s) r
WHERE rank <= 10""",
)
def filtered_search(t):
    chunks = filters.metadata_filter(t.chunk_vectors, language="Go")
    queries = label_queries(t).drop("path_prefix")
    return vector_topk(chunks, queries, 10)[0].select("query_id", "chunk_id", "score", "rank")


BOOSTED = """round(CASE WHEN contains(lower(symbol), lower(text)) THEN score + 0.1
    WHEN contains(lower(path), lower(text)) THEN score + 0.05 ELSE score END, 6)"""


@query(
    "keyword_boost",
    f"""
SELECT query_id, chunk_id, {BOOSTED} AS score FROM (
  {scored_sql(LABEL_QUERIES, "SELECT * FROM chunk_vectors", "c.project_id = 'p' || substring(q.query_id, 2)")}) s""",
)
def keyword_boost(t):
    queries = label_queries(t).withColumn("project_id", F.concat(F.lit("p"), F.substring("query_id", 2, 9)))
    queries = queries.select("query_id", "text", "embedding", "project_id")
    chunks = t.chunk_vectors
    scored = vector_topk(chunks, queries, max(1, chunks.count()))[0].select("query_id", "chunk_id", "score")
    shown = scored.join(chunks.select("chunk_id", "symbol", "path"), "chunk_id")
    shown = shown.join(queries.select("query_id", "text"), "query_id")
    return shown.select(
        "query_id",
        "chunk_id",
        search.boosted(F.col("score"), F.col("symbol"), F.col("path"), F.col("text")).alias("score"),
    )


def reranked_sql(scored: str, k: int = 10) -> str:
    """Path filter, bonus, order and cut over all scored chunks."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT * EXCLUDE (score), {BOOSTED} AS score FROM ({scored}) s
  WHERE path_prefix IN ('', '/') OR path = path_prefix OR starts_with(path, path_prefix || '/')) b
QUALIFY rank <= {k}"""


FOUND = "query_id, chunk_id, project_id, path, language, symbol, signature, start_line, end_line, score, CAST(rank AS INT) AS rank"


@query(
    "rerank_topk",
    f"""
SELECT {FOUND} FROM ({reranked_sql(scored_sql(LABEL_QUERIES, 'SELECT * FROM chunk_vectors', SAME_FILTERS))}) r""",
)
def rerank_topk(t):
    return search.search_codebase(t.chunk_vectors, label_queries(t))


@query(
    "rerank_strict",
    f"""
SELECT {FOUND} FROM ({reranked_sql(scored_sql(LABEL_QUERIES, 'SELECT * FROM chunk_vectors',
    SAME_FILTERS + " AND (q.path_prefix = '' OR starts_with(c.path, q.path_prefix || '/'))").replace('q.path_prefix, c.*', "'' AS path_prefix, c.*"), 200)}) r""",
)
def rerank_strict(t):
    """Far more results than any pool of candidates held."""
    return search.search_codebase(t.chunk_vectors, label_queries(t), 200)


# --- documents searched with texts -----------------------------------------

DOC_CHUNKS = f"SELECT {CHUNKS} FROM ({whole_file_sql('files')}) w"
# Stored vectors are FLOAT.
DOC_VECTORS = f"""
SELECT c.*, CAST(e.embedding AS FLOAT[]) AS embedding
FROM ({DOC_CHUNKS}) c JOIN ({embedding_sql('(' + DOC_CHUNKS + ') k', 'chunk_id', 'content')}) e ON e.chunk_id = c.chunk_id"""
REQUESTS = f"""
SELECT r.query_id, r.text, r.project_id, lower(r.language) AS language, r.path_prefix, e.embedding
FROM requests r JOIN ({embedding_sql('requests', 'query_id', 'text')}) e ON e.query_id = r.query_id"""
DOC_REQUESTS = f"SELECT query_id, text, project_id, 'markdown' AS language, '' AS path_prefix, embedding FROM ({REQUESTS}) x"
MEMORY_VECTORS = f"""
SELECT c.*, CAST(e.embedding AS FLOAT[]) AS embedding
FROM (SELECT DISTINCT ON (chunk_id) * FROM ({MEMORY_CHUNKS}) u ORDER BY chunk_id, start_line DESC) c
JOIN ({embedding_sql('(' + MEMORY_CHUNKS + ') k', 'chunk_id', 'content')}) e ON e.chunk_id = c.chunk_id"""


def doc_vectors(t):
    """Vectors of the documents, written once as an index keeps them."""
    return cut_lineage(build_chunk_vectors(t.files), "doc-vectors")


def memory_vectors(t):
    return cut_lineage(build_chunk_vectors(session_files(t)), "memory-vectors")


@query(
    "search_codebase",
    f"SELECT {FOUND} FROM ({reranked_sql(scored_sql(REQUESTS, DOC_VECTORS, SAME_FILTERS))}) r",
)
def search_codebase(t):
    return search.search_codebase(doc_vectors(t), t.requests)


@query(
    "query_documentation",
    f"SELECT {FOUND.replace('score', 'content, score')} FROM ({reranked_sql(scored_sql(DOC_REQUESTS, DOC_VECTORS, SAME_FILTERS))}) r",
)
def query_documentation(t):
    return search.query_documentation(doc_vectors(t), t.requests)


MEMORY_FOUND = f"""
SELECT query_id, chunk_id, path, start_line, end_line, content, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT * FROM ({scored_sql(REQUESTS, MEMORY_VECTORS)}) s
    QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) = 1) f) r
WHERE rank <= 10"""


@query(
    "memory_search",
    f"""
SELECT query_id, chunk_id, path, 'cascade' AS provider, start_line, end_line, content, score,
       CAST(rank AS INT) AS rank
FROM ({MEMORY_FOUND}) m""",
)
def memory_search(t):
    return search.memory_search(memory_vectors(t), t.requests)


@query(
    "unified_search",
    f"""
SELECT query_id, chunk_id, source, project_id, path, language, symbol, signature, start_line, end_line,
       score, CAST(rank AS INT) AS rank
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_rank, chunk_id) AS rank FROM (
    SELECT * FROM (
      SELECT query_id, chunk_id, 'code' AS source, 0 AS source_rank, project_id, path, language, symbol, signature,
             start_line, end_line, score
      FROM ({reranked_sql(scored_sql(REQUESTS, DOC_VECTORS, SAME_FILTERS))}) a
      UNION ALL
      SELECT query_id, chunk_id, 'docs', 1, project_id, path, language, symbol, signature, start_line, end_line, score
      FROM ({reranked_sql(scored_sql(DOC_REQUESTS.replace("'' AS path_prefix", "path_prefix"), DOC_VECTORS, SAME_FILTERS))}) b
      UNION ALL
      SELECT query_id, chunk_id, 'memory', 2, '', path, '', '', '', start_line, end_line, score FROM ({MEMORY_FOUND}) c) u
    QUALIFY row_number() OVER (PARTITION BY query_id, path, start_line, end_line ORDER BY source_rank, score DESC, chunk_id) = 1) d) r
WHERE rank <= 10""",
)
def unified_search(t):
    found = search.unified_search(
        doc_vectors(t), memory_vectors(t), t.requests, include_content=False
    )
    return found.select(
        "query_id", "chunk_id", "source", "project_id", "path", "language", "symbol", "signature",
        "start_line", "end_line", "score", "rank",
    )


NAMES = """
SELECT DISTINCT 'doc_' || CAST(item_id AS VARCHAR(40)) || '.MD' AS name, '' AS want_project, '' AS want_language FROM benchmark
UNION
SELECT DISTINCT 'doc_' || CAST(item_id AS VARCHAR(40)), source, '' FROM documents JOIN benchmark ON doc_id = item_id
UNION
SELECT DISTINCT 'DOC_' || CAST(item_id AS VARCHAR(40)) || '.py', 'src1', 'python' FROM benchmark"""
NAME_REQUESTS = f"""
SELECT name || '|' || want_project || '|' || want_language AS query_id, 'function or type named ' || name AS text,
       want_project AS project_id, want_language AS language, '' AS path_prefix, embedding
FROM names n JOIN ({embedding_sql("(SELECT DISTINCT name, 'function or type named ' || name AS t FROM names) z", 'name', 't')}) e USING (name)"""


@query(
    "find_symbol",
    f"""
WITH names AS ({NAMES}),
chunks AS (SELECT *, lower(symbol) AS symbol_lc FROM ({DOC_CHUNKS}) c),
exact AS (SELECT DISTINCT name FROM names JOIN chunks ON symbol_lc = lower(name)),
located AS (
  SELECT n.*, c.project_id, c.path, c.language, c.symbol, c.signature, c.start_line, c.end_line
  FROM names n JOIN chunks c
    ON CASE WHEN n.name IN (SELECT name FROM exact) THEN c.symbol_lc = lower(n.name) ELSE contains(c.symbol_lc, lower(n.name)) END
  WHERE (want_project = '' OR want_project = c.project_id) AND (want_language = '' OR want_language = c.language)),
semantic AS (
  SELECT split_part(query_id, '|', 1) AS name, split_part(query_id, '|', 2) AS want_project,
         split_part(query_id, '|', 3) AS want_language, project_id, path, language, symbol, signature, start_line, end_line
  FROM ({reranked_sql(scored_sql(NAME_REQUESTS, DOC_VECTORS, SAME_FILTERS))}) r)
SELECT *, 1.0::DOUBLE AS score FROM (
  SELECT * FROM located
  UNION ALL
  SELECT s.* FROM semantic s
  WHERE contains(lower(symbol), lower(name)) AND NOT EXISTS (
    SELECT 1 FROM located l WHERE l.name = s.name AND l.want_project = s.want_project AND l.want_language = s.want_language)) x""",
)
def find_symbol(t):
    item = F.col("item_id").cast("string")
    names = (
        t.benchmark.select(
            F.concat(F.lit("doc_"), item, F.lit(".MD")).alias("name"),
            F.lit("").alias("project_id"), F.lit("").alias("language"),
        )
        .union(
            t.documents.join(t.benchmark.select("item_id"), F.col("doc_id") == F.col("item_id")).select(
                F.concat(F.lit("doc_"), item), "source", F.lit("")
            )
        )
        .union(
            t.benchmark.select(
                F.concat(F.lit("DOC_"), item, F.lit(".py")), F.lit("src1"), F.lit("python")
            )
        )
    )
    vectors = doc_vectors(t)
    return symbols.find_symbol(symbol_table(vectors), vectors, names)
