"""Ranked search over chunk vectors: code, documentation and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.embed import hash_embedding
from textquarry.operators.knn import PATH_BOOST, SCORE_DIGITS, SYMBOL_BOOST, vector_topk
from textquarry.plans.joins import BROADCAST_ROWS

DEFAULT_K = 10
DEFAULT_PROVIDER = "cascade"

# Search sources in the order in which duplicates are resolved.
SOURCES = {"code": 0, "docs": 1, "memory": 2}

RESULT_COLUMNS = [
    "query_id", "chunk_id", "project_id", "path", "language", "symbol", "signature",
    "start_line", "end_line", "score",
]


def embed_queries(queries: DataFrame) -> DataFrame:
    """Add the built-in embedding of ``text``; an existing ``embedding`` stays."""
    if "embedding" in queries.columns:
        return queries
    return queries.withColumn("embedding", hash_embedding(F.col("text")))


def _with_filters(queries: DataFrame) -> DataFrame:
    """Fill in the optional filter columns and lower-case the language."""
    present = set(queries.columns)
    for name in ("project_id", "language", "path_prefix"):
        value = F.coalesce(F.col(name), F.lit("")) if name in present else F.lit("")
        queries = queries.withColumn(name, value)
    return queries.withColumn("language", F.lower("language")).withColumn(
        "query_id", F.col("query_id").cast("string")
    )


def boosted(score: Column, symbol: Column, path: Column, query: Column) -> Column:
    """Score plus the bonus of a literal hit: symbol first, else path, never both."""
    needle = F.lower(query)
    return F.round(
        F.when(F.contains(F.lower(symbol), needle), score + SYMBOL_BOOST)
        .when(F.contains(F.lower(path), needle), score + PATH_BOOST)
        .otherwise(score),
        SCORE_DIGITS,
    )


def fetch(chunk_vectors: DataFrame, hits: DataFrame, bound: int, columns: list[str]) -> DataFrame:
    """Attach chunk columns to hits.

    The number of hits has a proven bound, so below the broadcast limit they go
    to the chunk scan instead of the chunks being shuffled.
    """
    if bound <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return chunk_vectors.select("chunk_id", *columns).join(hits, "chunk_id")


def ranked(chunk_vectors: DataFrame, queries: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """The ``k`` best chunks of every query by boosted score, with chunk columns.

    Filters and the keyword bonus count for every chunk, so a query has ``k``
    results whenever as many chunks fit its filters.
    """
    hits, bound = vector_topk(chunk_vectors, queries, k, boost=True)
    return fetch(chunk_vectors, hits, bound, columns)


def search_codebase(
    chunk_vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    *,
    include_content: bool = False,
) -> DataFrame:
    """Semantic search for a table of queries.

    ``queries``: ``query_id, text`` and optionally ``embedding, project_id,
    language, path_prefix``.  Content is read only when asked for.
    """
    k = k if k > 0 else DEFAULT_K
    queries = _with_filters(embed_queries(queries))
    columns = RESULT_COLUMNS[2:-1]
    if include_content:
        columns = [*columns, "content"]
    return ranked(chunk_vectors, queries, k, columns).select("query_id", "chunk_id", *columns, "score", "rank")


def query_documentation(chunk_vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Search restricted to Markdown chunks, with content."""
    docs = queries.withColumn("language", F.lit("markdown")).withColumn("path_prefix", F.lit(""))
    return search_codebase(chunk_vectors, docs, k, include_content=True)


def memory_search(
    memory_vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
    provider: str = DEFAULT_PROVIDER, *, snippet_chars: int | None = None,
) -> DataFrame:
    """Best chunk of each of the ``k`` best memory files per query, without keyword bonus.

    ``snippet_chars`` cuts the content; by default it is whole.
    """
    k = k if k > 0 else DEFAULT_K
    project = "memory-" + (provider or DEFAULT_PROVIDER)
    queries = _with_filters(embed_queries(queries)).select(
        "query_id", "embedding", F.lit(project).alias("project_id")
    )
    hits, bound = vector_topk(memory_vectors, queries, k, per_path=True)
    found = fetch(memory_vectors, hits.drop("path"), bound, ["path", "start_line", "end_line", "content"])
    content = F.col("content")
    return found.select(
        "query_id",
        "chunk_id",
        "path",
        F.lit(project.removeprefix("memory-")).alias("provider"),
        "start_line",
        "end_line",
        (content if snippet_chars is None else T.snippet(content, snippet_chars)).alias("content"),
        "score",
        "rank",
    )


def first_per_location(found: DataFrame) -> DataFrame:
    """Keep one row per query and file span: code before docs before memory."""
    order = Window.partitionBy("query_id", "path", "start_line", "end_line").orderBy(
        "source_rank", F.desc("score"), "chunk_id"
    )
    return (
        found.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).drop("n")
    )


def unified_search(
    chunk_vectors: DataFrame,
    memory_vectors: DataFrame | None,
    queries: DataFrame,
    k: int = DEFAULT_K,
    *,
    source: str = "all",
    include_content: bool = True,
) -> DataFrame:
    """One ranked list over code, documentation and memory.

    Code and documentation are one scan: every query takes part twice, the
    second time restricted to Markdown.
    """
    k = k if k > 0 else DEFAULT_K
    source = (source or "all").strip().lower() or "all"
    if source != "all" and source not in SOURCES:
        raise ValueError(f"invalid source {source!r}: use memory, code, docs or all")
    queries = _with_filters(embed_queries(queries))
    content = ["content"] if include_content else []
    columns = [
        "project_id", "path", "language", "symbol", "signature", "start_line", "end_line",
        *content,
    ]
    shown = ["query_id", "chunk_id", "source", "source_rank", *columns, "score"]
    wanted = [s for s in SOURCES if source in ("all", s)]
    parts = []

    indexed = [s for s in wanted if s != "memory"]
    if indexed:
        each = F.explode(F.array(*[F.lit(s) for s in indexed]))
        tagged = (
            queries.withColumn("source", each)
            .withColumn(
                "language",
                F.when(F.col("source") == "docs", "markdown").otherwise(F.col("language")),
            )
            .withColumn("query_id", F.concat_ws(":", "source", "query_id"))
        )
        found = ranked(chunk_vectors, tagged, k, columns)
        parts.append(
            found.withColumn("source", F.substring_index("query_id", ":", 1))
            .withColumn(
                "query_id", F.expr("substring(query_id, length(source) + 2, length(query_id))")
            )
            .withColumn("source_rank", F.when(F.col("source") == "code", 0).otherwise(1))
            .select(*shown)
        )
    if "memory" in wanted and memory_vectors is not None:
        notes = memory_search(memory_vectors, queries, k)
        parts.append(
            notes.withColumn("source", F.lit("memory"))
            .withColumn("source_rank", F.lit(2))
            .withColumn("project_id", F.lit(""))
            .withColumn("language", F.lit(""))
            .withColumn("symbol", F.lit(""))
            .withColumn("signature", F.lit(""))
            .select(*shown)
        )
    if not parts:
        raise ValueError("memory is not available")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_rank", "chunk_id")
    return (
        first_per_location(union)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .drop("source_rank")
    )
