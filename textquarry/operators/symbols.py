"""Symbol lookup: exact, fuzzy and with semantic fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.index import SYMBOL_COLUMNS
from textquarry.operators.search import search_codebase
from textquarry.plans.joins import cut_lineage, fits_broadcast, lookup_join

SUFFIXES_PER_FILE = 1_000_000
SUFFIX_BLOCK_BYTES = 1 << 20
# Names whose ranges are named to the scan of a suffix table.
RANGES = 256
LAST_LETTER = "\U0010ffff"


def symbol_exact(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Locations whose symbol equals a name, ignoring case.

    A symbol that a large part of the corpus shares is a hot key of this join.
    """
    wanted = names.select("name", F.lower("name").alias("symbol_lc")).distinct()
    return lookup_join(symbols, wanted, ["symbol_lc"]).select("name", *SYMBOL_COLUMNS)


def suffixes_of(symbols: DataFrame) -> DataFrame:
    """(suffix, symbol_lc) of every suffix of the distinct symbols."""
    distinct = symbols.where("symbol_lc <> ''").select("symbol_lc").distinct()
    places = F.explode(F.sequence(F.lit(1), F.length("symbol_lc")))
    return distinct.select("symbol_lc", places.alias("at")).select(
        F.substring("symbol_lc", F.col("at"), F.length("symbol_lc")).alias("suffix"), "symbol_lc"
    )


def write_suffixes(symbols: DataFrame, path: str) -> DataFrame:
    """The suffix table of an index: sorted over all its files, so a name is one range of it.

    Ranges are cut by suffix and symbol, so a suffix that a tenth of all symbols share
    is spread too.  Files name the ranges they hold, and a lookup reads those it needs.
    """
    found = cut_lineage(suffixes_of(symbols), "suffixes")
    parts = max(1, -(-found.count() // SUFFIXES_PER_FILE))
    ordered = found.repartitionByRange(parts, "suffix", "symbol_lc").sortWithinPartitions("suffix", "symbol_lc")
    ordered.write.mode("overwrite").option("parquet.block.size", SUFFIX_BLOCK_BYTES).parquet(path)
    return symbols.sparkSession.read.schema(found.schema).parquet(path)


def symbol_fuzzy(symbols: DataFrame, names: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Locations whose symbol contains a name, ignoring case.

    A symbol contains a name if the name begins one of its suffixes.  That is an
    equi-join on the first letters of the suffixes, as many as each name has: no
    part of a name is looked up in its place, and names measured to be few go to
    the suffixes, so a name that most symbols contain is no hot key.  With the
    sorted ``suffixes`` of ``write_suffixes`` only the ranges of the names are read.
    """
    wanted = names.select("name", F.lower("name").alias("needle")).where("needle <> ''").distinct()
    wanted = cut_lineage(wanted, "needles")
    lengths = sorted(r[0] for r in wanted.select(F.length("needle")).distinct().collect())
    rows = suffixes if suffixes is not None else suffixes_of(symbols)
    if suffixes is not None and fits_broadcast(wanted, max_rows=RANGES):
        inside = F.lit(False)
        for r in wanted.select("needle").distinct().collect():
            last = F.lit(r["needle"] + LAST_LETTER)
            inside = inside | ((F.col("suffix") >= F.lit(r["needle"])) & (F.col("suffix") < last))
        rows = rows.where(inside)
    # A needle of each length that a suffix is long enough for.
    begins = F.array(*[F.when(F.length("suffix") >= n, F.substring("suffix", 1, n)) for n in lengths])
    met = rows.select("symbol_lc", F.explode(begins if lengths else F.array().cast("array<string>")).alias("needle"))
    matched = lookup_join(met.where("needle is not null"), wanted, ["needle"]).select("name", "symbol_lc").distinct()
    return lookup_join(symbols, matched, ["symbol_lc"], measure=False).select("name", *SYMBOL_COLUMNS)


def find_symbol(
    symbols: DataFrame, chunk_vectors: DataFrame, names: DataFrame, k: int = 10
) -> DataFrame:
    """Find symbols for a table of requests ``name, project_id, language``.

    Exact hits first; fuzzy ones for a name without any exact hit, wherever
    that hit lies; then project and language are applied.  A request left with
    nothing falls back to a semantic search whose hits must contain the name.
    """
    requests = names.select(
        "name",
        F.coalesce("project_id", F.lit("")).alias("want_project"),
        F.lower(F.coalesce("language", F.lit(""))).alias("want_language"),
    ).distinct()
    # Requests are few; each step below reads them, and what they hit, more than once.
    requests = cut_lineage(requests, "requests")
    exact = cut_lineage(symbol_exact(symbols, requests), "exact")
    without = cut_lineage(
        requests.join(exact.select("name").distinct(), "name", "left_anti"), "inexact"
    )
    fuzzy = symbol_fuzzy(symbols, without)
    located = (
        lookup_join(exact.unionByName(fuzzy), requests, ["name"])
        .where(F.col("want_project").isin("") | (F.col("want_project") == F.col("project_id")))
        .where(F.col("want_language").isin("") | (F.col("want_language") == F.lower("language")))
    )
    located = cut_lineage(located, "located")
    keys = ["name", "want_project", "want_language"]
    unresolved = requests.join(located.select(*keys).distinct(), keys, "left_anti")
    queries = unresolved.select(
        F.to_json(F.struct(*keys)).alias("query_id"),
        F.concat(F.lit("function or type named "), "name").alias("text"),
        F.col("want_project").alias("project_id"),
        F.col("want_language").alias("language"),
    )
    request = F.from_json(
        F.col("query_id"), "name string, want_project string, want_language string"
    )
    semantic = (
        search_codebase(chunk_vectors, queries, k)
        .withColumn("request", request)
        .select("request.*", *SYMBOL_COLUMNS)
        .where(F.contains(F.lower("symbol"), F.lower("name")))
    )
    out = [*keys, *SYMBOL_COLUMNS]
    return (
        located.select(*out)
        .unionByName(semantic.select(*out))
        .withColumn("score", F.lit(1.0))
    )
