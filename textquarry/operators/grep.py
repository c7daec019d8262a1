"""Line search and line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.embed import bind
from textquarry.functions.paths import under_path, walk_key
from textquarry.operators.filters import text_files
from textquarry.plans.joins import fits_broadcast

DEFAULT_MATCHES = 20


def grep_lines(files: DataFrame, query: str, *, regex: bool = False, root: str = "/") -> DataFrame:
    """Every line of the text files below ``root`` that matches.

    Lines are cut, numbered and filtered inside the row; only hits leave it.  A
    file without the text anywhere is skipped before it is cut.
    """
    if not query:
        raise ValueError("query is required")
    pattern = T.java_regex(query) if regex else query
    searched = text_files(files.where(under_path(F.col("path"), root)))
    if not regex:
        searched = searched.where(F.contains("content", F.lit(pattern)))

    def test(line):
        return F.regexp_like(line, F.lit(pattern)) if regex else F.contains(line, F.lit(pattern))

    numbered = F.transform(
        T.lines(F.col("content")),
        lambda x, i: F.when(
            test(x), F.struct((i + 1).cast("int").alias("line"), x.alias("content"))
        ),
    )
    hits = F.filter(numbered, lambda h: h.isNotNull())
    # The outer form keeps the optimiser from testing the hits a second time.
    return (
        searched.select("path", F.explode_outer(hits).alias("h"))
        .where(F.col("h").isNotNull())
        .select("path", "h.line", "h.content")
    )


def grep(
    files: DataFrame, query: str, *, regex: bool = False, root: str = "/",
    k: int = DEFAULT_MATCHES,
) -> DataFrame:
    """The first ``k`` matching lines in directory-walk order."""
    k = k if k > 0 else DEFAULT_MATCHES
    found = grep_lines(files, query, regex=regex, root=root)
    return found.orderBy(walk_key(F.col("path")), "line").limit(k)


def line_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text of line ranges, 1-based and inclusive.

    ``ranges`` has ``path, start_line, end_line``.  A start of 0 or less means
    the first line; an end of 0 or less, or past the end, the last one.  Rows
    that cannot be served say why in ``status``: ``not_found`` or
    ``invalid_range``.  Requests measured to be few go to the file scan, so only
    the contents asked for are shuffled.
    """
    lines = T.lines(F.col("content"))
    start = F.greatest(F.col("start_line"), F.lit(1))

    def cut(all_lines):
        total = F.size(all_lines)
        end = F.when(
            (F.col("end_line") <= 0) | (F.col("end_line") > total), total
        ).otherwise(F.col("end_line"))
        ok = start <= end
        return F.struct(
            F.when(ok, F.array_join(F.slice(all_lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"))
            .otherwise("").alias("text"),
            F.when(ok, "ok").otherwise("invalid_range").alias("status"),
        )

    found = F.when(F.col("content").isNotNull(), bind(lines, cut))
    wanted = ranges.select("path").distinct()
    few = fits_broadcast(wanted)
    contents = files.select("path", "content").join(
        F.broadcast(wanted) if few else wanted, "path", "left_semi"
    )
    return ranges.join(contents, "path", "left").withColumn(
        "_r", found
    ).select(
        *ranges.columns,
        F.coalesce("_r.text", F.lit("")).alias("text"),
        F.coalesce("_r.status", F.lit("not_found")).alias("status"),
    )
