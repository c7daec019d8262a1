"""Chat sessions and notes as Markdown files of the memory corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.embed import bind
from textquarry.functions.paths import base_name, under_path
from textquarry.operators.filters import keeps_turn
from textquarry.plans.joins import fits_broadcast, running

DEFAULT_PROVIDER = "cascade"
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# A file of a session holds so many turns; turns are numbered in blocks.
TURNS_PER_FILE = 500
TURN_BLOCK = 10_000


PART = ".part"


def session_of(path: Column) -> Column:
    """The session a memory file is of, from its name."""
    return F.regexp_replace(base_name(path), r"(\.part[0-9]+)?\.md$", "")


def dedupe_strings(strings: Column) -> Column:
    """Distinct strings in first-seen order."""
    return F.array_distinct(strings)


def export_sessions(
    turns: DataFrame,
    exported_at: Column,
    *,
    provider: str = DEFAULT_PROVIDER,
    folder: str = "/memory",
    min_user_bytes: int = 10,
    turns_per_file: int = TURNS_PER_FILE,
) -> DataFrame:
    """Render sessions as Markdown files.

    ``turns`` has ``conv_id, turn, role, text`` with ``turn`` the position in
    the session.  A file carries a header about its turns, the dialogue and
    every distinct string of them, listed where it is first seen.  The first
    ``turns_per_file`` turns of a session are ``<conv_id>.md``, the following ones
    ``<conv_id>.part1.md`` and so on, each a file like any other: no row holds more
    than that, a session is numbered and rendered by as many tasks as it has blocks
    and parts, and one that grows leaves its earlier parts as they are.
    ``exported_at`` must not depend on the time of the run, so that a repeated
    export gives the same bytes.

    Output: ``project_id, path, content, mod_time``.
    """
    conv = F.col("conv_id").cast("string")
    block = F.floor(F.col("turn") / TURN_BLOCK)
    numbered = running(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], block, F.lit(1), "n")
    turns = numbered.withColumn("part", F.floor((F.col("n") - 1) / turns_per_file).cast("bigint"))
    part = F.when(F.col("part") > 0, F.concat(F.lit(PART), F.col("part").cast("string"))).otherwise("")
    name = F.concat(conv, part)
    item = F.struct("turn", "role", "text", keeps_turn(min_user_bytes).alias("in_dialogue"))
    files = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(item)).alias("items"))
    texts = F.transform("items", lambda x: x["text"])
    strings = dedupe_strings(texts)
    size = F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.octet_length(x["text"]), F.lit(0)))
    n_turns = F.size(F.filter("items", lambda x: x["in_dialogue"]))

    def turn_block(item: Column) -> Column:
        label = F.when(item["role"] == "user", "User").otherwise("Assistant")
        return F.concat(
            F.lit("### "), label, F.lit("\n\n"), T.escape_headings(item["text"]), F.lit("\n\n")
        )

    # The header of an exported session.
    header = F.concat(
        F.lit("# Chat trajectory: "), conv,
        F.lit(f"\n\n- **Provider:** {provider}\n- **Source:** `"), conv,
        F.lit("`\n- **Decrypted size:** "), size.cast("string"),
        F.lit(" bytes\n- **Dialogue turns:** "), n_turns.cast("string"),
        F.lit("\n- **Extracted strings:** "), F.size(strings).cast("string"),
        F.lit("\n- **Exported:** "), F.date_format(exported_at, RFC3339),
        F.lit("\n\n---\n\n"),
    )
    spoken = F.transform(F.filter("items", lambda x: x["in_dialogue"]), turn_block)
    dialogue = bind(
        F.array_join(spoken, ""),
        lambda text: F.when(text == "", "").otherwise(F.concat(F.lit("## Dialogue\n\n"), text)),
    )
    listed = F.transform(strings, lambda s: F.concat(T.escape_headings(s), F.lit("\n\n")))
    extracted = F.concat(F.lit("## All extracted strings\n\n"), F.array_join(listed, ""))
    return files.select(
        F.lit("memory-" + provider).alias("project_id"),
        F.concat(F.lit(folder + "/"), name, F.lit(".md")).alias("path"),
        F.concat(header, dialogue, extracted).alias("content"),
        exported_at.alias("mod_time"),
    )


def notes_to_files(notes: DataFrame, *, folder: str = "/memory") -> DataFrame:
    """Render notes (``title, content, tags, provider, saved_at``) as files.

    Notes without a title or content are invalid and not written.
    """
    provider = F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit(DEFAULT_PROVIDER))
    tags = F.when(
        F.size("tags") > 0,
        F.concat(F.lit("- **Tags:** "), F.array_join("tags", ", "), F.lit("\n")),
    ).otherwise("")
    body = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n- **Provider:** "), provider, F.lit("\n"), tags,
        F.lit("- **Saved:** "), F.date_format("saved_at", RFC3339),
        F.lit("\n\n"), F.col("content"), F.lit("\n"),
    )
    name = F.concat(
        F.date_format("saved_at", "yyyyMMdd-HHmmss"), F.lit("-"), T.slugify(F.col("title")),
        F.lit(".md"),
    )
    valid = (T.strip_space(F.col("title")) != "") & (T.strip_space(F.col("content")) != "")
    return notes.where(valid).select(
        F.concat(F.lit("memory-"), provider).alias("project_id"),
        F.concat(F.lit(folder + "/"), name).alias("path"),
        body.alias("content"),
        F.col("saved_at").alias("mod_time"),
    )


def memory_read(files: DataFrame, paths: DataFrame, *, folder: str = "/memory") -> DataFrame:
    """Text of memory files: ``path, content, status`` for every path asked for.

    Status is ``ok``, ``not_found``, or ``not_allowed`` for a path outside the
    folder or one with ``..`` in it; only ``ok`` has a content.
    """
    asked = paths.select("path").distinct()
    inside = under_path(F.col("path"), folder) & ~F.array_contains(F.split("path", "/"), "..")
    few = fits_broadcast(asked)
    found = files.select("path", "content").join(
        F.broadcast(asked) if few else asked, "path", "left_semi"
    )
    status = (
        F.when(~inside, "not_allowed").when(F.col("content").isNull(), "not_found").otherwise("ok")
    )
    read = asked.join(found, "path", "left").withColumn("status", status)
    return read.withColumn("content", F.when(F.col("status") == "ok", F.col("content")))


def memory_list(files: DataFrame, provider: str = DEFAULT_PROVIDER) -> DataFrame:
    """Memory files of one provider, read from the files themselves."""
    named = T.provider_of_note(F.col("content"), DEFAULT_PROVIDER)
    return (
        files.where(F.endswith(base_name(F.col("path")), F.lit(".md")))
        .select("path", named.alias("provider"))
        .where(F.col("provider") == (provider or DEFAULT_PROVIDER))
    )
