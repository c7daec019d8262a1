"""Splitting files into chunks.

All three splitters work inside the row that holds the file: lines are cut,
marked and re-joined with array expressions and only the finished chunks are
exploded.  Chunking therefore needs no shuffle, and each file's text is written
once however many chunks it has.

Input columns: ``project_id, path, content, file_hash``.  Output: the chunk
schema of :data:`CHUNK_COLUMNS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.embed import bind
from textquarry.functions.paths import base_name

CHUNK_COLUMNS = [
    "chunk_id",
    "project_id",
    "path",
    "file_hash",
    "language",
    "symbol",
    "signature",
    "content",
    "start_line",
    "end_line",
]

# Fixed value: an ATX heading.  The blank may span lines, so a bare ``#`` takes
# the next non-blank line as its text.  Java's ``\s`` has one character more
# than the class used here, hence the explicit list.
HEADING = r"(?md)^(#{1,6}[ \t\n\f\r]+.+)$"

# Marks a heading line.  ESCAPE follows every mark character already in a text.
MARK, HEAD, ESCAPE = "\u0001", "\u0001H", "\u0001E"

# Declaration lines, per language.  Go has them at column 0 only; those
# of the others may stand below something that is no declaration itself.
BRACE_STARTS = {
    "go": r"^(func|type)[ \t(]",
    "javascript": r"^[ \t]*(export[ \t]+(default[ \t]+)?)?((async[ \t]+)?function|class)[ \t*]",
    "typescript": r"^[ \t]*((async[ \t]+)?function|class|export)[ \t*{]",
    "rust": (
        r"^[ \t]*(pub(\([^)]*\))?[ \t]+)?((default|const|async|unsafe|extern([ \t]+\"[^\"]*\")?)[ \t]+)*"
        r"(fn|impl|trait|struct|enum)[ \t<]"
    ),
}
PYTHON_START = r"^[ \t]*((async[ \t]+)?def|class)[ \t]"
# A method of an object literal: a name, its parameters and an open body, below
# column 0.  Statements that look like it begin with one of the words.
METHOD = r"^[ \t]+((static|async|get|set)[ \t]+)*[*#]?[A-Za-z_$][0-9A-Za-z_$]*[ \t]*\([^(){}]*\)[ \t]*\{[ \t\r]*$"
NO_METHOD = r"^[ \t]*(if|for|while|switch|catch|with|function|return|do|else)\b"
METHOD_LANGUAGES = ("javascript", "typescript")
# Any other text at a declaration's own column or left of it ends a Python
# declaration, except comments and closing brackets.
PYTHON_BOUNDARY = r"^[ \t]*[^ \t\r\f#)\]}]"
BRACE_OPENS = r"[{(,][ \t\r]*$"
BRACE_CLOSES = r"^[ \t]*[})]"
BRACE_REOPENS = r"\{[ \t\r]*$"

# Where a declaration line names its symbol.  A line these do not
# cover falls back to the keyword guess.
NAMES = {
    "go": r"^func[ \t]*(?:\([^)]*\)[ \t]*)?([0-9A-Za-z_]+)",
    "javascript": r"^(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?(?:function|class)[ \t]*\*?[ \t]*([0-9A-Za-z_$]+)",
    "typescript": r"^(?:async[ \t]+)?(?:function|class)[ \t]*\*?[ \t]*([0-9A-Za-z_$]+)",
    "rust": r"\b(?:fn|trait|struct|enum)[ \t]+([0-9A-Za-z_]+)",
}
METHOD_NAME = r"^(?:(?:static|async|get|set)[ \t]+)*[*#]?([A-Za-z_$][0-9A-Za-z_$]*)[ \t]*\("

# Columns a tab counts for in an indentation.
TAB = 8
# Spans a fold keeps in its last list before it starts another.
RECENT = 256


def _explode(files: DataFrame, language: Column, pieces: Column) -> DataFrame:
    """Turn an array of (symbol, signature, content, start, end) into chunk rows."""
    return (
        files.select(
            "project_id", "path", "file_hash", language.alias("language"),
            # Never empty; the outer form keeps the optimiser from evaluating
            # the pieces once more to filter on their number.
            F.explode_outer(pieces).alias("p"),
        )
        .select(
            T.chunk_id(F.col("path"), F.col("p.content")).alias("chunk_id"),
            "project_id",
            "path",
            "file_hash",
            "language",
            F.col("p.symbol").alias("symbol"),
            F.col("p.signature").alias("signature"),
            F.col("p.content").alias("content"),
            F.col("p.start_line").cast("int").alias("start_line"),
            F.col("p.end_line").cast("int").alias("end_line"),
        )
    )


def _piece(symbol: Column, signature: Column, content: Column, start: Column, end: Column) -> Column:
    return F.struct(
        symbol.alias("symbol"),
        signature.alias("signature"),
        content.alias("content"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
    )


def _whole_file(path: Column, content: Column) -> Column:
    name = base_name(path)
    return F.array(_piece(name, name, content, F.lit(1), T.newline_count(content) + 1))


def _join_lines(lines: Column, first: Column, last: Column) -> Column:
    """Text of lines ``first``..``last`` (0-based, inclusive)."""
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def _positions(lines: Column, test) -> Column:
    """0-based positions of the lines for which ``test(line)`` holds."""
    marked = F.transform(lines, lambda x, i: F.when(test(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _markdown_pieces(content: Column) -> Column:
    """Sections of a Markdown text; empty when it has no heading.

    ``end_line`` is the line on which the next section starts, as an index over
    half-open spans has it; the last section ends on the last line.
    """
    escaped = F.replace(content, F.lit(MARK), F.lit(ESCAPE))
    marked = F.regexp_replace(escaped, F.lit(HEADING), F.lit(HEAD + "$1"))

    def sections(lines: Column) -> Column:
        def cut(starts: Column) -> Column:
            def section(start: Column, i: Column) -> Column:
                last_one = i + 1 == F.size(starts)
                stop = F.when(last_one, F.size(lines)).otherwise(F.get(starts, i + 1))
                body = _join_lines(lines, start, stop - 1)
                body = F.when(last_one, body).otherwise(F.concat(body, F.lit("\n")))
                body = F.substring(body, len(HEAD) + 1, F.length(body))
                body = F.replace(body, F.lit(ESCAPE), F.lit(MARK))
                end_line = F.when(last_one, stop).otherwise(stop + 1)
                return F.struct(body.alias("content"), (start + 1).alias("s"), end_line.alias("e"))

            return F.transform(starts, section)

        return bind(_positions(lines, lambda x: F.startswith(x, F.lit(HEAD))), cut)

    def named(piece: Column) -> Column:
        heading = T.strip_space(F.regexp_extract(piece["content"], HEADING, 1))
        return _piece(heading, heading, piece["content"], piece["s"], piece["e"])

    return F.transform(bind(F.split(marked, "\n", -1), sections), named)


def _declaration_name(language: Column, line: Column) -> Column:
    named = F.lit("")
    for name, pattern in NAMES.items():
        named = F.when(language == name, F.regexp_extract(line, pattern, 1)).otherwise(named)
    guess = T.guess_symbol(line)
    method = F.when(language.isin(*METHOD_LANGUAGES), F.regexp_extract(line, METHOD_NAME, 1)).otherwise("")
    return F.when(named != "", named).when(guess != "", guess).otherwise(method)


def _kind_of_line(language: str):
    """What a line is for the declarations of a language.

    O: a declaration that opens a body; S: one that stands alone; C: the end of a
    body; D: a declaration that lasts until text at its column; B: such text; null: none.
    """
    if language == "python":
        return lambda x: F.when(x.rlike(PYTHON_START), "D").when(x.rlike(PYTHON_BOUNDARY), "B")

    def kind(x: Column) -> Column:
        starts = x.rlike(BRACE_STARTS[language])
        if language in METHOD_LANGUAGES:
            starts = starts | (x.rlike(METHOD) & ~x.rlike(NO_METHOD))
        closes = x.rlike(BRACE_CLOSES) & ~x.rlike(BRACE_REOPENS)
        return F.when(closes, "C").when(starts, F.when(x.rlike(BRACE_OPENS), "O").otherwise("S"))

    return kind


def _marks(language: Column, lines: Column) -> Column:
    """(kind, indent, i) of the lines of some kind, by literal patterns of the language."""

    def marked(kind) -> Column:
        return F.transform(lines, lambda x, i: F.struct(kind(x).alias("kind"), x.alias("line"), i.alias("i")))

    def indented(m: Column) -> Column:
        blanks = F.length(m["line"]) - F.length(F.ltrim(m["line"], F.lit(" \t")))
        tabs = blanks - F.length(F.replace(F.substring(m["line"], F.lit(1), blanks), F.lit("\t"), F.lit("")))
        return F.struct(m["kind"].alias("kind"), (blanks + (TAB - 1) * tabs).alias("indent"), m["i"].alias("i"))

    found = F.lit(None)
    for name in (*BRACE_STARTS, "python"):
        found = F.when(language == name, marked(_kind_of_line(name))).otherwise(found)
    return F.transform(F.filter(found, lambda m: m["kind"].isNotNull()), indented)


def _outermost(marks: Column, total: Column) -> Column:
    """(a, b), first and last line, of the declarations that are in no other one.

    A fold over the marks knows the declaration that is open and its indentation; a
    declaration ends at the first mark for it that is indented no further.
    """
    kind = "array<struct<a:int,b:int>>"
    none = F.array().cast(kind)

    def spans(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))

    def step(s: Column, m: Column) -> Column:
        ends = (s["start"] >= 0) & (m["indent"] <= s["level"]) & m["kind"].isin("C", "D", "B")
        idle = (s["start"] < 0) | (ends & (m["kind"] != "C"))
        alone = idle & (m["kind"] == "S")
        opens = idle & m["kind"].isin("O", "D")
        last = m["i"] - F.when(m["kind"] == "C", 0).otherwise(1)
        found = (
            F.when(ends, F.concat(s["recent"], spans(s["start"], last)))
            .when(alone, F.concat(s["recent"], spans(m["i"], m["i"])))
            .otherwise(s["recent"])
        )

        def state(recent: Column) -> Column:
            full = F.size(recent) >= RECENT
            return F.struct(
                F.when(opens, m["i"]).when(ends, -1).otherwise(s["start"]).alias("start"),
                F.when(opens, m["indent"]).otherwise(s["level"]).alias("level"),
                F.when(full, none).otherwise(recent).alias("recent"),
                F.when(full, F.concat(s["earlier"], F.array(recent))).otherwise(s["earlier"]).alias("earlier"),
            )

        return bind(found, state)

    def finish(s: Column) -> Column:
        rest = F.when(s["start"] >= 0, spans(s["start"], total - 1)).otherwise(none)
        return F.flatten(F.concat(s["earlier"], F.array(s["recent"], rest)))

    zero = F.struct(
        F.lit(-1).alias("start"), F.lit(0).alias("level"), none.alias("recent"),
        F.array().cast(f"array<{kind}>").alias("earlier"),
    )
    return F.aggregate(marks, zero, step, finish)


def _declaration_pieces(language: Column, content: Column) -> Column:
    """Outermost declarations of a code file, at any depth; empty when it has none.

    JavaScript, TypeScript, Rust and, at column 0, Go: a declaration line that opens
    something runs to the first later line that closes it at its column or left of it
    (or to the end of the file), any other declaration line stands alone.  Python: a
    declaration runs to the next text at its column or left of it, without trailing
    blanks.  Declarations inside an open one belong to it.  A text begins with its
    declaration, not with the blanks before it.
    """

    def pieces(lines: Column) -> Column:
        def piece(span: Column) -> Column:
            body = F.ltrim(_join_lines(lines, span["a"], span["b"]), F.lit(" \t"))
            trimmed = F.when(language == "python", F.rtrim(body, F.lit(T.SPACE_CHARS))).otherwise(body)
            parts = F.struct(T.strip_space(F.get(lines, span["a"])).alias("signature"), trimmed.alias("body"))
            return bind(
                parts,
                lambda p: _piece(
                    _declaration_name(language, p["signature"]), p["signature"], p["body"],
                    span["a"] + 1, span["a"] + 1 + T.newline_count(p["body"]),
                ),
            )

        return F.transform(_outermost(_marks(language, lines), F.size(lines)), piece)

    empty = F.slice(_whole_file(F.col("path"), content), 1, 0)
    return F.when(language.isin("python", *BRACE_STARTS), bind(T.lines(content), pieces)).otherwise(empty)


def _or_whole_file(pieces: Column) -> Column:
    return bind(
        pieces,
        lambda p: F.when(F.size(p) > 0, p).otherwise(
            _whole_file(F.col("path"), F.col("content"))
        ),
    )


def whole_file_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file, named after the file."""
    language = T.detect_language(F.col("path"))
    return _explode(files, language, _whole_file(F.col("path"), F.col("content")))


def markdown_sections(files: DataFrame) -> DataFrame:
    """One chunk per Markdown heading; text before the first heading is dropped.

    A text without headings becomes one whole-file chunk.
    """
    pieces = _or_whole_file(_markdown_pieces(F.col("content")))
    return _explode(files, F.lit("markdown"), pieces)


def _with_language(files: DataFrame) -> DataFrame:
    """Name each file's language once, below everything that asks for it."""
    return files.withColumn("_language", T.detect_language(F.col("path")))


def declaration_chunks(files: DataFrame) -> DataFrame:
    """One chunk per outermost declaration of a code file.

    A file without declarations becomes one whole-file chunk.
    """
    language = F.col("_language")
    pieces = _or_whole_file(_declaration_pieces(language, F.col("content")))
    return _explode(_with_language(files), language, pieces)


def _last_of_each_text(pieces: Column) -> Column:
    """Keep one piece per distinct text, the one furthest down.

    Two equal texts in one file have one chunk id.  They can only meet inside a
    file, so they are told apart here and not in a shuffle of all chunks.
    """
    by_text = F.transform(
        pieces,
        lambda p: F.struct(
            p["content"].alias("content"), p["start_line"].alias("start_line"),
            p["end_line"].alias("end_line"), p["symbol"].alias("symbol"),
            p["signature"].alias("signature"),
        ),
    )

    def keep_last(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda p, i: ~p["content"].eqNullSafe(F.get(ordered, i + 1)["content"]),
        )

    return bind(F.array_sort(by_text), keep_last)


def chunk_files(files: DataFrame, *, distinct: bool = False) -> DataFrame:
    """Chunk every file by the rule for its language.

    ``distinct`` leaves one row per chunk id, as the index stores it.
    """
    language, content = F.col("_language"), F.col("content")
    pieces = _or_whole_file(
        F.when(language == "markdown", _markdown_pieces(content)).otherwise(
            _declaration_pieces(language, content)
        )
    )
    pieces = _last_of_each_text(pieces) if distinct else pieces
    return _explode(_with_language(files), language, pieces)
