"""Text expressions shared by chunking, notes and search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.paths import extension

# File extension -> language name.
LANGUAGE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".rs": "rust",
    ".md": "markdown",
    ".markdown": "markdown",
}

# Fixed value: keyword followed by a name, as seen in a declaration line.
SYMBOL_GUESS = r"(?:func|def|fn|class|struct|enum|trait|impl|type|const|var)[ \t\n\f\r]+(\w+)"

SPACE_CHARS = " \t\n\u000b\f\r"


def detect_language(path: Column) -> Column:
    """Language of a file by its extension; ``''`` when unknown."""
    ext = extension(path)
    by_language: dict[str, list[str]] = {}
    for suffix, language in LANGUAGE_BY_EXTENSION.items():
        by_language.setdefault(language, []).append(suffix)
    out = F.lit("")
    for language, suffixes in by_language.items():
        out = F.when(ext.isin(suffixes), language).otherwise(out)
    return out


def content_hash(content: Column) -> Column:
    """sha256 of the raw bytes, lower-case hex."""
    return F.sha2(content, 256)


def chunk_id(path: Column, content: Column) -> Column:
    """Stable id of a chunk: sha256 over path, newline and chunk text."""
    return F.sha2(F.concat(path, F.lit("\n"), content), 256)


def guess_symbol(line: Column) -> Column:
    """Name after the first declaration keyword in a line, ``''`` if none."""
    return F.regexp_extract(line, SYMBOL_GUESS, 1)


def lines(content: Column) -> Column:
    """Lines of a text, split on ``\\n`` only (a ``\\r`` stays in its line)."""
    return F.split(content, "\n", -1)


def newline_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))


def snippet(content: Column, chars: int) -> Column:
    """First ``chars`` characters plus ``...`` for longer texts.

    Counted in characters, so that a multi-byte character is never cut in two.
    """
    return F.when(
        F.length(content) > chars,
        F.concat(F.substring(content, 1, chars), F.lit("...")),
    ).otherwise(content)


def strip_space(text: Column) -> Column:
    """Trim spaces, tabs and line breaks on both sides."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def slugify(title: Column) -> Column:
    """File-name form of a title: ``[a-z0-9-]``, 60 characters at most."""
    dashed = F.regexp_replace(F.lower(strip_space(title)), "[^a-z0-9-]", "-")
    cut = F.substring(F.btrim(dashed, F.lit("-")), 1, 60)
    return F.regexp_replace(cut, r"\A\z", "note")


def escape_headings(text: Column) -> Column:
    """Put a backslash before every ``#`` so that it cannot open a heading."""
    return F.replace(text, F.lit("#"), F.lit("\\#"))


def printable_runs(content: Column) -> Column:
    """Runs of at least four printable ASCII bytes (tab and line breaks count)."""
    latin = F.decode(content.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(latin, F.lit(r"[\t\n\r -~]{4,}"), F.lit(0))


def provider_of_note(content: Column, default: str = "cascade") -> Column:
    """Provider named in a note's first ``- **Provider:**`` line."""
    line = F.regexp_extract(content, r"(?md)^- \*\*Provider:\*\*(.*)$", 1)
    named = F.regexp_like(content, F.lit(r"(?md)^- \*\*Provider:\*\*"))
    value = strip_space(F.replace(line, F.lit("**"), F.lit("")))
    return F.when(named, value).otherwise(F.lit(default))


class InvalidRegex(ValueError):
    """A search expression that cannot be compiled."""


_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NO_WORD_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
_BLANKS = r"\t\n\f\r "
_TOKEN = re.compile(r"\\.|\[:\^?[a-z]+:\]|\[\^?\]?|\]|\(\?[^)]|.", re.DOTALL)


def java_regex(pattern: str) -> str:
    """A linear-time (RE2) search expression in Java's dialect.

    Word edges and blanks are ASCII, ``.`` and ``$`` only know ``\n`` as a line
    end, named groups and POSIX classes are respelled.  What RE2 does not have
    (look-around, back-references) is rejected.
    """
    plain = re.sub(r"\[:\^?[a-z]+:\]|\\[pP](\{[^}]*\}|.)", "a", pattern)
    try:
        re.compile(plain.replace(r"\z", r"\Z"))
    except re.error as err:
        raise InvalidRegex(str(err)) from err
    out, in_class = ["(?d)"], False
    for token in _TOKEN.findall(pattern):
        if in_class:
            if token.startswith("[:"):
                token = re.sub(
                    r"\[:(\^?)([a-z]+):\]",
                    lambda m: ("\\P{" if m[1] else "\\p{") + _POSIX.get(m[2], m[2].title()) + "}",
                    token,
                )
            elif token == r"\s":
                token = _BLANKS
            elif token.startswith("[") or token == "&":
                token = "\\" + token
            elif token == "]":
                in_class = False
        elif token.startswith("["):
            in_class = True
            token = token.replace("]", r"\]")
        elif token in (r"\b", r"\B"):
            token = _WORD_EDGE if token == r"\b" else _NO_WORD_EDGE
        elif token == r"\s":
            token = f"[{_BLANKS}]"
        elif token == r"\S":
            token = f"[^{_BLANKS}]"
        elif re.fullmatch(r"\\[1-9]", token) or token in ("(?=", "(?!", "(?>"):
            raise InvalidRegex(f"not supported in a search expression: {token}")
        elif token == "(?<":
            raise InvalidRegex("not supported in a search expression: (?<")
        elif token == "(?P":
            token = "(?"
        out.append(token)
    return "".join(out)


# POSIX class names whose Java spelling is not just capitalised.
_POSIX = {"xdigit": "XDigit", "ascii": "ASCII", "word": "Alnum"}
