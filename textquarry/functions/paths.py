"""Path expressions and glob patterns.

Paths are absolute and use ``/``.  Prefix questions ("is this file below that
directory?") are answered by listing a path's ancestors, so that they become
equi-joins; ``under_path`` is only for a prefix known when the plan is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last element of a path."""
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Directory holding a path; ``/`` for top-level entries."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.substring(path, F.lit(1), F.greatest(cut, F.lit(1)))


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot of the last path element, or ``''``."""
    return F.regexp_extract(F.lower(base_name(path)), r"(\.[^.]*)\z", 1)


def under_path(path: Column, prefix: str) -> Column:
    """Separator-aware prefix test; ``""`` and ``/`` cover every path."""
    if prefix in ("", "/"):
        return path != ""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


def under_path_column(path: Column, prefix: Column) -> Column:
    """``under_path`` with the prefix taken from each row."""
    return (
        prefix.isin("", "/")
        | (path == prefix)
        | F.startswith(path, F.concat(prefix, F.lit("/")))
    )


def relative_to(path: Column, root: Column) -> Column:
    """``path`` seen from ``root``, which must be one of its ancestors."""
    skip = F.when(root == "/", F.lit(2)).otherwise(F.length(root) + 2)
    return F.substring(path, skip, F.length(path))


def walk_key(path: Column) -> Column:
    """Sort key that orders paths as a lexical directory walk does."""
    return F.split(path, "/", -1)


def ancestors(path: Column) -> Column:
    """All strict ancestor directories of an absolute path, from ``/`` down."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.when(n == 1, F.lit("/")).otherwise(
            F.array_join(F.slice(parts, 1, n), "/")
        ),
    )


def self_and_ancestors(path: Column) -> Column:
    """A path and all directories above it."""
    return F.array_distinct(F.concat(ancestors(path), F.array(path)))


def depth_below(path: Column, root: str) -> Column:
    """Number of path elements below ``root``."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return slashes - (0 if root == "/" else root.count("/"))


# --- globs -----------------------------------------------------------------


class InvalidPattern(ValueError):
    """A glob that cannot be compiled."""


def _class_regex(pattern: str, at: int) -> tuple[str, int]:
    """Translate ``[...]`` starting at ``at``; returns regex and next position."""
    end = at + 1
    if end < len(pattern) and pattern[end] in "!^":
        end += 1
    if end < len(pattern) and pattern[end] == "]":
        end += 1
    while end < len(pattern) and pattern[end] != "]":
        end += 2 if pattern[end] == "\\" else 1
    if end >= len(pattern):
        raise InvalidPattern(pattern)
    body = pattern[at + 1 : end]
    negate = body[:1] in ("!", "^")
    items = re.sub(r"([\[\]^&~])", r"\\\1", body[1:] if negate else body)
    if not items:
        raise InvalidPattern(pattern)
    return ("[^/" if negate else "[") + items + "]", end + 1


def _glob_body(pattern: str) -> str:
    out: list[str] = []
    i, depth = 0, 0
    while i < len(pattern):
        ch = pattern[i]
        opens_component = i == 0 or pattern[i - 1] in "/" or (depth and pattern[i - 1] in "{,")
        if ch == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            after = i + stars
            ends = after == len(pattern) or (depth and pattern[after] in ",}")
            if stars == 2 and opens_component and ends:
                if out and out[-1] == "/":
                    out[-1] = "(?:/.*)?"
                else:
                    out.append(".*")
                i = after
            elif stars == 2 and opens_component and pattern[after] == "/":
                out.append("(?:.*/)?")
                i = after + 1
            else:
                out.append("[^/]*")
                i = after
            continue
        if ch == "?":
            out.append("[^/]")
        elif ch == "[":
            regex, i = _class_regex(pattern, i)
            out.append(regex)
            continue
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\":
            if i + 1 == len(pattern):
                raise InvalidPattern(pattern)
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append("/" if ch == "/" else re.escape(ch))
        i += 1
    if depth:
        raise InvalidPattern(pattern)
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """Anchored regex for a glob.

    ``*`` and ``?`` stay within one path element; ``**`` as a whole element
    crosses any number of them, so ``a/**`` also covers ``a`` itself.  Raises
    :class:`InvalidPattern` for an unclosed class or brace or a trailing ``\\``.
    """
    return r"\A(?:" + _glob_body(pattern) + r")\z"


def patterns_to_regex(patterns) -> str | None:
    """One regex for "matches any of these index rules", ``None`` if none can.

    An invalid pattern matches nothing.  A pattern without ``*``, ``/`` or ``?``
    also covers everything below a directory of that name.
    """
    bodies = []
    for pattern in patterns:
        try:
            bodies.append(_glob_body(pattern))
        except InvalidPattern:
            continue
        if not set(pattern) & set("*/?"):
            bodies.append(re.escape(pattern) + "/.*")
    return r"\A(?:" + "|".join(bodies) + r")\z" if bodies else None


def matches_any(path: Column, patterns) -> Column:
    """True where ``path`` matches at least one index-rule pattern."""
    regex = patterns_to_regex(patterns)
    return F.lit(False) if regex is None else path.rlike("(?s)" + regex)


# --- ignore files ----------------------------------------------------------


def _element_regex(element: str) -> str:
    """Regex of one path element of an ignore pattern."""
    out, i = [], 0
    while i < len(element):
        ch = element[i]
        if ch == "[":
            regex, i = _class_regex(element, i)
            out.append(regex)
            continue
        if ch == "\\":
            if i + 1 == len(element):
                raise InvalidPattern(element)
            i += 1
            out.append(re.escape(element[i]))
        elif ch in "*?":
            out.append("[^/]*" if ch == "*" else "[^/]")
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def ignore_rule(line: str) -> tuple[bool, str] | None:
    """(negated, regex over paths relative to the ignore file) of one of its lines.

    By Git's documented rules: blank lines and comments say nothing, ``!``
    negates, unescaped blanks at the end do not count; a ``/`` before the end
    ties a pattern to the file's directory, one at the end makes it match
    directories only; ``**`` as an element stands for any number of directories.
    A pattern that matches a directory covers everything below it.  An invalid
    pattern matches nothing.
    """
    line = line.removesuffix("\r")
    body = line.rstrip(" ")
    if body.endswith("\\") and body != line:
        body += " "  # an escaped blank
    if not body or body.startswith("#"):
        return None
    negated = body.startswith("!")
    pattern = body[negated:]
    directory = pattern.endswith("/")
    pattern = pattern.rstrip("/") if directory else pattern
    tied = "/" in pattern
    elements = [e for e in pattern.split("/") if e]
    if not elements:
        return None
    regex = "" if tied else "(?:.*/)?"
    try:
        for element in elements[:-1]:
            regex += "(?:.*/)?" if element == "**" else _element_regex(element) + "/"
        last = elements[-1]
        regex += ".+" if last == "**" and tied else _element_regex(last)
    except InvalidPattern:
        return None
    return negated, regex + ("/.*" if directory else "(?:/.*)?")


def ignore_groups(content: str) -> list[tuple[bool, str]]:
    """Rules of an ignore file in order, neighbours of one polarity as one regex."""
    groups: list[tuple[bool, list[str]]] = []
    for line in content.split("\n"):
        rule = ignore_rule(line)
        if rule and groups and groups[-1][0] == rule[0]:
            groups[-1][1].append(rule[1])
        elif rule:
            groups.append((rule[0], [rule[1]]))
    return [(negated, r"\A(?s:" + "|".join(regexes) + r")\z") for negated, regexes in groups]
