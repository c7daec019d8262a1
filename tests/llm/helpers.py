"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PROSE = " ".join(f"word{i % 37}x{i % 11}" for i in range(60))
LINE = "This line stands in many documents and has over forty characters."

# Nulls, empty and blank texts, ties, repeated rows, a long text, one of few words.
ODD_ROWS = [
    (1, PROSE, "en"),
    (2, PROSE + " end", "en"),
    (2, PROSE + " end", "en"),
    (3, None, None),
    (4, "", "fr"),
    (5, " \n\t\n ", "xx"),
    (None, PROSE, "en"),
    (None, None, None),
    (6, "few words", "en"),
    (7, "FEW words", "de"),
    (8, "\n".join([LINE, "short", LINE.upper() + "  ", ""]), "en"),
    (9, f"{LINE}\nother 漢字 🙂", "en"),
    (10, f"  {LINE}", "en"),
    (11, f"{LINE}\n", "es"),
    (12, f"x\n{LINE}\r\ny", "de"),
    (13, "long " * 30_000, "en"),
    (14, "w" * 300_000, "en"),
]


def odd_docs(spark):
    """The rows above with columns whose names clash with those of the operators."""
    rows = [(i, t, g, 0, "n", True, 5, "l", 7) for i, t, g in ODD_ROWS]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, n_words int, node string, kept boolean, "
        "n_chars long, _leaking string, _drops0_id int",
    )


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def shingles(text: str | None, width: int) -> frozenset:
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_components(rows, width: int, percent: int = 80) -> dict:
    """id -> smallest id reachable, by comparing every pair."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def clean_lines(rows, min_chars: int = 40, min_docs: int = 5):
    """Per row (id, lines, dropped, text left), from the rules alone."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(UPPER)
    held: dict[str, set] = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [
            x for x in lines
            if i is None or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i
        ]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out
