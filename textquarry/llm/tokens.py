"""Public tokenizers inside tasks, with a cache of encoded segments.

A text is encoded segment by segment.  Segments end where the tokenizer's own
splitting always ends a piece, so the joined ids equal those of the whole text;
most segments repeat, and each distinct one is encoded by the tokenizers library
once per worker process.  The vocabulary file is a parameter: a path that every
executor can open.
"""

from __future__ import annotations

import operator
import os

import numpy as np

from textquarry.llm import kernels

CACHED = 500_000
# Texts encoded together: more of them share more segments and take more memory.
TEXTS = 512
# All characters that are white space to Python or to the tokenizers' patterns.
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c == "\u180e")
_LAST = operator.itemgetter(-1)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(name if os.path.sep in name else vocabulary(name))
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


class Known(dict):
    """Encoded segments that a worker keeps; asking for others notes them down."""

    def __init__(self, limit: int = CACHED):
        super().__init__()
        self.limit = limit
        self.asked: set = set()

    def __missing__(self, segment) -> None:
        self.asked.add(segment)

    def missing(self) -> set:
        """Segments asked for in vain since the last call."""
        asked, self.asked = self.asked, set()
        return asked

    def keep(self, fresh: dict) -> None:
        """Keep encoded segments while there is room."""
        if len(self) + len(fresh) <= self.limit:
            self.update(fresh)


def filled(segments: list, got: list, fresh: dict) -> list:
    """``got`` with the missing places taken from ``fresh``."""
    at = -1
    try:
        while True:
            at = got.index(None, at + 1)
            got[at] = fresh[segments[at]]
    except ValueError:
        return got


class Encoder:
    """Ids of texts as little-endian bytes, ``width`` bytes an id.

    ``name`` is a vocabulary file of the public package or a path.  ``spaced``
    tells how segments are cut: True for byte-level vocabularies whose pieces
    carry the blank before them, False for those that drop white space.
    """

    def __init__(self, name: str, spaced: bool, width: int):
        self.tokenizer = _load(name)
        self.spaced, self.dtype = spaced, np.dtype(f"<u{width}")
        self.cache = Known()
        # Many segments are encoded as one text, with this piece between them.
        self.between, self.mark = ("\n", "\n") if spaced else (" \x00 ", "\x00")
        found = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = found[0] if len(found) == 1 else None
        # Letters and a stop after them are always pieces of their own.
        self.stops = self._encode_all(list(",.;:!?"))
        self.line_feed = self._bytes(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    @classmethod
    def get(cls, name: str, spaced: bool, width: int) -> Encoder:
        key = ("encoder", name, spaced, width)
        return kernels.kept_vocabulary(key, lambda: cls(name, spaced, width))

    def _segments(self, text: str) -> list[str]:
        """Segments of a text.

        If ``spaced``, a segment but the first stands after a blank, unless it
        begins with a blank or a line feed itself (see ``_literal``).
        """
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        parts = text.replace("\n", " \n").split(" ")
        # White space opens a new piece only after something that is none.
        if "" not in parts and _SPACES.isdisjoint(map(_LAST, parts)):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            part = part if part[:1] == "\n" else " " + part
            if out[-1] and out[-1][-1] not in _SPACES:
                out.append(part)
            else:
                out[-1] += part
        # An own line feed after a blank was given one more blank above.
        if " \n" in text:
            return self._plain_segments(text)
        return [out[0], *[p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p for p in out[1:]]]

    @staticmethod
    def _plain_segments(text: str) -> list[str]:
        """The same for a text in which a blank stands before a line feed."""
        parts = text.split(" ")
        out = [parts[0]]
        for part in parts[1:]:
            if out[-1] and out[-1][-1] not in _SPACES:
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return [out[0], *[p[1:] if p[1:2] not in ("", " ", "\n") else p for p in out[1:]]]

    @staticmethod
    def _literal(segment: str) -> str:
        """The text that a segment of a ``spaced`` vocabulary stands for."""
        return segment if segment[:1] in ("", " ", "\n") else " " + segment

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _encode_all(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments, each as it stands; most are encoded together."""
        out: dict[str, bytes] = {}
        mark, width = self.mark, self.dtype.itemsize
        joined = [s for s in segments if mark not in s] if self.mark_id is not None else []
        groups = [joined[a : a + 256] for a in range(0, len(joined), 256)]
        made = self.tokenizer.encode_batch_fast(
            [self.between.join(g) for g in groups], add_special_tokens=False
        )
        for group, one in zip(groups, made, strict=True):
            ids = np.array(one.ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(group) - 1:
                continue  # encoded one by one below
            blob = ids.tobytes()
            begins = [0, *((cuts + 1) * width).tolist()]
            ends = [*(cuts * width).tolist(), len(blob)]
            out.update(zip(group, [blob[a:b] for a, b in zip(begins, ends, strict=True)], strict=True))
        rest = [s for s in segments if s not in out]
        alone = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        out.update((s, self._bytes(e.ids)) for s, e in zip(rest, alone, strict=True))
        return out

    def _fresh(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of segments that are not kept; a word and the mark after it apart."""
        cache = self.cache
        ended = [s for s in missing if s[-1:] in self.stops and s[:-1].lstrip("\n").isalpha()]
        bare = {s[:-1] for s in ended}.difference(cache)
        words = list(bare.union(missing).difference(ended))
        if self.spaced:
            # A word at the start of a line is the line feed and the word.
            lines = [s for s in words if s[0] == "\n" and s[1:].isalpha()]
            texts = {s: self._literal(s) for s in set(words).difference(lines)}
            found = self._encode_all([*{*texts.values(), *[s[1:] for s in lines]}])
            made = {s: found[t] for s, t in texts.items()}
            made.update((s, self.line_feed + found[s[1:]]) for s in lines)
        else:
            made = self._encode_all(words)
        for s in ended:
            made[s] = (made[s[:-1]] if s[:-1] in bare else cache[s[:-1]]) + self.stops[s[-1]]
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; the same as the library gives for the whole text."""
        cut = [self._segments(t) for t in texts]
        heads: dict[str, bytes] = {}
        if self.spaced:  # the first segment has no blank before it
            heads = self._encode_all(list({parts[0] for parts in cut}))
            cut = [[parts[0], parts[1:]] for parts in cut]
        bodies = [parts[1] for parts in cut] if self.spaced else cut
        got = [list(map(self.cache.__getitem__, body)) for body in bodies]
        fresh = self._fresh(list(self.cache.missing()))
        done = [b"".join(filled(b, g, fresh)) for b, g in zip(bodies, got, strict=True)]
        self.cache.keep(fresh)
        if self.spaced:
            return [heads[parts[0]] + rest for parts, rest in zip(cut, done, strict=True)]
        return done
