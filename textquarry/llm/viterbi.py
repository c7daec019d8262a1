"""Token counts of a unigram tokenizer without its tokens.

The pieces and scores of a public SentencePiece vocabulary are read as a unigram
model: the best split of a text is the one with the highest sum of scores.  An
Aho-Corasick automaton enumerates the vocabulary's matches; the dynamic program
carries the best score and the number of its pieces at every place, and keeps no
way back.

Rules of the unigram tokenizer, for exact ties: of two splits that end at the
same place with equal scores the one whose last piece starts earlier wins; a
character that is no piece may stand for itself at the lowest score less 10, and
counts as its UTF-8 bytes where the vocabulary spells bytes, else as one unknown
token together with unknown neighbours.

Scores of such vocabularies are whole numbers, so sums are exact and a text may
be cut wherever no piece can cross: before a word mark that follows another
character.  Each distinct segment is worked out once per worker process.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.llm.tokens import Known, filled

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(name: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file, in the order of ids."""
    import sentencepiece

    if os.path.sep not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=name)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Counts pieces of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        known = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.spells = [f"<0x{b:02X}>" in known for b in range(256)]
        # Cutting needs whole scores and pieces that have the mark only in front.
        self.cuts = all(MARK not in p.lstrip(MARK) for p in known) and all(
            float(s).is_integer() for _, s in pieces
        )
        self.cache = Known()

    @classmethod
    def get(cls, name: str) -> Counter:
        return kernels.kept_vocabulary(("counter", name), lambda: cls(read_pieces(name)))

    def best(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best split of a marked text."""
        n = len(text)
        score, count, lone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        end, match = next(matches, (n, None))
        for i in range(n):
            top, start, single = 0.0, -1, False
            while end == i:
                length, gain = match
                s = i + 1 - length
                candidate = score[s] + gain
                if start < 0 or candidate > top or (candidate == top and s < start):
                    top, start = candidate, s
                single = single or length == 1
                end, match = next(matches, (n, None))
            after = False
            if not single:
                candidate = score[i] + self.unknown
                if start < 0 or candidate > top:
                    top, start, after = candidate, i, True
            if not after:
                pieces = count[start] + 1
            else:
                spelled = text[i].encode("utf-8", "surrogatepass")
                if all(self.spells[b] for b in spelled):
                    pieces = count[i] + len(spelled)
                    # Spelled characters are tokens of their own.
                    after = False
                else:
                    pieces = count[i] + (0 if lone[i] else 1)
            score[i + 1], count[i + 1], lone[i + 1] = top, pieces, after
        return count[n], score[n]

    def segments(self, text: str) -> list[str]:
        """A text with word marks, cut where no piece crosses."""
        if not text:
            return []
        if not self.cuts:
            return [MARK + text.replace(" ", MARK)]
        parts = text.split(" ")
        if "" not in parts and MARK not in text:
            return parts  # the mark in front is understood
        marked = MARK + text.replace(" ", MARK)
        return [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def count(self, texts: list[str]) -> tuple[list[int], list[float]]:
        """Pieces and scores of texts; an empty text has none."""
        counts, scores = [], []
        for text in texts:
            segments = self.segments(text)
            got = list(map(self.cache.__getitem__, segments))
            mark = MARK if self.cuts else ""
            fresh = {s: self.best(mark + s) for s in self.cache.missing()}
            got = filled(segments, got, fresh)
            self.cache.keep(fresh)
            counts.append(sum(n for n, _ in got))
            scores.append(sum((x for _, x in got), 0.0))
        return counts, scores


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(id, n_tokens, score) of every row: pieces of the best split and its score.

    A text is marked as ``\\u2581`` + text with blanks as ``\\u2581``.  Null and
    empty texts have no tokens and score 0; a text of any length is one split.  Rows
    count on their own: a null id stays null, repeated rows give repeated results,
    other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter.get(vocabulary)
        for batch in batches:
            counts, scores = counter.count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())],
                names=[id_col, "n_tokens", "score"],
            )

    wanted = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = wanted.schema[0].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, score double")
