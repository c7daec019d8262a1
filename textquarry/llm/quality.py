"""Quality rules: counts of a text, and the fertility of a public tokenizer on it.

A tokenizer fits ordinary prose of its languages: several characters to a token,
few bytes that it has to spell, many different tokens.  Junk shows as few
characters or letters a token (random strings, digits, symbols stuck to words or
standing between them, as in tables: a token without letters counts against a text), a
high share of byte-fallback tokens (other scripts, binary rubbish) or a low token
entropy (the same few tokens again and again).

Bands come from the corpus itself: per language, else per script, the quartiles of each
measure over all documents that pass the base rules, and ``SPREADS`` times the distance
between them outside.  A language and a script with too few documents for quartiles have
only the fixed outer bands, which hold for all.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import kernels
from textquarry.llm.tokens import Known, filled
from textquarry.plans.joins import cut_lineage, fits_broadcast

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WIDTH = 8

# Corpus bands: how many quartile distances outside the quartiles, the least such
# distances, and the documents a group must have.
SPREADS = 4
LEAST_DOCS = 200
BROADCAST_IDS = 1_000_000
CACHED_WORDS = 300_000
FERTILITY = {
    "chars": ("word_chars / n_tokens", 0.05),
    "letters": ("letters / n_tokens", 0.05),
    "spelled": ("n_byte_tokens / n_tokens", 0.01),
    "entropy": ("token_entropy", 0.03),
}

# Outer bands: least and most characters a token; most byte-fallback share; least token
# entropy (in bits, over the most that the text's length or 256 equal tokens allow);
# least letters a token over the words without a digit (numbers and keys are no
# prose).  A language without a band takes that of its script.  They are set
# outside ordinary prose, which has two letters a token even in languages that the
# vocabulary hardly knows; strings of digits or keys, words with symbols stuck to
# them, text that the vocabulary has to spell in bytes, and the same few tokens over
# and over fall outside.
BANDS = {
    "en": (1.4, 7.0, 0.05, 0.50, 1.5),
    "fr": (1.4, 7.0, 0.05, 0.50, 1.5),
    "de": (1.4, 7.0, 0.05, 0.50, 1.5),
    "es": (1.4, 7.0, 0.05, 0.50, 1.5),
    "latin": (1.3, 8.0, 0.10, 0.50, 1.2),
    "cyrillic": (1.0, 6.0, 0.15, 0.50, 0.9),
    "cjk": (0.3, 3.0, 0.75, 0.50, 0.2),
    "other": (0.2, 8.0, 0.95, 0.40, 0.0),
}
ENTROPY_TOKENS = 256

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, script string, n_tokens long, n_byte_tokens long, "
    "letters long, n_letter_tokens long, token_entropy double"
)


class Pieces:
    """Token ids and byte-fallback counts of words, each distinct word encoded once."""

    def __init__(self, name: str):
        import sentencepiece

        if os.path.sep not in name:
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.model = sentencepiece.SentencePieceProcessor(model_file=name)
        size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)], dtype=bool)
        self.cache = Known(CACHED_WORDS)

    @classmethod
    def get(cls, name: str) -> Pieces:
        return kernels.kept_vocabulary(("pieces", name), lambda: cls(name))

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        got = list(map(self.cache.__getitem__, words))
        missing = list(self.cache.missing())
        if missing:
            made = self.model.encode([w.decode() for w in missing], num_threads=1)
            fresh = {w: np.array(m, dtype="<u2").tobytes() for w, m in zip(missing, made, strict=True)}
            got = filled(words, got, fresh)
            self.cache.keep(fresh)
        counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 2
        return np.frombuffer(b"".join(got), dtype="<u2"), counts


def _byte_table(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
# ASCII letters, and the lead byte of every character beyond ASCII.
LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]


def _script(blob: np.ndarray) -> str:
    """Script of most letters, told from the lead bytes of their UTF-8 form."""
    count = np.bincount(blob, minlength=256)
    ascii_letters = int(count[65:91].sum() + count[97:123].sum())
    shares = {
        "latin": ascii_letters + int(count[0xC3:0xCA].sum()),
        "cyrillic": int(count[0xD0:0xD4].sum()),
        "cjk": int(count[0xE3:0xEE].sum()),
        "other": int(count[0xCA:0xD0].sum() + count[0xD4:0xE3].sum() + count[0xEE:].sum()),
    }
    return max(shares, key=lambda k: shares[k]) if any(shares.values()) else "other"


def _repeated_words(rolled: np.ndarray, n_words: int, width: int) -> int:
    """Words inside windows that occur twice or more."""
    if not len(rolled):
        return 0
    _, back, times = np.unique(rolled, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    edge = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _verdict(row: dict, lang: str | None, bands: dict) -> tuple[bool, bool]:
    """(base_failed, kept) of a text's measures."""
    words, tokens = row["n_words"], row["n_tokens"]
    base_failed = words < MIN_WORDS or 100 * row["n_repeat_words"] > MAX_REPEAT_PERCENT * words
    if base_failed or not tokens:
        return base_failed, False
    least, most, spelled, entropy, letters = bands.get(lang) or bands[row["script"]]
    kept = (
        least * tokens <= row["word_chars"] <= most * tokens
        and row["n_byte_tokens"] <= spelled * tokens
        and row["token_entropy"] >= entropy
        and row["letters"] >= letters * row["n_letter_tokens"]
    )
    return base_failed, kept


def measure_texts(blobs: list[bytes], langs: list, vocabulary: str, bands: dict) -> dict[str, list]:
    """Columns of MEASURES for texts in UTF-8."""
    pieces = Pieces.get(vocabulary)
    out: dict[str, list] = {m.split()[0]: [] for m in MEASURES.split(", ")}
    for begin, part in kernels.slices(blobs):
        for i, row in enumerate(_measure_slice(part, pieces)):
            row["base_failed"], row["kept"] = _verdict(row, langs[begin + i], bands)
            for name, column in out.items():
                column.append(row[name])
    return out


def _measure_slice(part: list[bytes], pieces: Pieces) -> Iterator[dict]:
    texts = kernels.Texts(part)
    words = texts.word_hashes(lower=False)
    rolled, _ = kernels.windows(words, texts.first, REPEAT_WIDTH)
    running = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    heads = running((texts.data & 0xC0) != 0x80)
    symbols = running(_byte_table(SYMBOLS)[texts.data])
    chars = running(heads[texts.ends] - heads[texts.starts])
    digits = running(_byte_table(DIGITS)[texts.data])
    plain = digits[texts.ends] == digits[texts.starts]
    letters = running(_byte_table(LETTERS)[texts.data])
    letters = running(np.where(plain, letters[texts.ends] - letters[texts.starts], 0))
    begin, stop, first_line = texts.lines()
    line = kernels.span_hashes(texts.data, begin, stop, "raw")
    wordy = np.searchsorted(texts.starts, stop) > np.searchsorted(texts.starts, begin)
    raw = texts.data.tobytes()
    spelled = [raw[a:b] for a, b in zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)]
    for i in range(len(part)):
        a, b = int(texts.first[i]), int(texts.first[i + 1])
        at, end = int(texts.at[i]), int(texts.at[i] + texts.size[i])
        of_text = slice(first_line[i], first_line[i + 1])
        lines = line[of_text][wordy[of_text]]
        ids, per_word = pieces.ids(spelled[a:b])
        entropy = 0.0
        if len(ids) > 1:
            share = np.unique(ids, return_counts=True)[1] / len(ids)
            entropy = -(share * np.log2(share)).sum() / np.log2(min(len(ids), ENTROPY_TOKENS))
        yield {
            "n_words": b - a,
            "word_chars": int(chars[b] - chars[a]),
            "n_symbols": int(symbols[end] - symbols[at]),
            "n_dup_lines": len(lines) - len(np.unique(lines)),
            "n_repeat_words": _repeated_words(
                rolled[a : max(a, b - REPEAT_WIDTH + 1)], b - a, REPEAT_WIDTH
            ),
            "script": _script(texts.data[at:end]),
            "n_tokens": len(ids),
            "n_byte_tokens": int(pieces.is_byte[ids].sum()),
            "letters": int(letters[b] - letters[a]),
            "n_letter_tokens": int(per_word[plain[a:b]].sum()),
            "token_entropy": round(float(entropy), 6),
        }


def _langs(batch, lang_at: int | None) -> list:
    return [None] * batch.num_rows if lang_at is None else batch.column(lang_at).to_pylist()


def _measured(docs: DataFrame, columns: list[str], text_col: str, lang_col: str | None, vocabulary: str, bands: dict):
    """Some columns of ``docs``, and in a last one its language and measures; written out."""
    read_lang = lang_col if lang_col in docs.columns else None
    names = list(dict.fromkeys([*columns, text_col, *([read_lang] if read_lang else [])]))
    wanted = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    text_at, lang_at = names.index(text_col), names.index(read_lang) if read_lang else None
    held = [f"c{k}" for k in range(len(columns))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in kernels.cuts(batches):
            blobs, langs = kernels.blobs_of(batch.column(text_at)), _langs(batch, lang_at)
            made = measure_texts(blobs, langs, vocabulary, bands)
            made = pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), **made})
            parts = [batch.column(k) for k in range(len(held))]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(made.to_struct_array())], names=[*held, "m"])

    kinds = [f"{c} {wanted.schema[c].dataType.simpleString()}" for c in held]
    return cut_lineage(wanted.mapInArrow(run, ", ".join([*kinds, f"m struct<lang string, {MEASURES}>"])), "measured")


def corpus_bands(measured: DataFrame, group: str) -> DataFrame:
    """(group, band): quartiles of the measures of a group, moved outwards; a row a group.

    ``measured`` has the language and measures as ``m``.
    """
    passed = measured.select("m.*").where(f"not base_failed and n_tokens > 0 and {group} is not null")
    quartiles = [
        F.percentile_approx(F.expr(x), F.lit([0.25, 0.75]), F.lit(10_000)).alias(name) for name, (x, _) in FERTILITY.items()
    ]
    found = passed.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"), *quartiles)
    sides = []
    for name, (_, least) in FERTILITY.items():
        reach = F.greatest(F.col(name)[1] - F.col(name)[0], F.lit(least)) * SPREADS
        sides += [
            F.round(F.col(name)[0] - reach, 4).alias(f"{name}_low"), F.round(F.col(name)[1] + reach, 4).alias(f"{name}_high")
        ]
    return found.where(F.col("n") >= LEAST_DOCS).select("_group", F.struct(*sides).alias("band"))


def _judged(measured: DataFrame) -> DataFrame:
    """Measured rows with the final verdict: inside the outer and the corpus bands."""
    for group in ("lang", "script"):
        bands = corpus_bands(measured, group).withColumnRenamed("band", f"by_{group}")
        on = F.col(f"m.{group}") == F.col("_group")
        # One row a language or script with many documents.
        bands = F.broadcast(bands) if fits_broadcast(bands) else bands
        measured = measured.join(bands, on, "left").drop("_group")
    rows = measured.withColumn("band", F.coalesce("by_lang", "by_script")).drop("by_lang", "by_script")
    value = {name: F.expr(re.sub(r"\b([a-z_]+)\b", r"m.\1", x)) for name, (x, _) in FERTILITY.items()}
    inside = (
        value["chars"].between(F.col("band.chars_low"), F.col("band.chars_high"))
        & (value["letters"] >= F.col("band.letters_low"))
        & (value["spelled"] <= F.col("band.spelled_high"))
        & (value["entropy"] >= F.col("band.entropy_low"))
    )
    outer = F.col("m.kept") & (F.col("m.n_tokens") > 0)
    return rows.withColumn("inside", F.when(outer, F.coalesce(inside, F.lit(True))).otherwise(F.lit(False)))


def rate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    vocabulary: str = VOCABULARY,
    bands: dict = BANDS,
) -> DataFrame:
    """The id and MEASURES of every row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``; each is encoded by the vocabulary
    as it stands after a blank.  base_failed: fewer than 20 words, or more than
    30 % of the words inside 8-word windows that occur twice.  kept: not
    base_failed, and characters a token, letters a token, byte-fallback share and
    token entropy inside the outer bands and, where its language, else its script,
    has documents enough, inside those of the corpus.

    A null text has no words; a text without words fails the base rules and has
    entropy 0; a text of any length is measured whole.  A null or unknown language
    goes by the script.  Repeated rows give repeated results, a null id stays null,
    other columns are not read, an empty table gives no rows.
    """
    judged = _judged(_measured(docs, [id_col], text_col, lang_col, vocabulary, bands))
    measures = [F.col(f"m.{n}") for n in (m.split()[0] for m in MEASURES.split(", ")) if n != "kept"]
    return judged.select(F.col("c0").alias(id_col), *measures, F.col("inside").alias("kept"))


def good_documents(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str | None = "lang",
    vocabulary: str = VOCABULARY,
    bands: dict = BANDS,
) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns.

    Texts are measured once, and what comes back is narrow.  A verdict depends on the
    text and its language alone, so the rejected ones are named by a digest of 128 bits;
    measured to be few they travel to the documents, and no text is shuffled.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None)
    texts = docs.select(digest.alias("key"), F.col(f"`{text_col}`").alias("text"), lang.cast("string").alias("lang"))
    judged = _judged(_measured(texts, ["key"], "text", "lang", vocabulary, bands))
    bad = judged.where("not inside").select(F.col("c0").alias("_bad"), F.col("m.lang").alias("_of")).distinct()
    bad = cut_lineage(bad, "rejected")
    bad = F.broadcast(bad) if fits_broadcast(bad, max_rows=BROADCAST_IDS) else bad
    same = (digest == bad["_bad"]) & lang.cast("string").eqNullSafe(bad["_of"])
    return docs.join(bad, same, "left_anti")
