import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from helpers import ODD_ROWS, WORD, no_docs, odd_docs

from textquarry.llm import quality, queries
from textquarry.llm.tokens import vocabulary

FOLDER = "/root/testdata/sf0.001"
MODEL = sentencepiece.SentencePieceProcessor(model_file=vocabulary(quality.VOCABULARY))


def letters(word):
    return sum(c > "\x7f" or c.isalpha() for c in word)


def plain(text):
    """Measures of a text, one after the other."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    ids = [i for w in words for i in MODEL.encode(w)]
    share = np.array(list(Counter(ids).values())) / max(1, len(ids))
    entropy = -(share * np.log2(share)).sum() / np.log2(min(len(ids), 256)) if len(ids) > 1 else 0.0
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 20 or 100 * len(inside) > 30 * len(words),
        "letters": sum(map(letters, (w for w in words if not re.search("[0-9]", w)))),
        "n_letter_tokens": sum(len(MODEL.encode(w)) for w in words if not re.search("[0-9]", w)),
        "n_tokens": len(ids), "n_byte_tokens": sum(map(MODEL.is_byte, ids)),
        "token_entropy": pytest.approx(entropy, abs=2e-6),
    }


def test_query_equals_plain_counts(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op7_tokeniser_fertility"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r["doc_id"]]["text"])
        assert {k: r[k] for k in want} == want
        assert not (r["base_failed"] and r["kept"])


def test_odd_rows_and_filter(spark):
    docs = odd_docs(spark)
    rated = quality.rate(docs).collect()
    assert len(rated) == len(ODD_ROWS)
    by_id = {r["doc_id"]: r for r in rated}
    for i, t, _ in ODD_ROWS:
        if i is not None:
            want = plain(t)
            assert {k: by_id[i][k] for k in want} == want
    kept = quality.good_documents(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(
        r["doc_id"] or -1 for r in rated if r["kept"]
    )
    assert quality.rate(no_docs(spark)).count() == quality.good_documents(no_docs(spark)).count() == 0


def test_bands_reject_junk_and_keep_prose(spark):
    random = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    digits = " ".join("".join(random.choice(list("0123456789"), 12)) for _ in range(60))
    rubbish = " ".join("".join(chr(c) for c in random.integers(0x12000, 0x12300, 5)) for _ in range(40))
    stuck = " ".join(f"aa{letters[k % 26]}" if k % 9 == 0 else "a" for k in range(200))
    prose = (
        "The river rose quickly after the storm, and every farmer along the valley moved the "
        "animals to higher ground before night fell over their silent fields."
    )
    german = (
        "Der Fluss stieg nach dem Sturm schnell an, und jeder Bauer im Tal brachte seine Tiere vor "
        "Einbruch der Nacht auf höheres Gelände oberhalb der stillen Felder und Wiesen."
    )
    russian = (
        "Река быстро поднялась после бури, и каждый крестьянин в долине до наступления ночи увёл "
        "своих животных на более высокое место над тихими полями и лугами у самого леса возле деревни."
    )
    symbols = " ".join(f"{w[:2]}{m}" for w, m in zip(prose.split(), ["#*", "$$%", "%&"] * 9))
    rows = [(7, symbols, "en"), (1, digits, "en"), (2, rubbish, None), (3, stuck, "en"), (4, prose, "en"), (5, german, "de"), (6, russian, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.good_documents(docs).collect()} == {4, 5, 6}
    scripts = {r["doc_id"]: r["script"] for r in quality.rate(docs).collect()}
    assert (scripts[4], scripts[6], scripts[2]) == ("latin", "cyrillic", "other")
    strict = quality.BANDS | {"en": (50.0, 60.0, 0.0, 0.0, 0.0)}
    assert {r["doc_id"] for r in quality.good_documents(docs, bands=strict).collect()} == {5, 6}
    by_script = {r["doc_id"] for r in quality.good_documents(docs.drop("lang")).collect()}
    assert by_script - {7} == {1, 4, 5, 6}  # digits have no letters, so no script's band


def test_corpus_bands_decide(spark):
    """Labelled junk falls outside the bands of its language, labelled prose stays."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rated = quality.rate(docs).where("not base_failed").join(labels, "doc_id").collect()
    share = lambda q: np.mean([r["kept"] for r in rated if r["quality"] == q])
    assert share(1) >= 0.97 and share(0) <= 0.15


def test_every_measure_rejects(spark):
    """Junk that passes the outer bands, one kind for each measure, among documents of one language."""
    random = np.random.default_rng(11)
    few = "the river valley farmer night storm field house water road morning winter summer garden window market".split()
    common = few + (
        "letter mountain city people school paper station village music doctor history question answer number country family "
        "animal summer kitchen table church bridge forest island ocean planet teacher student office machine engine travel "
        "language science culture army government company business price money century"
    ).split()
    prose = lambda n: " ".join(random.choice(common) for _ in range(n))
    rows = [(i, prose(int(random.integers(150, 250)))) for i in range(300)]
    table = " | ".join(prose(150).split())
    accents = " ".join(f"{w}\u1e9f" if k % 12 == 0 else w for k, w in enumerate(prose(200).split()))
    letters = " ".join("".join(random.choice(list("bcdfghjklm"), 6)) for _ in range(150))
    poor = " ".join(random.choice(few[:14]) for _ in range(150))
    junk = {1000: table, 1001: accents, 1002: letters, 1003: poor}
    docs = spark.createDataFrame(rows + list(junk.items()), "doc_id long, text string").selectExpr("*", "'en' as lang")
    measured = quality._measured(docs, ["doc_id"], "text", "lang", quality.VOCABULARY, quality.BANDS)
    band = quality.corpus_bands(measured, "lang").first()["band"]
    seen = {r["c0"]: r["m"] for r in measured.collect()}
    value = lambda i, a, b="n_tokens": seen[i][a] / seen[i][b]
    assert value(1000, "letters") < band["letters_low"]
    assert value(1001, "n_byte_tokens") > band["spelled_high"]
    assert value(1002, "word_chars") < band["chars_low"]
    assert seen[1003]["token_entropy"] < band["entropy_low"]
    kept = {r["doc_id"] for r in quality.rate(docs).where("kept").collect()}
    assert not kept & set(junk) and len(kept) >= 295
    assert {r["doc_id"] for r in quality.good_documents(docs).collect()} == kept


def test_small_groups_have_the_outer_bands_only(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    measured = quality._measured(docs, ["doc_id"], "text", "lang", quality.VOCABULARY, quality.BANDS)
    assert quality.corpus_bands(measured, "lang").count() == 0
