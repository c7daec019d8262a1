import random
import zlib

import numpy as np
import pytest
from helpers import ODD_ROWS, no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from textquarry.llm import packing, queries, tokenfiles, viterbi
from textquarry.llm.tokens import Encoder, vocabulary
from textquarry.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
ODD_TEXT = st.text(
    st.one_of(st.sampled_from(list(" \n\t\r 　.,'!aeTH1٣é漢🙂́\x1c\x85▁<|>")), st.characters(exclude_categories=["Cs"])),
    max_size=60,
)


def library(name):
    made = Tokenizer.from_file(vocabulary(name))
    made.encode_special_tokens = True
    return made


def whole(name, texts):
    return [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_segments_encode_as_the_whole_text(name, spaced):
    encoder, plain = Encoder(name, spaced, 4), library(name)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(ODD_TEXT, max_size=4))
    def check(texts):
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want

    check()
    alphabet = " \n\ta'Ts,.1é▁"
    texts = ["".join(random.Random(k).choices(alphabet, k=50)) for k in range(2000)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def docs_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_query(spark):
    docs = docs_of(spark)
    got = sorted(queries.QUERIES["op5_token_files"](spark, FOLDER).collect())
    start, want = 0, []
    ids = whole("byte_bpe_50k.json", [docs[i] for i in sorted(docs)])
    for i, one in zip(sorted(docs), ids, strict=True):
        want.append((i, start, len(one) + 1, crc([*one, 0])))
        start += len(one) + 1
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("width,parts", [(2, 1), (4, 5), (2, 40)])
def test_token_files_of_odd_rows(spark, width, parts):
    folder = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(odd_docs(spark), folder, width=width, parts=parts)
    got = tokenfiles.read_tokens(spark, folder).orderBy("start").collect()
    rows = sorted(((i, t or "") for i, t, _ in ODD_ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    want = [[*x, 0] for x in whole("byte_bpe_50k.json", [t for _, t in rows])]
    starts = np.cumsum([0, *map(len, want)])
    assert [r["start"] for r in got] == starts[:-1].tolist()
    decoded = sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got)
    assert decoded == sorted(want)


def test_token_files_of_no_documents(spark):
    folder = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(no_docs(spark), folder)
    assert tokenfiles.read_tokens(spark, folder).count() == 0


# -- packing


def check_layout(rows, capacity):
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by_sequence.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_covers_every_rank_once(histogram):
    rows = packing.plan(histogram, 64)
    slots: dict = {}
    for length, rank, n, first, per, offset in rows.tolist():
        for k in range(n):
            slots.setdefault(first + k // per, []).append((offset + k % per * length, length))
    count = {}
    for length, rank, n, *_ in rows.tolist():
        assert rank == count.get(length, 0)
        count[length] = rank + n
    assert count == histogram
    for held in slots.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64


def test_plan_is_best_fit_decreasing():
    """The same number of sequences as placing piece after piece."""
    for seed in range(20):
        random_ = random.Random(seed)
        histogram = {k: random_.randint(1, 30) for k in random_.sample(range(1, 101), 30)}
        free: list[int] = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fit = [f for f in free if f >= length]
                if fit:
                    free.remove(min(fit))
                    free.append(min(fit) - length)
                else:
                    free.append(100 - length)
        assert len({s for *_, n, first, per, _ in packing.plan(histogram, 100).tolist() for s in range(first, first + -(-n // per))}) == len(free)


def test_packing_query(spark):
    docs = docs_of(spark)
    rows = queries.QUERIES["op6_histogram_best_fit"](spark, FOLDER).collect()
    want = {}
    for i, one in zip(docs, whole("word_bpe_49k.json", list(docs.values())), strict=True):
        one = [*one, 1]
        for k, at in enumerate(range(0, len(one), 4096)):
            part = one[at : at + 4096]
            want[i, k] = (at, len(part), crc(part))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    used = check_layout(rows, 4096)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 4)
    packed = packing.pack(odd_docs(spark), capacity=64).cache()
    rows = packed.collect()
    check_layout(rows, 64)
    want = sum(len(x) + 1 for x in whole("word_bpe_49k.json", [t or "" for _, t, _ in ODD_ROWS]))
    assert sum(r["length"] for r in rows) == want
    cut = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in rows:
        whole_ids = np.frombuffer(cut[r["sequence_id"]]["ids"], "<u4")
        part = whole_ids[r["offset"] : r["offset"] + r["length"]]
        assert part.tobytes() == bytes(r["ids"])
    packed.unpersist()


def test_packing_no_documents(spark):
    assert packing.pack(no_docs(spark)).count() == 0


# -- counts


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_library(fallback):
    pieces = viterbi.read_pieces(viterbi.VOCABULARY)
    pieces = [p for p in pieces if fallback or not p[0].startswith("<0x")]
    made = Tokenizer(models.Unigram(pieces, 0, fallback))
    counter = viterbi.Counter(pieces)

    @settings(max_examples=400, deadline=None)
    @given(ODD_TEXT)
    def check(text):
        want = made.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids if text else []
        assert counter.count([text])[0] == [len(want)]

    check()


def test_ties_and_crossing_pieces():
    """A vocabulary made for ties, with pieces that cross blanks, against the library."""
    for seed in range(30):
        random_ = random.Random(seed)
        names = {"".join(random_.choices("ab▁", k=random_.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0), *[(p, float(-random_.randint(1, 3))) for p in sorted(names)]]
        made, counter = Tokenizer(models.Unigram(pieces, 0, False)), viterbi.Counter(pieces)
        for k in range(40):
            text = "".join(random.Random(k).choices("ab c", k=20))
            want = made.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids
            assert counter.count([text])[0] == [len(want)], (pieces, text)


def test_count_query_and_odd_rows(spark):
    made = Tokenizer(models.Unigram(viterbi.read_pieces(viterbi.VOCABULARY), 0, True))
    docs = docs_of(spark)
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op4_count_only_viterbi"](spark, FOLDER).collect()}
    assert got == {i: len(made.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) for i, t in docs.items()}
    rows = viterbi.count_tokens(odd_docs(spark)).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert viterbi.count_tokens(no_docs(spark)).count() == 0
