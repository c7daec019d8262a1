import numpy as np
import pytest
from helpers import ODD_ROWS, PROSE, no_docs, odd_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import decontam, kernels, queries

FOLDER = "/root/testdata/sf0.001"


def plain_tiles(doc, item, least):
    """Greedy tiling by comparing every pair of places."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                    and i + n not in used_i and d + n not in used_d
                ):
                    n += 1
                if n >= least:
                    best.append((-n, i, d))
        if not best:
            return out
        longest = min(best)[0]
        for n, i, d in sorted(best):
            if n == longest and not (used_i & set(range(i, i - n)) or used_d & set(range(d, d - n))):
                used_i |= set(range(i, i - n))
                used_d |= set(range(d, d - n))
                out.append((d, i, -n))


def hashed(tokens):
    return kernels.Texts([" ".join(tokens).encode()]).word_hashes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=25), st.integers(1, 5))
def test_tiles_equal_plain_tiling(doc, item, least):
    assert decontam.tile(hashed(doc), hashed(item), least) == plain_tiles(doc, item, least)


def covered(rows, items, least=5):
    out = {}
    for d, t in rows:
        for i, x in items:
            found = plain_tiles(words(t), words(x), least)
            if found:
                out[d, i] = sum(n for *_, n in found)
    return out


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 900")
    return docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, -1])
def test_pairs_equal_brute_force(spark, small, bound):
    docs, items = small
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    bench = [(r["item_id"], r["text"]) for r in items.limit(12).collect()]
    # Reordered, split and half passages.
    for k, (i, x) in enumerate(bench[:6]):
        w, n = x.split(), len(x.split())
        rows += [(1000 + k, " ".join(w[n // 2 :] + ["between"] + w[: n // 2])), (2000 + k, " ".join(w[: n // 3]))]
    got = decontam.tiled_pairs(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(bench, "item_id long, text string"),
        broadcast_bytes=bound,
    ).collect()
    want = covered(rows, bench)
    assert {(r["doc_id"], r["item_id"]): r["n_covered"] for r in got} == want
    assert all((1000 + k, bench[k][0]) in want for k in range(6))


def test_query_finds_what_contains_an_item(spark):
    got = {r["doc_id"] for r in queries.QUERIES["op9_greedy_string_tiling"](spark, FOLDER).collect()}
    docs = {r["doc_id"]: " ".join(words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {d for d, t in docs.items() if any(x in t for x in items)} <= got


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, -1])
def test_odd_rows(spark, bound):
    half = " ".join(PROSE.split()[30:] + PROSE.split()[:30])
    items = spark.createDataFrame(
        [(1, half), (1, "shorter " * 6), (2, None), (3, ""), (None, PROSE), (4, "few words"), (5, "long " * 12)],
        "item_id long, text string",
    )
    docs = odd_docs(spark)
    kept = decontam.clean_documents(docs, items, broadcast_bytes=bound)
    assert kept.schema == docs.schema
    left = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    want = [(i is not None, i or 0) for i, *_ in ODD_ROWS if i not in (1, 2, 6, 7, 13)]
    assert left == sorted(want)
    assert decontam.contamination(no_docs(spark), items, broadcast_bytes=bound).count() == 0
    assert decontam.contamination(docs, items.where("false"), broadcast_bytes=bound).count() == 0


def test_long_texts_tile():
    doc = np.arange(300_000, dtype=np.uint64)
    assert decontam.tile(doc, doc[1000:1400].copy()) == [(1000, 0, 400)]


@pytest.mark.parametrize("bound", [decontam.BROADCAST_BYTES, -1])
def test_items_shorter_than_a_tile_are_found_whole(spark, bound):
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "a b c d"), (4, "p q r s t u")], "item_id long, text string")
    rows = [(1, "x ALPHA y"), (2, "gamma beta"), (3, "beta\ngamma"), (4, "a b c x d"), (5, "z a b c d z"), (6, "p q r s"), (7, "p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contamination(docs, items, broadcast_bytes=bound).collect()
    assert {(r["doc_id"], r["item_id"], r["n_covered"]) for r in got} == {(1, 1, 1), (3, 2, 2), (5, 3, 4), (7, 4, 5)}


def test_few_leaking_ids_shuffle_no_text(spark, small, capsys):
    docs, items = small
    decontam.clean_documents(docs, items).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
