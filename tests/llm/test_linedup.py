import hashlib

import numpy as np
import oracle
import pytest
from helpers import LINE, ODD_ROWS, clean_lines, no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import linedup, queries
from textquarry.llm.cuckoo import CuckooFilter

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    name = "op3_reversible_line_dedup"
    con = oracle.connect(FOLDER)
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name]) is None


def test_odd_rows_and_clashing_names(spark):
    docs = odd_docs(spark)
    got = linedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = clean_lines([(i, t) for i, t, _ in ODD_ROWS])
    assert rows_of(got) == sorted(want, key=repr)
    assert {r[0] for r in want if r[2]} == {8, 9, 10, 11}  # the largest holder keeps its line


def test_empty_table(spark):
    assert linedup.dedup_lines(no_docs(spark)).count() == 0


def state(index):
    counts = {(r["h1"], r["h2"]): (r["n_docs"], r["keeper"]) for r in index.counts().collect()}
    filters = {r["shard"]: CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.filters().collect()}
    return counts, filters


def test_insertions_and_deletions_are_reversible(spark):
    lines = [f"{LINE} number {k}" for k in range(6)]
    rows = [(i, "\n".join(x for k, x in enumerate(lines) if (i + k) % (k + 1) == 0)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    index = linedup.LineIndex(spark, shards=4)
    index.insert(docs.where("doc_id < 10"))
    once = state(index)[0]
    index.insert(docs.where("doc_id >= 10"))
    index.insert(docs.where("doc_id between 5 and 12"))  # known already: no effect
    both = linedup.LineIndex(spark, shards=4)
    both.insert(docs)
    assert state(index)[0] == state(both)[0]
    assert rows_of(index.clean(docs)) == rows_of(both.clean(docs)) == sorted(clean_lines(rows), key=repr)
    index.delete(docs.where("doc_id >= 10").select("doc_id"))
    counts, filters = state(index)
    assert counts == once
    for (h1, h2), (n, _) in counts.items():
        shard = filters.get(h1 % 4)
        known = shard is not None and shard.contains(np.array([h1]), np.array([h2]))[0]
        assert known or n < linedup.MIN_DOCS
    few = [r for r in rows if r[0] < 10]
    assert rows_of(index.clean(docs.where("doc_id < 10"))) == sorted(clean_lines(few), key=repr)
    docs.unpersist()


def test_filters_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(linedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(linedup, "PROBE_ROWS", 1)
    monkeypatch.setattr(linedup, "SHARDS", 2)
    got = linedup.dedup_lines(odd_docs(spark))
    assert rows_of(got) == sorted(clean_lines([(i, t) for i, t, _ in ODD_ROWS]), key=repr)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**62), unique=True, max_size=400), st.integers(0, 10**6))
def test_cuckoo_filter(keys, seed):
    h1 = np.array(keys, dtype=np.int64)
    h2 = np.random.default_rng(seed).integers(-(2**62), 2**62, len(keys))
    made = CuckooFilter.of(h1, h2)
    made = CuckooFilter.from_bytes(made.to_bytes())
    assert made.contains(h1, h2).all()
    half = len(keys) // 2
    made.remove_all(h1[:half], h2[:half])
    assert made.contains(h1[half:], h2[half:]).all()
    made.remove_all(h1[half:], h2[half:])
    assert not made.table.any()


def test_full_filter_is_left_as_it_was():
    made = CuckooFilter(1)
    keys = np.arange(6, dtype=np.int64)
    marks = keys << 48 | 1 << 50
    assert made.add_all(keys[:4], marks[:4])
    before = made.table.copy()
    assert not made.add_all(keys[4:], marks[4:])
    assert (made.table == before).all()


@pytest.mark.parametrize("text", ["", "a", "a\n\nb\n"])
def test_digest_of_text_left(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    left = linedup.dedup_lines(docs).first()["text"]
    assert hashlib.sha256(left.encode()).digest() == hashlib.sha256(text.encode()).digest()


def test_reopened_index_goes_on(spark):
    """Two objects on one folder: counts go on, the settings stay, a stale one cannot write."""
    line = "x" * 50
    docs = lambda *ids: spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string")
    first = linedup.LineIndex(spark, shards=3)
    first.insert(docs(1, 2, 3, 4, 5))
    again = linedup.LineIndex(spark, first.folder)
    assert (again.version, again.shards) == (1, 3)
    again.insert(docs(6))
    assert [(r["n_docs"], r["keeper"]) for r in again.counts().collect()] == [(6, 6)]
    with pytest.raises(RuntimeError, match="version 2"):
        first.insert(docs(7))
    third = linedup.LineIndex(spark, first.folder)
    third.delete(docs(6).select("doc_id"))
    assert [(r["n_docs"], r["keeper"]) for r in third.counts().collect()] == [(5, 5)]
    kept = {r["doc_id"]: r["text"] for r in third.clean(docs(1, 2, 3, 4, 5)).collect()}
    assert kept == {1: "", 2: "", 3: "", 4: "", 5: line}


def test_unfinished_version_is_written_again(spark):
    """A writer that died left tables without a mark: they do not count."""
    docs = spark.createDataFrame([(1, "y" * 50)], "doc_id long, text string")
    index = linedup.LineIndex(spark)
    index.insert(docs)
    index._read("postings").write.parquet(f"{index.folder}/postings/v2")
    again = linedup.LineIndex(spark, index.folder)
    again.insert(docs.withColumn("doc_id", docs["doc_id"] + 1))
    assert [r["n_docs"] for r in again.counts().collect()] == [2]
