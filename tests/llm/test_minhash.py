import numpy as np
import oracle
import pytest
from helpers import ODD_ROWS, near_components, no_docs, odd_docs, shingles

from textquarry.llm import kernels, minhash, queries
from textquarry.llm.components import components


def family(seed, size, words=120, change=0.04, other=3):
    """Copies of a text with some words changed: similarities around the bound."""
    random = np.random.default_rng(seed)
    base = [f"w{seed}_{k}" for k in random.integers(0, 400, words)]
    out = []
    for _ in range(size):
        text = list(base)
        for k in np.flatnonzero(random.random(words) < change * random.random() * other):
            text[k] = f"c{random.integers(0, 10**6)}"
        out.append(" ".join(text))
    return out


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("width", [4, 5])
def test_links_equal_all_pairs(spark, width):
    texts = [t for s in range(6) for t in family(s, 25)] + [f"only {i} here" for i in range(20)]
    texts += texts[:5]
    order = np.random.default_rng(1).permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(minhash.near_duplicates(docs, width=width))
    want = near_components(rows, width)
    assert {i: c for i, (_, c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())
    assert {i: n for i, (n, _, _) in got.items()} == {i: len(shingles(t, width)) for i, t in rows}


def test_open_buckets_are_settled(spark, monkeypatch):
    """Blocks of two rows, so that the second phase has many groups."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rows = list(enumerate(family(9, 60, words=60, change=0.05)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(minhash.near_duplicates(docs, width=4))
    assert {i: c for i, (_, c, _) in got.items()} == near_components(rows, 4)


def test_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark), width=5).collect()
    assert len(got) == len(ODD_ROWS)
    want = near_components([(i, t) for i, t, _ in ODD_ROWS], 5)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
    assert want[7] == 6 and want[2] == 1 and want[4] == 4


def test_empty_table(spark):
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_signatures_estimate_similarity():
    random = np.random.default_rng(3)
    a = np.unique(random.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2000], np.unique(random.integers(0, 2**63, 1000).astype(np.uint64))])
    sig = minhash.signatures([a, b, a[:0], a[:1]], 512)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.07
    assert (sig[2] == 0xFFFFFFFF).all() and not (sig[3] == 0xFFFFFFFF).any()


def test_kernels_place_does_not_matter():
    texts = kernels.Texts([b"alpha beta", b"", b"  beta alpha\n", b"x" * 400_000 + b" beta"])
    hashes = texts.word_hashes()
    parts = [hashes[a:b] for a, b in zip(texts.first[:-1], texts.first[1:], strict=True)]
    assert parts[0][0] == parts[2][1] and parts[0][1] == parts[2][0] == parts[3][1]
    assert len(parts[1]) == 0 and len(set(hashes.tolist())) == 3


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(links.where("a < 0")).count() == 0


def test_query_equals_sql(spark):
    folder, name = "/root/testdata/sf0.001", "op2_circulant_minhash"
    con = oracle.connect(folder)
    assert oracle.compare(queries.QUERIES[name](spark, folder), con, queries.ORACLES[name]) is None
