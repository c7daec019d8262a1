import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest
from helpers import ODD_ROWS, UPPER, no_docs, odd_docs

from textquarry.llm import queries, variants

FOLDER = "/root/testdata/sf0.001"
NAME = "op11_sorted_list_variants"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, modulus=199, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if modulus and h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 6
    return {w: n for w, n in counts.items() if n >= least}


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def groups(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_sql(spark):
    con = oracle.connect(FOLDER)
    assert oracle.compare(queries.QUERIES[NAME](spark, FOLDER), con, queries.ORACLES[NAME]) is None


@pytest.mark.parametrize("seed", range(40))
def test_scan_finds_every_pair(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 60))})
    want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]
    assert sorted(variants.near_in_list(words)) == want


def test_crc_of_spans():
    data = np.frombuffer(b"abc " + b"x" * 500 + b" de", dtype=np.uint8)
    starts, ends = variants.letter_runs(data)
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(3)], dtype=np.uint32)
    got = variants.span_crcs(data, starts, ends, before)
    assert list(got) == [zlib.crc32(b"%d:" % k + w) for k, w in enumerate(data.tobytes().split())]


@pytest.mark.parametrize("leaf", [1, 3, 1000])
def test_groups_equal_all_pairs(spark, leaf):
    """Hot prefixes and suffixes: with small leaves most pairs are above both lists."""
    r = random.Random(leaf)
    words = {}
    for _ in range(150):
        base = r.choice(["thethe", "anción", "mmmmmm"]) + "".join(r.choice("ab") for _ in range(r.randint(0, 5)))
        at = r.randrange(len(base) + 1)
        word = base[:at] + r.choice(["", "a", "ÿ"]) + base[at + r.randint(0, 1) :]
        if len(word) >= 6:
            words[word] = r.choice([5, 5, 25, 130, 700])
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert groups(variants.group_variants(table, leaf=leaf)) == plain_groups(words)


def test_long_chain_has_one_root(spark):
    """A form of a form of a form: the root is the last."""
    words = {"a" * (6 + k): 5 ** (k + 1) for k in range(9)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert groups(variants.group_variants(table)) == plain_groups(words)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(i, t) for i, t, _ in ODD_ROWS]
    got = {r["word"]: r["n"] for r in variants.word_counts(docs, drop_modulus=2, min_count=1).collect()}
    assert got == plain_counts(rows, 2, 1)
    found = groups(variants.spelling_variants(docs, drop_modulus=None))
    assert found == plain_groups(plain_counts(rows, None))


def test_empty_table(spark):
    assert variants.spelling_variants(no_docs(spark)).count() == 0
