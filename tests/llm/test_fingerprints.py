import hashlib

import numpy as np
from helpers import ODD_ROWS, no_docs, odd_docs, shingles
from pyspark.sql import functions as F

from textquarry.llm import fingerprints, queries

FOLDER = "/root/testdata/sf0.01"
NAME = "op13_one_permutation_fingerprints"


def edited_rows(rows):
    """(id, text, edited, next text) from the rule alone; rows in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i, t, t[: len(t) - half] + following[:half], following))
    return out


def jaccard(a, b):
    a, b = shingles(a, 5), shingles(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark):
    """Texts exactly; likeness within the error of 256 bins of 4 bits."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES[NAME](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    errors = []
    for i, t, edited, following in edited_rows(docs):
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(shingles(t, 5)) >= 50:
            errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, following)]
    assert np.sqrt(np.mean(np.square(errors))) < 0.04
    assert abs(np.mean(errors)) < 0.01


def test_plan_has_no_python(spark, capsys):
    queries.QUERIES[NAME](spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equal_sets_have_equal_fingerprints(spark):
    rows = [(0, "a b c d e f"), (1, "A  b\nc d\te f"), (2, "a b c d e f a b c d e f a b c d e f"), (3, "one")]
    rows += [(4, "One"), (5, "two"), (6, ""), (7, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fingerprints.with_fingerprint(docs, "text", "p").collect()
    p = {r["doc_id"]: r["p"] for r in made}
    assert p[0] == p[1] and p[3] == p[4] != p[5] and p[6] == p[7] == ""
    assert len(p[0]) == len(p[3]) == fingerprints.BINS
    assert p[2] != p[0]


def test_likeness_takes_chance_agreements_off(spark):
    """Unrelated sets agree in one bin of sixteen, and have likeness near 0 all the same."""
    def words(seed):
        return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, 400))

    docs = spark.createDataFrame([(k, words(k)) for k in range(60)], "doc_id long, text string")
    pairs = fingerprints.with_fingerprint(docs, "text", "p").select("doc_id", "p")
    other = pairs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q"))
    found = pairs.join(other, "doc_id").select(fingerprints.likeness(F.col("p"), F.col("q")).alias("x"))
    values = [r["x"] for r in found.collect()]
    assert len(values) == 59 and np.mean(values) < 0.02 and min(values) >= 0


def test_odd_rows(spark):
    got = fingerprints.fingerprints(odd_docs(spark)).collect()
    want = edited_rows([(i, t) for i, t, _ in ODD_ROWS])
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((r["doc_id"], r["text"], r["edited"]) for r in got), key=key) == sorted(
        ((i, t, e) for i, t, e, _ in want), key=key
    )
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(7, "abcde")], "doc_id long, text string")
    (r,) = fingerprints.fingerprints(one).collect()
    assert r["edited"] == "abcab" and r["near_next"] == 1.0
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0


def test_both_ways_of_filling_agree(spark, monkeypatch):
    """Asking by turns and working out the first turn name the same bins."""
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (1, 5, 6, 9, 14, 19, 24, 40, 100, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    for few in (0, 16, fingerprints.BINS + 1):
        monkeypatch.setattr(fingerprints, "FEW", few)
        rows = fingerprints.with_fingerprint(docs, "text", "p").collect()
        made.append({r["doc_id"]: r["p"] for r in rows})
    assert made[0] == made[1] == made[2]
    assert all(len(p) == fingerprints.BINS for p in made[0].values())
