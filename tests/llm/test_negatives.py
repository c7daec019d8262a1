import numpy as np
import oracle
import pytest

from textquarry.llm import negatives, queries

FOLDER = "/root/testdata/sf0.001"
NAME = "op12_packed_hard_negatives"


def plain(rows, anchors, positives=5, count=10):
    """All rules from the statement, with Python's integers."""
    out = []
    for a, label, v in anchors:
        scored = [
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, k)
            for i, k, w in rows if i != a and len(w) == len(v)
        ]
        near = sorted(s for s in scored if s[2] == label)[:positives]
        for p, i, _ in near:
            far = sorted((s, j) for s, j, k in scored if k != label and -30 * p <= -100 * s <= -90 * p)
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(far[:count])]
    return sorted(out)


def mined(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_query_equals_sql(spark):
    con = oracle.connect(FOLDER)
    assert oracle.compare(queries.QUERIES[NAME](spark, FOLDER), con, queries.ORACLES[NAME]) is None


@pytest.mark.parametrize("most", [0, 1, 300, 1 << 20, 1 << 27])
def test_packed_scores_are_exact(most):
    """From fields of a bit to products wider than a double carries."""
    for seed in range(20):
        r = np.random.default_rng(seed)
        dim = int(r.integers(0, 70))
        a = r.integers(-most, most + 1, (r.integers(1, 6), dim))
        c = r.integers(-most // 2, most + 1, (r.integers(0, 40), dim))
        want = c.astype(object) @ a.astype(object).T if dim else np.zeros((len(c), len(a)))
        assert (negatives.Packed(a).scores(c) == want).all()


def test_scores_stop_at_64_bits():
    big = np.array([[1 << 40, 1 << 40]])
    assert negatives.Packed(big).scores(np.array([[1 << 40, 5], [-(1 << 41), 0]])).tolist() == [
        [negatives.MOST], [negatives.LEAST]
    ]


@pytest.mark.parametrize("seed", range(3))
def test_ties_repeated_rows_and_lengths(spark, seed, monkeypatch):
    """Small values tie often; some vectors are shorter; blocks and batches of few rows."""
    monkeypatch.setattr(negatives, "REQUESTS", 7)
    r = np.random.default_rng(seed)
    rows = [
        (int(i), int(r.integers(0, 3)), [int(x) for x in r.integers(-2, 4, 3 if i % 9 else 2)]) for i in range(120)
    ]
    rows += rows[5:15]
    anchors = [x for x in rows[:115] if x[0] % 10 == 0]
    shape = "vec_id long, label long, v array<long>"
    stored = spark.createDataFrame(rows, shape).repartition(5)
    asked = spark.createDataFrame(anchors + anchors[:3], shape)
    assert mined(negatives.hard_negatives(stored, asked)) == plain(rows, anchors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.5], "x"), (2, 0, [1.0, 0.25], None), (3, 1, [0.5, 0.1], None), (4, None, [1.0, 1.0], None),
        (5, 1, None, None), (6, 1, [nan, 1.0], None), (7, 1, [inf, 1.0], None), (8, 1, [None, 1.0], None),
        (None, 1, [0.5, 0.1], None), (9, 1, [], None), (3, 1, [0.5, 0.1], None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, v string")
    vectors = negatives.integer_vectors(table)
    assert sorted((r["vec_id"], r["v"]) for r in vectors.collect()) == [
        (1, [256, 128]), (2, [256, 64]), (3, [128, 25]), (3, [128, 25]), (9, []),
    ]
    kept = [(r["vec_id"], r["label"], r["v"]) for r in vectors.collect()]
    once = [(1, 0, [256, 128]), (9, 1, [])]
    assert mined(negatives.hard_negatives(vectors, vectors.where("vec_id in (1, 9)"))) == plain(kept, once)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label long, v array<long>")
    some = spark.createDataFrame([(1, 1, [1])], "vec_id long, label long, v array<long>")
    assert negatives.hard_negatives(none, none).count() == 0
    assert negatives.hard_negatives(some, none).count() == 0
    assert negatives.hard_negatives(some, some).count() == 0
