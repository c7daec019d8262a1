import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.operators import knn, search
from textquarry.plans.grid import grid_map
from textquarry.plans.joins import cut_lineage

SCHEMA = (
    "chunk_id string, project_id string, path string, language string, symbol string, "
    "signature string, start_line int, end_line int, content string, embedding array<float>"
)


def _row(i, path="/d/f.go", symbol="", language="go", project="p", vector=(1.0, 0.0), content="c", lines=(1, 2)):
    return (i, project, path, language, symbol, symbol, *lines, content, list(vector))


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id string, text string, embedding array<double>, path_prefix string")


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 5)).round(1)
    vectors[100:200] = vectors[0]  # a third of the rows are copies: ties
    chunks = spark.createDataFrame(
        [_row(f"c{i:03}", project=f"p{i % 3}", vector=[float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA
    ).repartition(7)
    asked = rng.normal(size=(40, 5))
    asked[0] = vectors[0]
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in v], "p1" if i % 4 == 0 else "") for i, v in enumerate(asked)],
        "query_id string, embedding array<double>, project_id string",
    )
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    stored = vectors.astype(np.float32).astype(np.float64)
    scores = np.round(unit(asked) @ unit(stored).T, 6)
    want = set()
    for i in range(40):
        ranked = sorted(
            (-scores[i, j], f"c{j:03}") for j in range(300) if i % 4 or j % 3 == 1
        )[:7]
        want |= {(f"q{i}", c, -s, n + 1) for n, (s, c) in enumerate(ranked)}

    def got():
        top, bound = knn.vector_topk(chunks, queries, 7)
        assert bound == 280
        return {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in top.collect()}

    assert got() == want
    monkeypatch.setattr(knn, "MAX_QUERIES", 6)  # now in several batches
    assert got() == want


def test_dimension_mismatch(spark):
    chunks = spark.createDataFrame([_row("a", vector=(1.0, 0.0, 0.0))], SCHEMA)
    with pytest.raises(Exception, match="dimension"):
        knn.vector_topk(chunks, _queries(spark, [("q", "", [1.0, 0.0], "")]), 3)[0].collect()
    with pytest.raises(knn.DimensionMismatch):
        knn.vector_topk(chunks, _queries(spark, [("q", "", [1.0], ""), ("r", "", [1.0, 2.0], "")]), 3)


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = _queries(spark, [("q", "x", [1.0, 0.0], "")])
    assert search.search_codebase(none, q).count() == 0
    chunks = spark.createDataFrame([_row("a")], SCHEMA)
    assert search.search_codebase(chunks, q.limit(0)).count() == 0
    zero = spark.createDataFrame([_row("z", vector=(0.0, 0.0))], SCHEMA)
    assert [r.score for r in search.search_codebase(zero, q).collect()] == [0.0]


def test_boost_is_exclusive(spark):
    rows = [_row("both", path="/alpha/x", symbol="Alpha"), _row("path", path="/ALPHA/x", symbol="b"), _row("none", symbol="b")]
    got = search.search_codebase(
        spark.createDataFrame(rows, SCHEMA), _queries(spark, [("q", "aLpHa", [1.0, 0.0], "")])
    )
    assert {r.chunk_id: r.score for r in got.collect()} == {"both": 1.1, "path": 1.05, "none": 1.0}


def test_narrow_path_still_gives_k(spark):
    # Many better hits lie outside the prefix; a pool of candidates held none inside.
    rows = [_row(f"o{i}", path="/out/f", vector=(1.0, 0.01 * i)) for i in range(40)]
    rows += [_row(f"i{i}", path="/in/f", vector=(0.5, 1.0 + i)) for i in range(3)]
    rows += [_row("x", path="/inside/f", vector=(0.5, 1.0))]
    chunks = spark.createDataFrame(rows, SCHEMA)
    q = _queries(spark, [("q", "zz", [1.0, 0.0], "/in")])
    found = search.search_codebase(chunks, q, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["i0", "i1"]


def test_bonus_counts_for_every_chunk(spark):
    """Against brute force, with more chunks than any pool and ties in both parts of the score."""
    rng = np.random.default_rng(7)
    rows = [
        _row(f"c{i:03}", path=f"/d/{'key' if i % 3 else 'x'}{i}", symbol="Key" if i % 7 == 0 else "other",
             vector=[float(v) for v in rng.normal(size=2).round(1)])
        for i in range(200)
    ]
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(5)
    q = _queries(spark, [("q", "kEY", [1.0, 0.2], "")])
    a = np.array([1.0, 0.2])
    def score(r):
        v = np.array(r[-1], dtype=np.float32).astype(float)
        n = np.linalg.norm(v)
        base = round(float(v @ a / n / np.linalg.norm(a)), 6) if n else 0.0
        return round(base + (0.1 if "key" in r[4].lower() else 0.05 if "key" in r[2] else 0.0), 6)
    want = sorted((-score(r), r[0]) for r in rows)[:20]
    got = search.search_codebase(chunks, q, 20).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(c, -s) for s, c in want]


def test_bonus_brings_up_a_distant_chunk(spark):
    rows = [_row(f"c{i:02}", vector=(1.0, 0.5 + 0.001 * i)) for i in range(60)]
    rows += [_row("symbol", symbol="needle", vector=(1.0, 0.65))]
    got = search.search_codebase(
        spark.createDataFrame(rows, SCHEMA), _queries(spark, [("q", "needle", [1.0, 0.0], "")]), 1
    )
    assert [r.chunk_id for r in got.collect()] == ["symbol"]


def test_memory_search_fills_k_files(spark):
    rows = [_row(f"a{i}", path="/m/long.md", project="memory-cascade", vector=(1.0, 0.001 * i)) for i in range(50)]
    rows += [_row(f"b{i}", path=f"/m/{i}.md", project="memory-cascade", vector=(0.2, 1.0 + i)) for i in range(5)]
    memory = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = search.memory_search(memory, _queries(spark, [("q", "z", [1.0, 0.0], "")]), 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a0", "b0", "b1", "b2"]


def test_memory_search_one_chunk_per_file(spark):
    rows = [
        _row("a1", path="/m/a.md", project="memory-cascade", content="é" * 900),
        _row("a2", path="/m/a.md", project="memory-cascade", vector=(1.0, 0.1)),
        _row("b1", path="/m/b.md", project="memory-cascade", symbol="needle", vector=(1.0, 0.5)),
        _row("c1", path="/m/c.md", project="memory-cursor"),
    ]
    memory = spark.createDataFrame(rows, SCHEMA)
    q = _queries(spark, [("q", "needle", [1.0, 0.0], "")])
    got = search.memory_search(memory, q).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a1", "b1"] and got[0].content == "é" * 900
    cut = search.memory_search(memory, q, snippet_chars=800).orderBy("rank").first()
    assert cut.content == "é" * 800 + "..."
    assert got[1].score < 1.0  # no keyword bonus here
    assert [r.chunk_id for r in search.memory_search(memory, q, provider="cursor").collect()] == ["c1"]


def test_unified_prefers_code_over_docs(spark):
    chunks = spark.createDataFrame(
        [_row("s", path="/foo/shared.md", language="markdown", lines=(1, 5)), _row("g", path="/foo/g.go", vector=(1.0, 1.0))], SCHEMA
    )
    memory = spark.createDataFrame([_row("m", path="/m/a.md", project="memory-cascade", vector=(1.0, 0.2))], SCHEMA)
    q = _queries(spark, [("q", "zz", [1.0, 0.0], "")])
    got = search.unified_search(chunks, memory, q).orderBy("rank").collect()
    assert [(r.chunk_id, r.source) for r in got] == [("s", "code"), ("m", "memory"), ("g", "code")]
    docs = search.unified_search(chunks, memory, q, source=" Docs ").collect()
    assert [(r.chunk_id, r.source) for r in docs] == [("s", "docs")]
    assert search.unified_search(chunks, None, q).count() == 2
    with pytest.raises(ValueError, match="invalid source"):
        search.unified_search(chunks, memory, q, source="web")


def test_content_is_read_only_when_asked(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([_row("a")], SCHEMA).write.parquet(path)
    chunks = spark.read.parquet(path)
    q = _queries(spark, [("q", "zz", [1.0, 0.0], "")])
    plan = search.search_codebase(chunks, q)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line and "/v]" in line]
    assert len(scans) == 2 and not any("content:string" in s for s in scans)
    assert sum("embedding:array" in s for s in scans) == 1
    filtered = search.search_codebase(chunks, q.withColumn("project_id", F.lit("p")))
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "project_id" in plan.split("PushedFilters", 1)[1]


def test_task_functions_travel_with_their_code():
    import subprocess
    import sys

    from pyspark import cloudpickle

    query = {"query_id": "q", "text": None, "embedding": [1.0], "project_id": "", "language": "", "path_prefix": ""}
    data = cloudpickle.dumps(knn._partial_topk([query], 1))
    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    subprocess.run([sys.executable, "-I", "-c", code], input=data, cwd="/", check=True)


def test_grid_is_one_job_of_cells(spark, monkeypatch, tmp_path):
    """Many queries, several files: every query meets every chunk, with filters, bonus and paths."""
    rng = np.random.default_rng(3)
    rows = [
        _row(f"c{i:03}", project=f"p{i % 3}", path=f"/p/f{i % 40}.md", vector=[float(x) for x in rng.normal(size=4).round(1)])
        for i in range(400)
    ]
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(9)
    queries = spark.createDataFrame(
        [(f"q{i:02}", "f1" if i % 2 else None, [float(x) for x in rng.normal(size=4)], f"p{i % 3}" if i % 5 == 0 else "") for i in range(60)],
        "query_id string, text string, embedding array<double>, project_id string",
    )
    for how in ({"boost": True}, {"per_path": True}, {}):
        few, bound = knn.vector_topk(chunks, queries, 5, **how)
        want = sorted(tuple(r) for r in few.select("query_id", "chunk_id", "score", "rank").collect())
        with monkeypatch.context() as patch:
            patch.setattr(knn, "MAX_QUERIES", 7)
            many, grid_bound = knn.vector_topk(chunks, queries, 5, **how)
        assert sorted(tuple(r) for r in many.select("query_id", "chunk_id", "score", "rank").collect()) == want
        assert bound == grid_bound == 300


def test_grid_sides_can_be_empty(spark):
    def kernel(block, batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"pairs": pa.array([block.num_rows * n], pa.int64())})

    def pairs(left, right, **sizes):
        stored = cut_lineage(spark.range(right).repartition(3), "stored")
        return sum(r.pairs for r in grid_map(spark.range(left), stored, kernel, "pairs long", **sizes).collect())

    assert pairs(50, 200) == 10_000 and pairs(50, 200, block_rows=7, batch_rows=11) == 10_000
    assert pairs(0, 200) == 0 and pairs(50, 0) == 0


def test_few_rows_are_scored_exactly(monkeypatch):
    """Rough products keep most rows out, and leave the results those of all rows."""
    rng = np.random.default_rng(1)
    n, dim, keep = 6000, 16, 5
    vectors = rng.normal(size=(n, dim))
    vectors[100:140] = vectors[7]  # ties go by id
    ids = np.array([f"c{i:05d}" for i in range(n)], dtype=object)
    projects = np.array([f"p{i % 3}" for i in range(n)], dtype=object)
    queries = [
        {"query_id": f"q{i}{p}", "text": None, "embedding": vectors[i].tolist(), "project_id": p, "language": "", "path_prefix": ""}
        for i in range(0, 60, 7) for p in ("", "p1")
    ]
    rounded, plain = [], np.round
    monkeypatch.setattr(np, "round", lambda x, *how: (rounded.append(np.size(x)), plain(x, *how))[1])
    table = pa.table({
        "chunk_id": pa.array(ids, pa.string()), "project_id": pa.array(projects, pa.string()),
        "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64())),
    })
    got = [r for b in knn._partial_topk(queries, keep)(table.to_batches(max_chunksize=3000)) for r in b.to_pylist()]
    assert sum(rounded) < len(queries) * n / 5
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in queries:
        vector = np.array(q["embedding"])
        scores = plain(unit @ (vector / np.linalg.norm(vector)), 6)
        rows = [i for i in range(n) if q["project_id"] in ("", projects[i])]
        want = sorted((-scores[i], ids[i]) for i in rows)[:keep]
        mine = sorted((-r["score"], r["chunk_id"]) for r in got if r["query_id"] == q["query_id"])
        assert [i for _, i in mine] == [i for _, i in want]
        assert np.allclose([x for x, _ in mine], [x for x, _ in want], atol=1e-6)
