import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.operators import embedding, grep, index, symbols
from textquarry.plans import refresh
from textquarry.session import scratch_path
from textquarry.sources.files import file_rows, scan_paths, scan_project, scan_text_files
from textquarry.sources.store import CHUNK_SCHEMA, CommitConflict, IndexStore
from textquarry.sources.tree import list_tree
from textquarry.operators.filters import IndexRules

STATE = "path string, project_id string, file_hash string"


def _chunks(spark, rows):
    """rows: id, project, path, hash, content, vector."""
    full = [
        (i, p, path, h, "go", "S" + i, "sig", c, 1, 2, v) for i, p, path, h, c, v in rows
    ]
    return spark.createDataFrame(full, CHUNK_SCHEMA.removesuffix(", batch bigint"))


def _store(spark):
    return IndexStore(spark, scratch_path(spark, "test"))


def _ids(df, column="chunk_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_store_lifecycle(spark):
    store = _store(spark)
    assert store.file_state().count() == 0 and store.chunk_vectors().count() == 0
    rows = [
        ("c1", "alpha", "/tmp/a.go", "h1", "package a", [0.1, 0.2]),
        ("c2", "alpha", "/tmp/b.go", "h2", "package b", [0.3, 0.4]),
        ("c3", "beta", "/tmp/c.go", "h3", "package c", [0.5, 0.6]),
    ]
    chunks = _chunks(spark, rows)
    store.replace(chunks.select("path", "project_id", "file_hash"), chunks)
    projects = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "project_id string")
    counts = {r.project_id: r.chunks for r in index.count_by_project(store.chunk_vectors(), projects).collect()}
    assert counts == {"alpha": 2, "beta": 1, "gamma": 0}

    # replacing a path drops its old rows
    new = _chunks(spark, [("c9", "alpha", "/tmp/a.go", "h9", "package z", [0.9, 0.1])])
    store.replace(new.select("path", "project_id", "file_hash"), new)
    assert _ids(store.chunk_vectors()) == ["c2", "c3", "c9"]
    state = {r.path: r.file_hash for r in store.file_state().collect()}
    assert state == {"/tmp/a.go": "h9", "/tmp/b.go": "h2", "/tmp/c.go": "h3"}

    store.delete(spark.createDataFrame([("/tmp/b.go",)], "path string"))
    assert _ids(store.chunk_vectors()) == ["c3", "c9"]
    before = sorted(map(tuple, store.chunk_vectors().collect()))
    store.compact()
    assert sorted(map(tuple, store.chunk_vectors().collect())) == before
    assert _ids(store.file_state(), "path") == ["/tmp/a.go", "/tmp/c.go"]
    # a path can come back after compaction
    back = _chunks(spark, [("c2", "alpha", "/tmp/b.go", "h2", "package b", [0.3, 0.4])])
    store.replace(back.select("path", "project_id", "file_hash"), back)
    assert _ids(store.chunk_vectors()) == ["c2", "c3", "c9"]


def _one(spark, i, path, vector=(1.0, 0.0)):
    chunk = _chunks(spark, [(i, "a", path, "h" + i, "x", list(vector))])
    return chunk.select("path", "project_id", "file_hash"), chunk


def test_two_writers(spark):
    """Interleaved and concurrent writers each get a commit of their own."""
    store, other = _store(spark), None
    other = IndexStore(spark, store.folder)
    store.replace(*_one(spark, "c0", "/0.go"))
    stale = other._span()
    store.replace(*_one(spark, "c1", "/1.go"))
    calls = iter([stale])
    real = other._span
    other._span = lambda: next(calls, None) or real()  # sees the state before c1
    assert other.replace(*_one(spark, "c2", "/2.go")) == 3
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(IndexStore(spark, store.folder).replace, *_one(spark, f"t{k}", f"/t{k}.go")) for k in range(3)]
        assert sorted(j.result() for j in jobs) == [4, 5, 6]
    assert _ids(store.chunk_vectors()) == ["c0", "c1", "c2", "t0", "t1", "t2"]
    compacting, span = IndexStore(spark, store.folder), store._span()
    compacting._span = lambda: span
    store.replace(*_one(spark, "c9", "/9.go"))
    with pytest.raises(CommitConflict):
        compacting.compact()
    store.compact()
    assert store.vacuum() > 0
    assert _ids(store.chunk_vectors()) == ["c0", "c1", "c2", "c9", "t0", "t1", "t2"]


def test_search_over_changes_never_shuffles_chunks(spark):
    store = _store(spark)
    for k in range(3):
        store.replace(*_one(spark, f"c{k}", f"/{k % 2}.go"))
    vectors = store.chunk_vectors()
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("Initial Plan")[0].split("\n") if "Exchange" in line or "chunk_id" in line and "Scan" in line]
    assert _ids(vectors) == ["c1", "c2"]
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan
    assert not any("chunk_id" in line and "hashpartitioning" in line for line in above)


def test_comparison_is_narrow(spark):
    files = file_rows(spark.createDataFrame([("p", "/r/a.md", "text")], "project_id string, path string, content string"))
    state = spark.createDataFrame([], STATE)
    compared = index.compare_files(files, state)
    assert compared.columns == ["path", "project_id", "file_hash", "status"]
    changed = index.changed_files(files, state)
    assert [(r.path, r.status, r.content) for r in changed.collect()] == [("/r/a.md", "new", "text")]


def test_failed_batch_stays_invisible(spark):
    store = _store(spark)
    good = _chunks(spark, [("c1", "a", "/a.go", "h", "x", [1.0, 0.0, 0.0])])
    store.replace(good.select("path", "project_id", "file_hash"), good)
    bad = _chunks(spark, [("c2", "a", "/b.go", "h", "x", [1.0, 0.0])])
    with pytest.raises(Exception, match="dimension"):
        store.replace(bad.select("path", "project_id", "file_hash"), bad)
    assert _ids(store.chunk_vectors()) == ["c1"]
    mixed = _chunks(
        spark, [("c3", "a", "/c.go", "h", "x", [1.0, 0.0, 1.0]), ("c4", "a", "/d.go", "h", "x", [1.0])]
    )
    with pytest.raises(Exception, match="dimension"):
        store.replace(mixed.select("path", "project_id", "file_hash"), mixed)
    more = _chunks(spark, [("c5", "a", "/e.go", "h", "x", [0.0, 0.0, 1.0])])
    store.replace(more.select("path", "project_id", "file_hash"), more)
    assert _ids(store.chunk_vectors()) == ["c1", "c5"]


def test_upsert_keeps_last_place(spark):
    schema = "chunk_id string, path string, content string, start_line int, end_line int"
    old = spark.createDataFrame([("a", "/x", "old", 9, 9), ("b", "/x", "b", 1, 1)], schema)
    new = spark.createDataFrame([("a", "/x", "new", 1, 2), ("a", "/x", "new", 5, 6)], schema)
    got = sorted(map(tuple, index.upsert_chunks(old, new).collect()))
    assert got == [("a", "/x", "new", 5, 6), ("b", "/x", "b", 1, 1)]


SYMBOLS = "project_id string, path string, language string, symbol string, signature string, start_line int, end_line int"


def _symbols(spark, rows):
    return index.symbol_table(
        spark.createDataFrame([(p, path, lang, s, s, 1, 2) for p, path, lang, s in rows], SYMBOLS)
    )


def test_symbols(spark):
    table = _symbols(
        spark,
        [("p", "/foo.go", "go", "FooBar"), ("p", "/bar.go", "go", "BarBaz"), ("q", "/q.go", "go", "Qux"), ("p", "/foo.go", "go", "")],
    )
    assert table.count() == 3
    one = lambda n: spark.createDataFrame([(n,)], "name string")
    assert symbols.symbol_fuzzy(table, one("Bar")).count() == 2
    assert symbols.symbol_fuzzy(table, one("ar")).count() == 2
    assert symbols.symbol_fuzzy(table, one("X")).count() == 1
    assert symbols.symbol_fuzzy(table, one("nothing")).count() == 0
    assert symbols.symbol_exact(table, one("foobar")).count() == 1
    assert symbols.symbol_exact(table, one("bar")).count() == 0
    left = index.delete_paths(table, spark.createDataFrame([("/foo.go",)], "path string"))
    assert _ids(left, "symbol") == ["BarBaz", "Qux"]


def test_find_symbol_decides_before_filtering(spark):
    rows = [("p", "/a.go", "go", "Run"), ("q", "/b.go", "go", "RunAll"), ("q", "/c.py", "python", "rerun")]
    table = _symbols(spark, rows)
    vectors = spark.createDataFrame(
        [(str(i), p, path, lang, s, s, 1, 2, s, [1.0] * 64) for i, (p, path, lang, s) in enumerate(rows)],
        "chunk_id string, project_id string, path string, language string, symbol string, "
        "signature string, start_line int, end_line int, content string, embedding array<float>",
    )
    ask = spark.createDataFrame(
        [("run", "", ""), ("run", "q", ""), ("unA", "", ""), ("eru", "q", "Python"), ("zzz", "", "")],
        "name string, project_id string, language string",
    )
    got = sorted(
        (r["name"], r.want_project, r.symbol) for r in symbols.find_symbol(table, vectors, ask).collect()
    )
    # The exact hit in p keeps the fuzzy step off for "run"; in q the semantic fallback finds both.
    assert got == [
        ("eru", "q", "rerun"), ("run", "", "Run"), ("run", "q", "RunAll"), ("run", "q", "rerun"),
        ("unA", "", "RunAll"),
    ]


def test_grep_and_ranges(spark):
    files = spark.createDataFrame(
        [("/a.go", "func Foo() {}\nfunc Bar() {}\n"), ("/b.bin", "Foo\0"), ("/c/d.go", "x Foo\r\ny")],
        "path string, content string",
    ).withColumn("size", F.octet_length("content").cast("long"))
    assert [tuple(r) for r in grep.grep(files, "Foo", root="/a.go").collect()] == [("/a.go", 1, "func Foo() {}")]
    assert grep.grep(files, "func [A-Z][a-z]+", regex=True).count() == 2
    assert [r.content for r in grep.grep(files, "Foo").collect()] == ["func Foo() {}", "x Foo\r"]
    assert grep.grep(files, "Foo", k=1).count() == 1
    with pytest.raises(T.InvalidRegex):
        grep.grep(files, "(", regex=True)
    with pytest.raises(ValueError):
        grep.grep(files, "")
    text = spark.createDataFrame([("/s.go", "line1\nline2\nline3\nline4\nline5\n"), ("/t", "a\nb\nc\nd\n")], "path string, content string")
    asked = spark.createDataFrame(
        [("/s.go", 2, 4), ("/t", 2, 3), ("/t", 0, 0), ("/t", 9, 2), ("/none", 1, 1)],
        "path string, start_line int, end_line int",
    )
    got = {(r.path, r.start_line): (r.text, r.status) for r in grep.line_ranges(text, asked).collect()}
    assert got == {
        ("/s.go", 2): ("line2\nline3\nline4", "ok"), ("/t", 2): ("b\nc", "ok"),
        ("/t", 0): ("a\nb\nc\nd\n", "ok"), ("/t", 9): ("", "invalid_range"), ("/none", 1): ("", "not_found"),
    }


def _tree(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_scan_tree(spark, tmp_path):
    _tree(
        tmp_path,
        {
            "main.go": b"package a\nfunc A() {\n}\n", "README.MD": b"# T\nx\n", "bad.py": b"x = '\xff'\n",
            "node_modules/x.js": b"1", ".gitignore": b"gen/\n", "gen/g.go": b"package g", "pkg/__init__.py": b"", "a.bin": b"\0",
            "notes.txt": b"hello\n",
        },
    )
    root = str(tmp_path)
    assert list_tree(spark, root).count() == 9
    got = {r.rel_path: r for r in scan_project(spark, "p", root).collect()}
    assert set(got) == {"main.go", "README.MD", "bad.py", "pkg/__init__.py"}
    assert got["bad.py"].content == "x = '�'\n"
    assert {r.path.rsplit("/", 1)[-1] for r in scan_text_files(spark, root).collect()} == {
        "main.go", "README.MD", "bad.py", "x.js", ".gitignore", "g.go", "notes.txt", "__init__.py",
    }


def test_links_to_directories_are_not_entered(spark, tmp_path):
    _tree(tmp_path, {"a/x.go": b"package x", "b.go": b"package b"})
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    (tmp_path / "link.go").symlink_to(tmp_path / "b.go")
    names = sorted(r.path.removeprefix(f"{tmp_path}/") for r in list_tree(spark, str(tmp_path)).collect())
    assert names == ["a/x.go", "b.go", "link.go"]


def test_only_touched_paths_are_read(spark, tmp_path):
    _tree(tmp_path, {"a.md": b"# A\n", "gen/b.md": b"# B\n", ".gitignore": b"gen/\n", "c.md": b"# C\n", "x.bin": b"1"})
    root = str(tmp_path)
    names = ["a.md", "gen/b.md", "gone.md", "x.bin", "../outside.md"]
    asked = spark.createDataFrame([(f"{root}/{n}",) for n in names], "path string")
    assert [r.rel_path for r in scan_paths(spark, "p", root, asked).collect()] == ["a.md"]


def test_long_files_are_searched(spark, tmp_path):
    _tree(tmp_path, {"big.txt": b"needle\n" + b"x" * (2 << 20), "late.txt": b"needle" + b"y" * 4096 + b"\0"})
    found = grep.grep(scan_text_files(spark, str(tmp_path)), "needle")
    assert [(r.path.rsplit("/", 1)[-1], r.line) for r in found.collect()] == [("big.txt", 1)]


def test_refresh_only_touches_changes(spark, tmp_path):
    _tree(tmp_path, {"a.md": b"# One\nx\n# Two\n", "b.md": b"plain", "c.go": b"func C() {\n}\n"})
    root, store, rules = str(tmp_path), _store(spark), IndexRules()
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def embed(texts):
            calls.add(len(texts))
            return [[1.0, 0.0, 0.0, 0.0]] * len(texts)

        return embed

    refresh.refresh_project(store, scan_project(spark, "p", root, rules), "p", factory=factory)
    assert _ids(store.chunk_vectors(), "symbol") == ["# One", "# Two", "C", "b.md"]
    assert calls.value == 4
    _tree(tmp_path, {"a.md": b"# One\nx\n# Three\n", "d.go": b"func D() {\n}\n"})
    (tmp_path / "b.md").unlink()
    refresh.refresh_project(store, scan_project(spark, "p", root, rules), "p", factory=factory)
    assert _ids(store.chunk_vectors(), "symbol") == ["# One", "# Three", "C", "D"]
    assert _ids(store.symbols(), "symbol_lc") == ["# one", "# three", "c", "d"]
    assert calls.value == 6  # "# One" came from the cache, c.go was not looked at
    refresh.remove_project(store, root)
    assert store.chunk_vectors().count() == 0


def test_external_model_must_answer_every_text(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, content string").coalesce(1)
    ok = embedding.embed_with(chunks, lambda: lambda texts: [[float(len(texts))]] * len(texts), 1)
    assert [r.embedding for r in ok.collect()] == [[1.0], [1.0]]
    with pytest.raises(Exception, match="expected 2 embeddings, got 1"):
        embedding.embed_with(chunks, lambda: lambda texts: [[1.0]]).collect()


def test_cached_vectors_are_kept(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", "z")], "chunk_id string, content string")
    stored = spark.createDataFrame([("a", [7.0] * 64)], "chunk_id string, embedding array<float>")
    got = {r.chunk_id: r.embedding for r in embedding.embed_chunks(chunks, stored).collect()}
    assert got["a"] == [7.0] * 64 and sum(v * v for v in got["b"]) == 1.0


def test_changes_are_applied_once(spark):
    store = _store(spark)
    raw = spark.createDataFrame(
        [("p", "/r/a.md", "# A\n"), ("p", "/r/b.md", "# B\n")], "project_id string, path string, content string"
    )
    files = file_rows(raw, root="/r")
    refresh.rebuild_project(store, files, "/r")
    assert _ids(store.symbols(), "symbol") == ["# A", "# B"]
    changes = spark.createDataFrame(
        [("/r/a.md", "write", 1), ("/r/b.md", "remove", 2), ("/r/c.md", "create", 3), ("/r/d.txt", "create", 3), ("/r/a.md", "chmod", 9)],
        "path string, op string, ts long",
    ).withColumn("ts", F.timestamp_seconds("ts"))
    now = file_rows(
        spark.createDataFrame(
            [("p", "/r/a.md", "# A2\n"), ("p", "/r/c.md", "# C\n"), ("p", "/r/d.txt", "no")],
            "project_id string, path string, content string",
        ),
        root="/r",
    )
    first = refresh.apply_changes(store, changes, now, source="s", source_batch=4)
    again = refresh.apply_changes(store, changes, now, source="s", source_batch=4)
    assert first > 0 and again == -1
    assert _ids(store.symbols(), "symbol") == ["# A2", "# C"]
    assert _ids(store.file_state(), "path") == ["/r/a.md", "/r/c.md"]


def test_reindex_paths(spark):
    def tree(rows):
        raw = spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, content string")
        return file_rows(raw, root="/r")

    store = _store(spark)
    refresh.rebuild_project(
        store, tree([("/r/d/a.md", "# A\n"), ("/r/d/old.md", "# Old\n"), ("/r/d2/b.md", "# B\n"), ("/r/c.md", "# C\n")]), ""
    )
    now = tree([("/r/d/a.md", "# A2\n"), ("/r/d/n.md", "# N\n"), ("/r/d2/b.md", "# B2\n"), ("/r/c.md", "# C2\n"), ("/r/d/x.bin", "x")])
    asked = spark.createDataFrame([("/r/d",), ("/r/c.md",)], "path string")
    refresh.reindex_paths(store, now, asked)
    assert _ids(store.symbols(), "symbol") == ["# A2", "# B", "# C2", "# N"]
    assert _ids(store.file_state(), "path") == ["/r/c.md", "/r/d/a.md", "/r/d/n.md", "/r/d2/b.md"]


def test_a_dead_writer_blocks_nobody(spark):
    """An empty commit file is stepped over, by writes and by compaction."""
    store = _store(spark)
    store.replace(*_one(spark, "c0", "/0.go"))
    touch = lambda fs, p: fs.create(p, False).close()
    store._files(f"{store.folder}/commits/000000000002.json", touch)
    assert store.replace(*_one(spark, "c1", "/1.go")) == 3
    store._files(f"{store.folder}/commits/000000000004.json", touch)
    assert store.compact() == 5
    assert IndexStore(spark, store.folder).replace(*_one(spark, "c2", "/2.go")) == 6
    assert _ids(store.chunk_vectors()) == ["c0", "c1", "c2"]


def test_vacuum_leaves_what_is_needed(spark):
    """Old commits and unfinished writes go; what a stream has applied is still known."""
    store = _store(spark)
    for k in range(4):
        store.replace(*_one(spark, f"c{k}", f"/{k}.go"), source="feed", source_batch=10 + k)
    store._write("chunks", store.chunk_vectors(), "0" * 32)  # a write that never was committed
    base = store.compact()
    assert store.vacuum() == 4 + 4 + 1
    assert [n for n in store.names("commits") if n.endswith(".json")] == [f"{base:012d}.json"]
    assert store.applied("feed") == 13 and store.applied("other") == -1
    assert store.vacuum() == 0
    store.replace(*_one(spark, "c9", "/9.go"), source="feed", source_batch=14)
    assert store.applied("feed") == 14
    assert _ids(store.chunk_vectors()) == ["c0", "c1", "c2", "c3", "c9"]


def test_large_directory_is_listed_by_many_tasks(spark, tmp_path, capsys):
    """A flat folder in slices; conditions are pushed into the listing."""
    flat = tmp_path / "flat"
    (flat / "deep" / "er").mkdir(parents=True)
    for k in range(500):
        (flat / f"f{k:03}.{'md' if k % 2 else 'txt'}").write_text("x" * k)
    (flat / "deep" / "er" / ".hidden.md").write_text("")
    os.symlink(flat / "deep", flat / "link")
    os.symlink(flat / "nothing", flat / "broken.md")
    listed = list_tree(spark, str(tmp_path), slice_names=20)
    tasks = listed.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in tasks) == 501 and len(tasks) >= 20 and max(r.n for r in tasks) < 100
    some = listed.where("size >= 490 and path like '%.md' and mod_time > timestamp '2001-01-01'").select("path")
    assert sorted(r.path.rsplit("/", 1)[1] for r in some.collect()) == [f"f{k}.md" for k in range(491, 500, 2)]
    some.explain()
    assert "Filter (" not in capsys.readouterr().out.replace("\nFilter", "Filter (")
    assert list_tree(spark, str(tmp_path / "none")).count() == 0


def test_changed_paths_cannot_leave_the_project(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "a.md").write_text("in")
    (tmp_path / "secret.md").write_text("out")
    asked = spark.createDataFrame([(f"{tmp_path}/app/../secret.md",), (f"{tmp_path}/app/a.md",), (f"{tmp_path}/app/..",)], "path string")
    assert [r.rel_path for r in scan_paths(spark, "p", str(tmp_path / "app"), asked).collect()] == ["a.md"]


def test_small_changes_move_no_stored_rows(spark, capsys):
    """No exchange above the stored side of upsert, merge and cache lookup."""
    folder = scratch_path(spark, "stored")
    _chunks(spark, [(f"c{k}", "p", f"/{k}.go", "h", "text", [1.0, 2.0]) for k in range(50)]).write.parquet(folder)
    stored = spark.read.parquet(folder)
    few = _chunks(spark, [("c1", "p", "/1.go", "h2", "other", [1.0, 2.0]), ("x", "p", "/x.go", "h", "new", [1.0, 2.0])])
    cached = index.with_cached_vectors(few.drop("embedding"), stored)
    jobs = [index.upsert_chunks(stored, few), index.merge_index(stored, few, few), cached]
    assert _ids(jobs[0]) == _ids(jobs[1]) == sorted([f"c{k}" for k in range(50)] + ["x"])
    assert {r.chunk_id: r.embedding for r in cached.collect()} == {"c1": [1.0, 2.0], "x": None}
    for job in jobs:
        capsys.readouterr()
        job.explain()
        plan = capsys.readouterr().out.splitlines()
        scan = next(i for i, line in enumerate(plan) if "FileScan parquet" in line)
        depth = len(plan[scan]) - len(plan[scan].lstrip(" :+-"))
        above = []
        for line in reversed(plan[:scan]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                above.append(line)
                depth = at
        shuffles = [line for line in above if "Exchange hashpartitioning" in line]
        assert not shuffles, plan


def test_short_names_are_ranges_of_the_suffixes(spark, monkeypatch, capsys):
    """One- and two-letter names, a suffix most symbols share, letters beyond ASCII; ranges are pushed."""
    monkeypatch.setattr(symbols, "SUFFIXES_PER_FILE", 50)
    words = [f"{a}{k}Size" for k in range(60) for a in ("get", "Ünit", "x")] + ["E", "", "漢字Size"]
    table = _symbols(spark, [("p", "/a.go", "go", w) for w in words])
    asked = ["e", "ü", "ize", "7S", "SIZE", "zz", "", "漢", "t5"]
    names = spark.createDataFrame([(n,) for n in asked], "name string")
    want = sorted((n, w) for n in asked for w in words if n and n.lower() in w.lower())
    suffixes = symbols.write_suffixes(table, scratch_path(spark, "suffixes"))
    assert suffixes.rdd.getNumPartitions() > 1 and len(suffixes.inputFiles()) > 5
    for given in (None, suffixes):
        found = symbols.symbol_fuzzy(table, names, given)
        assert sorted((r["name"], r["symbol"]) for r in found.collect()) == want
    found.explain("formatted")
    assert "GreaterThanOrEqual(suffix" in capsys.readouterr().out
    assert symbols.symbol_fuzzy(table, names.limit(0)).count() == 0


def test_a_first_upsert_works_out_its_chunks_once(spark):
    """Where nothing is stored, incoming chunks are not computed a second time for their ids."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    shape = "chunk_id string, path string, start_line int, end_line int"
    rows = [("a", "/f", 1, 2), ("a", "/f", 5, 6), ("a", "/f", 3, 9), ("b", "/f", 1, 1), ("c", "/g", None, None)]
    incoming = spark.createDataFrame(rows, shape).mapInArrow(count, shape)
    got = index.upsert_chunks(incoming.limit(0), incoming).collect()
    assert sorted(tuple(r) for r in got) == [rows[1], rows[3], rows[4]]
    assert seen.value == len(rows)
