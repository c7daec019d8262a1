import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators.listing import directory_tree, list_files
from textquarry.operators.projects import (
    Discovery,
    add_project,
    assign_project,
    discover_projects,
    unique_names,
)
from textquarry.operators.filters import in_project


def _names(spark, names, existing):
    projects = spark.createDataFrame(
        [(i, f"/{i}", n) for i, n in enumerate(names)], "ord bigint, path string, name string"
    )
    taken = spark.createDataFrame([(n,) for n in existing], "name string")
    return [r["name"] for r in unique_names(projects, taken).orderBy("ord").collect()]


def _one_by_one(names, existing):
    used, out = set(existing), []
    for name in names:
        pick, n = name, 0
        while pick in used:
            n += 1
            pick = f"{name}-{n}"
        used.add(pick)
        out.append(pick)
    return out


def test_unique_names_pinned(spark):
    assert _names(spark, ["foo", "foo", "bar"], ["bar"]) == ["foo", "foo-1", "bar-1"]


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a-1", "a-1-1", "a-2", "b", "a-3", "b-01", "b-1"]
    names = [rng.choice(pool) for _ in range(40)]
    existing = rng.sample(pool + ["a-4", "b-2", "a-1-2"], 4)
    assert _names(spark, names, existing) == _one_by_one(names, existing)


def test_made_up_name_beats_a_later_own_name(spark):
    names = ["foo", "foo", "foo-1", "foo-1", "foo"]
    assert _names(spark, names, []) == _one_by_one(names, [])


def _files(spark, rows):
    return spark.createDataFrame(
        [(r, "") if isinstance(r, str) else r for r in rows], "path string, content string"
    )


def _found(df):
    return sorted((r["path"], r["name"], r.already_added) for r in df.collect())


def test_no_flag_takes_top_directories(spark):
    files = _files(spark, ["/r/alpha/x/f", "/r/beta/f", "/r/vendor/deep/f", "/r/f", "/other/g/f"])
    assert _found(discover_projects(files, "/r")) == [("/r/alpha", "alpha", False), ("/r/beta", "beta", False)]
    # skipped directories are still walked
    deeper = discover_projects(files, "/r", Discovery(depth=2))
    assert ("/r/vendor/deep", "vendor-deep", False) in _found(deeper)


def test_markers_and_hiding(spark):
    files = _files(
        spark,
        ["/r/with-git/.git/HEAD", "/r/with-git/sub/go.mod", "/r/plain/f", "/r/a/b/go.mod", "/r/a/b/c/d/go.mod", "/r/x/y/z/w/go.mod"],
    )
    assert _found(discover_projects(files, "/r", Discovery(git=True))) == [("/r/with-git", "with-git", False)]
    got = discover_projects(files, "/r", Discovery(git=True, go=True, depth=3))
    assert _found(got) == [("/r/a/b", "a-b", False), ("/r/with-git", "with-git", False)]
    at_root = _files(spark, ["/r/.git/HEAD", "/r/a/.git/HEAD"])
    assert _found(discover_projects(at_root, "/r", Discovery(git=True, depth=3))) == []


def test_existing_are_flagged(spark):
    known = spark.createDataFrame([("/r/existing",)], "root string")
    got = discover_projects(_files(spark, ["/r/existing/f"]), "/r", existing=known)
    assert _found(got) == [("/r/existing", "existing", True)]


def test_workspaces(spark):
    ws = '{"folders":[{"path":"a"},{"name":"n","path":"./b/../c"},{"path":"/out/lib"},{"path":"gone"},{"path":""}]}'
    files = _files(
        spark,
        [
            ("/r/w/x.code-workspace", ws), ("/r/w/y.code-workspace", "{}"), "/r/w/a/deep/.git/HEAD", "/r/w/c/f",
            "/r/w/d/.git/HEAD", "/out/lib/f", ("/r/bad/z.code-workspace", "not json"), "/r/bad/e/.git/HEAD",
        ],
    )
    got = discover_projects(files, "/r", Discovery(git=True, workspace=True, depth=3))
    assert _found(got) == [
        ("/out/lib", "..-out-lib", False), ("/r/bad/e", "bad-e", False), ("/r/w/a", "w-a", False),
        ("/r/w/c", "w-c", False), ("/r/w/d", "w-d", False),
    ]


def test_workspace_named_later_does_not_hide(spark):
    files = _files(
        spark, ["/r/a/s/.git/HEAD", ("/r/b/x.code-workspace", '{"folders":[{"path":"../a"},{"path":"../c"}]}'), "/r/c/s/.git/HEAD"]
    )
    got = discover_projects(files, "/r", Discovery(git=True, workspace=True, depth=3))
    assert [p for p, _, _ in _found(got)] == ["/r/a", "/r/a/s", "/r/c"]


def test_workspace_below_a_hidden_folder_is_not_read(spark):
    files = _files(
        spark,
        [
            ("/r/a/x.code-workspace", '{"folders":[{"path":"../b"}]}'),
            ("/r/b/y.code-workspace", '{"folders":[{"path":"../c"}]}'),
            "/r/c/s/.git/HEAD",
        ],
    )
    got = discover_projects(files, "/r", Discovery(git=True, workspace=True, depth=3))
    assert [p for p, _, _ in _found(got)] == ["/r/b", "/r/c/s"]


def test_assign_and_membership(spark):
    files = _files(spark, ["/a/x/f", "/a/b/f", "/ab/f", "/f", "/a/f"])
    roots = spark.createDataFrame(
        [("inner", "/a/b", 2), ("outer", "/a", 1), ("late", "/a/x", 0)], "project_id string, root string, ord bigint"
    )
    got = {r.path: r.project_id for r in assign_project(files, roots).collect()}
    assert got == {"/a/x/f": "late", "/a/b/f": "outer", "/ab/f": "ab", "/f": "/", "/a/f": "outer"}
    inside = {r.path for r in in_project(files, roots).collect()}
    assert inside == {"/a/x/f", "/a/b/f", "/a/f"}


def test_listing_and_tree(spark):
    files = _files(spark, ["/r/a.go", "/r/b.md", "/r/sub/file.go", "/r/sub/deep/er/x.go", "/r2/z.go"])
    listed = lambda *a, **k: sorted(r.path for r in list_files(files, "/r", *a, **k).collect())
    assert listed("*.go") == ["/r/a.go"]
    assert listed() == ["/r/a.go", "/r/b.md"]
    assert listed(include_dirs=True) == ["/r/a.go", "/r/b.md", "/r/sub"]
    assert listed("**/*.go") == ["/r/a.go", "/r/sub/deep/er/x.go", "/r/sub/file.go"]
    assert listed("*.GO") == []
    tree = {(r.path, r.type, r.depth) for r in directory_tree(files, "/r", 2).collect()}
    assert tree == {
        ("/r/a.go", "file", 1), ("/r/b.md", "file", 1), ("/r/sub", "dir", 1), ("/r/sub/file.go", "file", 2), ("/r/sub/deep", "dir", 2),
    }


def test_add_project(spark):
    known = spark.createDataFrame([("app", "/a/app", 0), ("app-1", "/b/app", 1)], "project_id string, root string, ord bigint")
    got = add_project(known, "/c/app/")
    assert [tuple(r) for r in got.orderBy("ord").collect()][-1] == ("app-2", "/c/app", 2)
    with pytest.raises(ValueError, match="already exists"):
        add_project(known, "/a/app")
