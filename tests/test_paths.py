import re

import pytest
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.operators.filters import IndexRules, gitignore_filter, index_filter


def _accepted(spark, rules, rows):
    files = spark.createDataFrame(rows, "rel_path string, size long, want boolean")
    kept = {r.rel_path for r in index_filter(files, rules).collect()}
    return {r[0]: r[0] in kept for r in rows}, {r[0]: r[2] for r in rows}


def test_index_rules_table(spark):
    rules = IndexRules(
        extensions=(".go",), exclude=("vendor/**", "**/*_test.go", "data"), max_file_size_mb=1
    )
    got, want = _accepted(
        spark,
        rules,
        [
            ("main.go", 100, True),
            ("README.md", 100, False),
            ("main_test.go", 100, False),
            ("vendor/lib.go", 100, False),
            (".git/FETCH_HEAD", 100, False),
            ("big.go", 2 * 1024 * 1024, False),
            ("edge.go", 1024 * 1024, True),
            ("data/cc21aa19/2fb51258.gob", 100, False),
            ("data/x.go", 100, False),
            ("notdata/file.go", 100, True),
            ("noext", 100, False),
            ("sub/vendor/lib.go", 100, True),
        ],
    )
    assert got == want


def test_include_rule_and_capitals(spark):
    got, want = _accepted(
        spark,
        IndexRules(extensions=(".go",), include=("src/**", "Cap/**")),
        [("main.go", 1, False), ("src/app.go", 1, True), ("SRC/app.GO", 1, True), ("Cap/x.go", 1, False)],
    )
    assert got == want


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("*.go", "a.go", True),
        ("*.go", "d/a.go", False),
        ("**/*.go", "a.go", True),
        ("**/*.go", "d/e/a.go", True),
        ("a/**", "a", True),
        ("a/**", "a/b/c", True),
        ("a/**", "ab", False),
        ("a/**/z", "a/z", True),
        ("a/**/z", "a/b/c/z", True),
        ("a**z", "abcz", True),
        ("a**z", "a/z", False),
        ("?.go", "a.go", True),
        ("?.go", "/.go", False),
        ("[a-c]x", "bx", True),
        ("[!a-c]x", "bx", False),
        ("[^a-c]x", "dx", True),
        ("*.{ts,tsx}", "a.tsx", True),
        ("*.{ts,tsx}", "a.js", False),
        (r"\*", "*", True),
        (r"\*", "a", False),
        ("{**/en*,x}", "a/b/en1", True),
        ("a.b", "axb", False),
    ],
)
def test_glob(spark, pattern, path, want):
    row = spark.range(1).select(F.lit(path).rlike("(?s)" + P.glob_to_regex(pattern)).alias("m"))
    assert row.first().m is want


@pytest.mark.parametrize("pattern", ["[", "a[b", "{a", "a\\"])
def test_invalid_glob(pattern):
    with pytest.raises(P.InvalidPattern):
        P.glob_to_regex(pattern)


def test_invalid_index_pattern_matches_nothing(spark):
    assert spark.range(1).select(P.matches_any(F.lit("["), ["["])).first()[0] is False


def test_under_path(spark):
    paths = spark.createDataFrame(
        [("/tmp", True), ("/tmp/inside", True), ("/tmp2", False), ("/tmp2/inside", False)],
        "path string, want boolean",
    )
    rows = paths.select(
        "want",
        P.under_path(F.col("path"), "/tmp").alias("a"),
        P.under_path_column(F.col("path"), F.lit("/tmp")).alias("b"),
        P.under_path(F.col("path"), "").alias("all"),
    ).collect()
    assert all(r.a == r.want and r.b == r.want and r["all"] for r in rows)


def test_ancestors_and_names(spark):
    row = spark.range(1).select(
        P.ancestors(F.lit("/a/b/c.tar.GZ")).alias("up"),
        P.extension(F.lit("/a.b/c")).alias("none"),
        P.extension(F.lit("/a/c.tar.GZ")).alias("ext"),
        P.dir_name(F.lit("/x")).alias("top"),
        P.relative_to(F.lit("/a/b"), F.lit("/")).alias("rel"),
    ).first()
    assert row.up == ["/", "/a", "/a/b"]
    assert (row.none, row.ext, row.top, row.rel) == ("", ".gz", "/", "a/b")


def test_walk_order(spark):
    paths = ["/a/b/x", "/a/b-c", "/a/b.go", "/a/a"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in df.orderBy(P.walk_key(F.col("path"))).collect()]
    assert got == ["/a/a", "/a/b/x", "/a/b-c", "/a/b.go"]


def test_gitignore_levels(spark):
    rows = [
        ("/r/.gitignore", "# c\n*.log\n!keep.log\n/top\nsub/\n\\#odd\n"),
        ("/r/deep/.gitignore", "!x.log\n*.tmp\n!good.tmp\nq?.txt\n"),
        ("/r/a.log", ""),
        ("/r/keep.log", ""),
        ("/r/top/f.go", ""),
        ("/r/deep/top/f.go", ""),
        ("/r/sub/f.go", ""),
        ("/r/deep/sub/f.go", ""),
        ("/r/subx/f.go", ""),
        ("/r/deep/x.log", ""),
        ("/r/deep/a.tmp", ""),
        ("/r/deep/good.tmp", ""),
        ("/r/other.tmp", ""),
        ("/r/#odd", ""),
        ("/r/deep/qa.txt", ""),
        ("/r/deep/q?.txt", ""),
        ("/elsewhere/a.log", ""),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    kept = {r.path for r in gitignore_filter(files, "/r").collect()}
    assert {p for p, _ in rows} - kept == {
        "/r/a.log", "/r/top/f.go", "/r/sub/f.go", "/r/deep/sub/f.go", "/r/deep/x.log",
        "/r/deep/a.tmp", "/r/#odd", "/r/deep/q?.txt", "/r/deep/qa.txt",
    }


@pytest.mark.parametrize(
    "line,hit,miss",
    [
        ("doc_?.md", ["doc_1.md", "a/b/doc_x.md", "doc_1.md/x"], ["doc_12.md", "doc_/.md"]),
        ("a/b", ["a/b", "a/b/c"], ["x/a/b", "a/bc"]),
        ("/top", ["top", "top/x"], ["a/top"]),
        ("dir/", ["dir/x", "a/dir/x/y"], ["dir", "a/dir"]),
        ("a/**", ["a/x", "a/x/y"], ["a", "b/a/x"]),
        ("**/b", ["b", "x/b", "x/y/b/z"], ["ab"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb", "ab"]),
        ("[a-c]?[!0-9].t", ["axy.t", "d/bxz.t"], ["ax1.t", "dxy.t", "a/y.t"]),
        ("x\\ ", ["x "], ["x"]),
        ("x  ", ["x"], ["x "]),
        ("\\#n", ["#n"], ["n"]),
        ("\\!n", ["!n"], ["n"]),
        ("f*.c", ["f.c", "fx/y.c/f1.c"], ["fx/y.c"]),
        ("a**b", ["ab", "axb"], ["a/b"]),
        ("\\*", ["*"], ["x"]),
    ],
)
def test_ignore_rule(line, hit, miss):
    negated, regex = P.ignore_rule(line)
    assert not negated
    assert [p for p in [*hit, *miss] if re.fullmatch(regex, p)] == hit


def test_ignore_lines_that_say_nothing():
    assert [P.ignore_rule(x) for x in ("", "   ", "# c", "/", "[a", "x\\")] == [None] * 6
    assert P.ignore_rule("!a\r") == (True, "(?:.*/)?a(?:/.*)?")
