import hashlib
import re
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.embed import _embed_batch
from textquarry.operators import chunking


def _files(spark, rows):
    return spark.createDataFrame(rows, "project_id string, path string, content string").withColumn(
        "file_hash", T.content_hash(F.col("content"))
    )


def _pieces(df):
    rows = df.collect()
    return sorted((r.path, r.start_line, r.end_line, r.symbol, r.content) for r in rows)


def _sections(text):
    """Brute force: non-overlapping heading matches, text cut between them."""
    marks = list(re.finditer(r"(?m)^#{1,6}[ \t\n\f\r]+.+$", text))
    out = []
    for i, m in enumerate(marks):
        end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        out.append(
            (
                text[: m.start()].count("\n") + 1,
                text[:end].count("\n") + 1,
                m.group().strip(" \t\n\v\f\r"),
                text[m.start() : end],
            )
        )
    return out


def test_section_spans(spark):
    text = "intro\n# One\ntext\n## Two \nmore\n"
    got = _pieces(chunking.markdown_sections(_files(spark, [("p", "/a.md", text)])))
    assert got == [
        ("/a.md", 2, 4, "# One", "# One\ntext\n"),
        ("/a.md", 4, 6, "## Two", "## Two \nmore\n"),
    ]


def test_no_heading_is_one_chunk(spark):
    got = _pieces(chunking.chunk_files(_files(spark, [("p", "/d/a.MD", "#no\nx")])))
    assert got == [("/d/a.MD", 1, 2, "a.MD", "#no\nx")]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="# \nab\t\u0001E", max_size=40), min_size=1, max_size=30))
def test_sections_equal_brute_force(spark, texts):
    rows = [("p", f"/{i}.md", t) for i, t in enumerate(texts)]
    want = []
    for _, path, text in rows:
        found = _sections(text) or [(1, text.count("\n") + 1, path[1:], text)]
        want += [(path, *piece) for piece in found]
    assert _pieces(chunking.markdown_sections(_files(spark, rows))) == sorted(want)


def test_whole_file(spark):
    got = chunking.whole_file_chunks(_files(spark, [("p", "/d/x.txt", "a\nb\n")])).first()
    assert (got.symbol, got.signature, got.start_line, got.end_line) == ("x.txt", "x.txt", 1, 3)
    assert got.language == ""
    assert got.chunk_id == hashlib.sha256(b"/d/x.txt\na\nb\n").hexdigest()


GO = """package a

import (
\t"x"
)

// c
func (r *T) Foo(a int,
\tb int,
) {
\tx()
}

type X int
type Y struct {
\tfunc int
}
func open() {
func inner() {
}
func last() {
  y
"""


def test_brace_declarations(spark):
    got = _pieces(chunking.chunk_files(_files(spark, [("p", "/z.go", GO)])))
    assert [(s, e, n) for _, s, e, n, _ in got] == [
        (8, 12, "Foo"), (14, 14, "X"), (15, 17, "Y"), (18, 20, "open"), (21, 23, "last"),
    ]
    lines = GO.split("\n")
    assert all(content == "\n".join(lines[s - 1 : e]) for _, s, e, _, content in got)


def test_python_declarations(spark):
    text = "import x\n\n@dec\ndef foo(a,\n  b\n):\n  return 1\n\n\nclass Bar:\n  def m(self): pass\n\nx = 1\nasync def baz(): pass"
    got = _pieces(chunking.chunk_files(_files(spark, [("p", "/p.py", text)])))
    assert [(s, e, n) for _, s, e, n, _ in got] == [(4, 7, "foo"), (10, 11, "Bar"), (14, 14, "baz")]


NESTED = {
    "/n.py": (
        "if os.name:\n    def win(a):\n        if a:\n            def inner(): pass\n        return 1\n\n    # after\n"
        "    class K:\n        def m(self):\n            pass\nelse:\n    x = 1\n    async def late():\n\t\tpass\n"
        "try:\n  def one(\n    a\n  ): return a\nexcept E: pass\n",
        [(2, 7, "win"), (8, 10, "K"), (13, 14, "late"), (16, 18, "one")],
    ),
    "/n.js": (
        "const o = {\n  size: 1,\n  area(a, b) {\n    if (a) {\n      return b;\n    }\n  },\n  async *walk() {\n  },\n"
        "  get x() {\n    return 1\n  }\n};\nif (o) {\n  function f() {\n    function g() {\n    }\n  }\n}\n"
        "while (x) {\n  call(1);\n}\nmodule.exports = {\n  class: class {\n  }\n}\nclass A {\n  m() {\n  }\n}\n",
        [(3, 7, "area"), (8, 9, "walk"), (10, 12, "x"), (15, 18, "f"), (27, 30, "A")],
    ),
    "/n.rs": (
        "mod tests {\n    use super::*;\n    #[test]\n    fn check() {\n        let x = 1;\n    }\n    pub struct S;\n"
        "    impl S {\n        fn get(&self) -> u8 {\n            1\n        }\n    }\n}\nfn top() {\n}\n",
        [(4, 6, "check"), (7, 7, "S"), (8, 12, "S"), (14, 15, "top")],
    ),
    "/n.go": ("const x = `\n  func no() {\n  }\n`\nfunc yes() {\n\ttype t struct {\n\t}\n}\n", [(5, 8, "yes")]),
}


@pytest.mark.parametrize("path", NESTED)
def test_outermost_declarations_at_any_depth(spark, path):
    text, want = NESTED[path]
    got = _pieces(chunking.chunk_files(_files(spark, [("p", path, text)])))
    assert [(s, e, n) for _, s, e, n, _ in got] == want
    lines = text.split("\n")
    for _, s, e, _, content in got:
        assert content == "\n".join(lines[s - 1 : e]).strip(" \t")


@pytest.mark.parametrize(
    "path, line, name",
    [
        ("/a.js", "export default function go() {", "go"),
        ("/a.js", "async function* gen() {", "gen"),
        ("/a.ts", "export const LIMIT = 3;", "LIMIT"),
        ("/a.ts", "export function f() {", ""),
        ("/a.rs", "pub(crate) const fn area() {", "area"),
        ("/a.rs", "impl Shape for Square {", "Shape"),
        ("/a.go", "type (", ""),
    ],
)
def test_names(spark, path, line, name):
    got = chunking.chunk_files(_files(spark, [("p", path, line + "\n  x\n}")])).first()
    assert got.symbol == name and got.signature == line


def test_code_without_declarations_is_one_chunk(spark):
    got = chunking.chunk_files(_files(spark, [("p", "/a.rs", "use x;\n")])).collect()
    assert [(r.symbol, r.language, r.end_line) for r in got] == [("a.rs", "rust", 2)]


def test_many_declarations_stay_linear(spark):
    text = "".join(f"type T{i} int\n" for i in range(20000))
    assert chunking.chunk_files(_files(spark, [("p", "/a.go", text)])).count() == 20000


def test_scalar_texts(spark):
    row = spark.range(1).select(
        T.slugify(F.lit("  Hello, World_x/y  ")).alias("slug"),
        T.slugify(F.lit("***")).alias("empty"),
        F.length(T.slugify(F.lit("a" * 80))).alias("cut"),
        T.snippet(F.lit("é" * 801), 800).alias("snippet"),
        T.snippet(F.lit("x" * 800), 800).alias("short"),
        T.provider_of_note(F.lit("# Test\n\n- **Provider:** cursor \nx")).alias("named"),
        T.provider_of_note(F.lit("# Test\n")).alias("default"),
        T.printable_runs(F.lit(bytearray(b"abcd\0abcd\tjkl\0ab\xff"))).alias("runs"),
    ).first()
    assert row.slug == "hello--world-x-y" and row.empty == "note" and row.cut == 60
    assert row.snippet == "é" * 800 + "..." and row.short == "x" * 800
    assert (row.named, row.default) == ("cursor", "cascade")
    assert row.runs == ["abcd", "abcd\tjkl"]


@pytest.mark.parametrize("bad", ["(", "[a", r"(a)\1", "(?=x)", "(?<!x)", "*"])
def test_invalid_search_regex(bad):
    with pytest.raises(T.InvalidRegex):
        T.java_regex(bad)


def test_embedding_memory_is_bounded():
    """A batch of many texts is embedded a slice at a time, with the vectors each text has alone."""
    texts = pa.array([f"w{i} " * 1000 + "the end" for i in range(5000)] + ["", "a b" * 2_000_000])
    tracemalloc.start()
    whole = _embed_batch(texts, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 1, 2500, 4999, 5000, 5001):
        assert (whole[i] == _embed_batch(texts[i : i + 1], 64)[0]).all()
    assert whole.shape == (5002, 64) and peak < 100_000_000
    assert _embed_batch(texts[:0], 64).shape == (0, 64)


def test_words_of_odd_texts():
    """Words never run across texts, and bytes of other letters part them."""
    texts = ["", "ab", "cd e", "\u00e9a \u00e9", "a\u00e9", "b", "\u00df1 2", " x ", "\x00a\x00b", "", ""]
    got = _embed_batch(pa.array(["skipped", *texts])[1:], 64)
    for text, row in zip(texts, got):
        want = [0.0] * 64
        for word in re.findall("[a-z0-9]+", text):
            want[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        norm = sum(x * x for x in want) ** 0.5 or 1.0
        assert row.tolist() == pytest.approx([x / norm for x in want])
