"""Text and vector expressions against plain Python."""

import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.functions import config
from lodestone.functions import text as X
from lodestone.functions import vectors as V

TEXTS = ["", " ", "a", "a\n", "a\r\nb\rc\n\nd", "x\x0by\x0cz\x1c1\x1d2\x1e3\x85q\u2028r\u2029", "\n", "é É ß\u00a0t", "no end\nlast\n\n"]


def one(spark, expr, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<double>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize("text", TEXTS)
def test_lines_and_counts(spark, text):
    assert one(spark, X.lines("t"), t=text) == text.splitlines()
    assert one(spark, X.non_blank_length("t"), t=text) == sum(not c.isspace() for c in text)
    assert one(spark, X.token_count("t"), t=text) == len(text) // 4
    assert one(spark, X.content_hash("t"), t=text) == hashlib.sha256(text.encode()).hexdigest()
    assert one(spark, X.line_slice("t", 1, 3), t=text) == "\n".join(text.splitlines()[1:3])


@pytest.mark.parametrize("text,query,hit", [("ABC", "b", True), ("É", "é", False), ("axb", "a_b", True), ("a_b", "a\\_b", False), ("a\\xb", "a\\_b", True), ("50% off", "0%o", True), ("abc", "", True)])
def test_like(spark, text, query, hit):
    assert one(spark, X.like("t", query), t=text) is hit


def test_truncation_names_and_durations(spark):
    assert one(spark, X.truncate("t", 80), t="x" * 81) == "x" * 77 + "..."
    assert one(spark, X.truncate("t", 80), t="x" * 80) == "x" * 80
    assert one(spark, X.escape_regex("t"), t="a.b*[c]\\") == "a\\.b\\*\\[c\\]\\\\"
    assert [one(spark, X.extension("t"), t=t) for t in ("a/b.tar.gz", ".bashrc", "a", "A.PY", "d.x/c")] == [".gz", "", "", ".PY", ""]
    assert [one(spark, X.language_of("t"), t=t) for t in ("a.PY", "x.tsx", "x.unknown", "py")] == ["python", "tsx", "unknown", "unknown"]
    assert [one(spark, X.duration(F.col("s")), s=s) for s in (1.5, 90.0, 7200.0)] == ["1.50s", "1.50min", "2.00hr"]


def test_frameworks_differ_by_level(spark):
    code = "@Component\nclass A {}"
    assert one(spark, X.framework_of_file("t"), t=code) == "angular" and one(spark, X.framework_of_chunk("t"), t=code) == "spring"
    assert one(spark, X.framework_of_file("t"), t="from django.db import x") == "django"
    assert one(spark, X.framework_of_chunk("t"), t="plain") is None


def test_quality_and_types(spark):
    def both(t, lang):
        i, s = X.ratios("t", F.lit(lang))
        df = spark.createDataFrame([(t,)], "t string").select(i.alias("i"), s.alias("s"))
        return df.select("i", "s", X.quality(F.col("i"), F.col("s")).alias("q"), X.chunk_type(F.col("i"), F.col("s")).alias("k")).first()

    r = both("import a\nimport b\nx = 1\ndef f():\n", "python")
    assert (r.i, r.s, r.q, r.k) == (0.5, 0.25, 0.75, "mixed")
    assert both("import a\n# c\n", "python").k == "imports" and both("def f(): pass\nx = 1", "python").k == "structural" and both("x\ny", "rust").k == "code"
    assert both("", "python").k == "empty" and both("", "python").q == 0.0
    assert one(spark, X.special_flags("t", F.lit("python")), t="@app.get('/')\nclass AView(B):") == ["flask_routes", "fastapi_routes", "django_views"]
    assert one(spark, X.structure_points("t", F.lit("python")), t="x\nclass A:\n    def f(self):\n") == [1, 2]


def test_preparation(spark):
    text = "def f():\n    a\n\n\n\n        b\n"
    assert one(spark, X.prepare("t"), t=text) == "def f():\na\n\n    b"
    assert one(spark, X.prepare("t", True), t=text).startswith("f():")
    assert one(spark, X.min_indent("t"), t="a\n  b\n") == 2
    made = one(spark, X.with_context(F.col("t"), F.lit("go"), F.lit(None).cast("string"), F.lit("code"), F.lit("n")), t="x")
    assert made == "Language: go\nType: code\nName: n\n\nx"


def test_markdown_kinds_and_titles(spark):
    kinds = [one(spark, X.markdown_type("t"), t=t) for t in ("```\n", "# a", "- a", "1. a", "plain")]
    assert kinds == ["code_block", "section", "list", "list", "text"]
    assert one(spark, X.title("t", F.lit(2), F.lit(9)), t="x\n## Head \ny") == "Head" and one(spark, X.title("t", F.lit(2), F.lit(9)), t="x") == "Chunk 2-9"


def test_regex_or_literal(spark):
    assert one(spark, X.matches("t", "a(", True), t="xa(b") and not one(spark, X.matches("t", "a(", True), t="xab")
    assert one(spark, X.matches("t", r"(É|x)\b", False), t="é") and not one(spark, X.matches("t", "É", True), t="é")


def test_vectors(spark):
    a, b = [1.0, 2.0, 2.0], [2.0, 0.0, 1.0]
    get = lambda kind: one(spark, V.distance(F.col("a"), F.col("b"), kind), a=a, b=b)
    assert get("cosine") == pytest.approx(1 - 4 / (3 * math.sqrt(5))) and get("l2") == pytest.approx(math.sqrt(6)) and get("dot") == -4
    assert one(spark, V.distance(F.col("a"), F.col("b")), a=a, b=[0.0, 0.0, 0.0]) is None
    with pytest.raises(ValueError):
        V.distance(F.col("a"), F.col("b"), "other")
    assert V.unpack(V.pack([1.5, -2.0])) == [1.5, -2.0] and V.pack([1.0]) == struct.pack("<f", 1.0)
    assert one(spark, V.shortened(F.col("a"), 2), a=[3.0, 4.0, 9.0]) == pytest.approx([0.6, 0.8])
    e = one(spark, V.fallback_embedding(F.col("t")), t="abc")
    raw = [x / 255 * 2 - 1 for x in hashlib.md5(b"abc").digest()]
    n = math.sqrt(sum(x * x for x in raw))
    assert len(e) == 1024 and e[:16] == pytest.approx([x / n for x in raw]) and not any(e[16:])
    assert not any(one(spark, V.fallback_embedding(F.col("t")), t=" "))
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    assert [list(r.v) for r in df.select(V.batch_embedder(lambda ts: [[float(len(t))] for t in ts])("t").alias("v")).collect()] == [[1.0], [2.0]]


def test_settings_cover_their_aliases():
    assert config.language("javascriptreact") is config.LANGUAGES["jsx"] and config.language("nothing").max_chars == 16000
