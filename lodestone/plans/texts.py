"""Line search, chunking, scalar functions, detectors, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunks, detect, grep, present, relate
from ..session import table
from ..sources import files as sources
from . import shapes as S
from .catalogue import query

WORD = r"(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NBL = r"length(regexp_replace({}, '[\s\x0b\x{{85}}\p{{Z}}\x1c-\x1f]', '', 'g'))"


def doc_lines(spark, d):
    return S.lines(spark, d).select(F.col("doc_id").cast("string").alias("path"), (F.col("pos") + 1).alias("line_number"), "line")


def docs(spark, d):
    return table(spark, d, "documents")


# --- line search


@query("p10_regex_lines", rf"WITH {S.LINES} SELECT doc_id::VARCHAR AS path, pos + 1 AS line_number FROM lines WHERE regexp_matches(line, '{WORD}')")
def p10_regex_lines(spark, d):
    return grep.grep(doc_lines(spark, d), r"\bthe\b").select("path", "line_number")


@query("p10_literal_fallback", f"WITH {S.LINES} SELECT doc_id::VARCHAR AS path, pos + 1 AS line_number FROM lines WHERE contains(line, '(')")
def p10_literal_fallback(spark, d):
    return grep.grep(doc_lines(spark, d), "(").select("path", "line_number")


@query("a5_f3_grep_rank", rf"WITH {S.LINES} SELECT doc_id::VARCHAR AS path, count(*) AS matches FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY 1 ORDER BY matches DESC, path LIMIT 20")
def a5_f3_grep_rank(spark, d):
    return grep.top_files(grep.grep(doc_lines(spark, d), r"\bthe\b"), 20)


@query("w1_grep_context", rf"WITH {S.LINES}, m AS (SELECT doc_id, pos FROM lines WHERE contains(line, 'worthless')) SELECT l.doc_id::VARCHAR AS path, l.pos + 1 AS line_number, contains(l.line, 'worthless') AS is_match FROM lines l WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = l.doc_id AND abs(m.pos - l.pos) <= 1)")
def w1_grep_context(spark, d):
    return grep.with_context(doc_lines(spark, d), grep.any_match("line", "worthless")).select("path", "line_number", "is_match")


@query("g2_multi_pattern", f"WITH {S.LINES} SELECT doc_id::VARCHAR AS path, pos + 1 AS line_number FROM lines WHERE contains(line, 'worthless') OR contains(line, 'token')")
def g2_multi_pattern(spark, d):
    return grep.grep(doc_lines(spark, d), "worthless, token").select("path", "line_number")


@query("f8_first_matches", f"WITH {S.LINES} SELECT doc_id::VARCHAR AS path, pos + 1 AS line_number FROM lines WHERE contains(line, 'tion') ORDER BY path, line_number LIMIT 50")
def f8_first_matches(spark, d):
    return grep.first_matches(doc_lines(spark, d), "tion", 10).select("path", "line_number")


@query("n5_grep_format", f"""WITH {S.LINES}, m AS (SELECT doc_id::VARCHAR AS path, pos + 1 AS line_number, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM lines WHERE contains(line, 'idiot'))
SELECT path, line_number, CASE WHEN nth = 1 THEN chr(10) || path || ':' || chr(10) ELSE '' END || '  █ ' || line_number || ': ' || line AS output FROM m""")
def n5_grep_format(spark, d):
    return grep.formatted(grep.grep(doc_lines(spark, d), "idiot").withColumn("is_match", F.lit(True)))


@query("p7_hidden", f"SELECT page_id FROM pages WHERE NOT regexp_matches({S.PATH}, '(^|/)\\.[^/.]')")
def p7_hidden(spark, d):
    return S.paths(spark, d).where(~grep.is_hidden("path")).select("page_id")


@query("p8_ignore", rf"SELECT page_id FROM pages WHERE NOT (regexp_matches({S.PATH}, '^.*/en/7.*$') OR regexp_matches(string_split({S.PATH}, '/')[-1], '^.*\.html$') OR string_split({S.PATH}, '/')[-1] = '42' OR (string_split({S.PATH}, '/')[-2] = 'fr'))")
def p8_ignore(spark, d):
    rules = grep.ignore_rules("# comment\n*/en/7*\n\n*.html\n42\nfr/\n")
    return S.paths(spark, d).where(~grep.is_ignored("path", rules)).select("page_id")


@query("p9_extension", rf"SELECT page_id FROM pages WHERE lower(regexp_extract(string_split({S.PATH}, '/')[-1], '\.([^.]+)$', 1)) IN ('html', 'php')")
def p9_extension(spark, d):
    return S.paths(spark, d).where(grep.has_extension("path", ".HTML, php")).select("page_id")


@query("o2_o3_globs", rf"SELECT page_id FROM pages WHERE regexp_matches({S.PATH}, '^.*example\.com/en/.*$') AND NOT regexp_matches({S.PATH}, '^.*\.html$')")
def o2_o3_globs(spark, d):
    return S.paths(spark, d).where(grep.in_globs("path", "*example.com/en/*", "*.html")).select("page_id")


@query("grep_enclosing")
def grep_enclosing(spark, d):
    return grep.enclosing(doc_lines(spark, d), grep.any_match("line", "worthless")).select("path", "line_number", "is_match")


# --- reading and listing


@query("s11_f7_read_slice", f"WITH {S.LINES}, g AS (SELECT doc_id, count(*)::INT AS total_lines, string_agg(CASE WHEN pos BETWEEN 2 AND 6 THEN line END, chr(10) ORDER BY pos) AS content FROM lines GROUP BY 1) SELECT doc_id, coalesce(content, '') AS content, total_lines, least(7, total_lines) AS end_line, (true) AS truncated, 2 AS lines_before, total_lines - least(7, total_lines) AS lines_after FROM g")
def s11_f7_read_slice(spark, d):
    return docs(spark, d).where(F.size(X.lines("text")) > 0).select("doc_id", sources.bounded("text", 3, 9, 5).alias("r")).select("doc_id", "r.content", "r.total_lines", "r.end_line", "r.truncated", "r.lines_before", "r.lines_after")


@query("f6_flat_listing", f"""WITH p AS (SELECT DISTINCT string_split({S.PATH}, '/')[1] AS name FROM pages), n AS (SELECT name, row_number() OVER (ORDER BY name)::INT AS place, count(*) OVER () AS total FROM p)
SELECT place, name, true AS is_directory FROM n WHERE place <= 10 UNION ALL SELECT 11, '... (' || (total - 10) || ' more items)', false FROM n WHERE place = 1 AND total > 10""")
def f6_flat_listing(spark, d):
    return sources.flat_listing(sources.entries(S.paths(spark, d)), "", 10)


@query("f5_budgeted_tree")
def f5_budgeted_tree(spark, d):
    shown, more = sources.budgeted_tree(sources.entries(S.paths(spark, d)), 100, 3)
    return spark.createDataFrame([(e["path"], e["is_directory"]) for e in shown] + [(f"... ({more} more items)", False)], "path string, is_directory boolean")


@query("s6_markdown_view", r"SELECT doc_id, '```' || CASE lang WHEN 'en' THEN 'python' ELSE 'json' END || chr(10) || text || chr(10) || '```' AS md FROM documents")
def s6_markdown_view(spark, d):
    path = F.when(F.col("lang") == "en", "a.py").otherwise("a.json")
    return docs(spark, d).select("doc_id", sources.as_markdown(path, "text").alias("md"))


def raw(spark, d):
    """Texts as files: in turn with a NUL after the text, with control bytes before a few characters, empty, and plain."""
    text = F.col("text").cast("binary")
    odd = F.col("doc_id") % 4
    content = F.when(odd == 0, F.concat(F.unhex(F.lit("00")), text)).when(odd == 1, F.concat(F.unhex(F.lit("0102030405060708" * 8)), F.substring("text", 1, 8).cast("binary"))).when(odd == 2, F.lit("").cast("binary")).otherwise(text)
    return docs(spark, d).withColumn("content", content).withColumn("path", F.when(F.col("doc_id") % 8 == 7, "a.png").otherwise("a.txt"))


@query("s5_binary", "SELECT doc_id, doc_id % 4 <> 3 OR doc_id % 8 = 7 OR text = '' AS is_binary FROM documents")
def s5_binary(spark, d):
    """A NUL at the begin, mostly control bytes, nothing at all, or the ending of a picture."""
    return raw(spark, d).select("doc_id", sources.is_binary("path", F.length("content"), "content").alias("is_binary"))


def _broken(spark, d):
    """Texts of every third document begin with the bytes E9 28, which aren't UTF-8."""
    text = F.col("text").cast("binary")
    return docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("E928")), F.substring("text", 1, 0).cast("binary"))).otherwise(text).alias("content"))


@query("s2_strict", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE 'ok' END AS state FROM documents")
def s2_strict(spark, d):
    return sources.decoded(_broken(spark, d)).select("doc_id", "text", F.when(F.col("error").isNull(), "ok").otherwise("bad").alias("state"))


@query("s3_latin1", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(233) || '(' ELSE text END AS text FROM documents")
def s3_latin1(spark, d):
    return sources.decoded(_broken(spark, d), "latin1").select("doc_id", "text")


@query("s4_replace", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(65533) || '(' ELSE text END AS text FROM documents")
def s4_replace(spark, d):
    return sources.decoded(_broken(spark, d), "replace").select("doc_id", "text")


# --- chunks

_FOLD = r"""f AS (SELECT doc_id, pos, s, s AS acc, 0 AS grp FROM z WHERE pos = 0 UNION ALL
SELECT z.doc_id, z.pos, z.s, CASE WHEN f.acc + z.s <= 200 THEN f.acc + z.s ELSE z.s END, CASE WHEN f.acc + z.s <= 200 THEN f.grp ELSE f.grp + 1 END FROM f JOIN z ON z.doc_id = f.doc_id AND z.pos = f.pos + 1)"""


@query("w2_coalesce", f"WITH RECURSIVE {S.LINES}, z AS (SELECT doc_id, pos, length(line)::INT AS s FROM lines), {_FOLD}, g AS (SELECT doc_id, grp, max(acc) AS m FROM f GROUP BY ALL) SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY grp) AS sizes FROM g GROUP BY 1")
def w2_coalesce(spark, d):
    sizes = chunks.coalesced(F.transform(X.lines("text"), lambda s: F.length(s)), 200)
    return docs(spark, d).where(F.size(X.lines("text")) > 0).select("doc_id", F.array_join(F.transform(sizes, lambda v: v.cast("string")), ",").alias("sizes"))


@query("w3_gap_fill", f"WITH {S.LINES}, {S.BLOCKS} SELECT block_id, start_line, coalesce(lead(start_line) OVER (PARTITION BY doc_id ORDER BY start_line), end_line) AS end_line FROM blocks WHERE block_id % 2 = 0")
def w3_gap_fill(spark, d):
    b = S.line_blocks(S.lines(spark, d)).where("block_id % 2 = 0")  # with gaps to fill
    return chunks.gap_filled(b, "doc_id").select("block_id", "start_line", "end_line")


MD = r"""m0 AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->', '', 'g'),
'(?i)<h([1-6])[^>]*>', chr(10) || '## ', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)<p[^>]*>', chr(10) || chr(10), 'g'), '(?i)<(br|div|tr)[^>]*>|</h[1-6]>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g')) AS md FROM pages),
m1 AS (SELECT page_id, string_split_regex(md, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM m0), m2 AS (SELECT page_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM m1),
ml AS (SELECT page_id, unnest(l) AS line, unnest(range(len(l)))::INT AS pos FROM m2)"""


def markdown_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(X.lines(sources.html_as_markdown(F.col("html")))).alias("pos", "line"))


@query("w7_segments", rf"WITH {MD}, s AS (SELECT page_id, pos, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') OR regexp_matches(line, '^\s*[-*_]{{3,}}\s*$') OR regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS segment FROM ml) SELECT page_id, segment::BIGINT AS segment, count(*) AS n FROM s GROUP BY ALL")
def w7_segments(spark, d):
    s = chunks.segments(markdown_lines(spark, d), chunks.is_markdown_boundary("line"), "page_id")
    return s.groupBy("page_id", "segment").agg(F.count("*").alias("n"))


@query("d10_w4_headings", rf"""WITH {MD}, h AS (SELECT page_id, pos, length(regexp_extract(line, '^\s*(#+)\s+(.+)', 1)) AS level, trim(regexp_extract(line, '^\s*(#+)\s+(.+)', 2)) AS name FROM ml WHERE regexp_matches(line, '^\s*#+\s+.+')),
g AS (SELECT *, level - first_value(level) OVER (PARTITION BY page_id ORDER BY pos) AS deeper FROM h) SELECT page_id, pos, level::INT AS level, 'heading' || (deeper + 1) AS element_type, name FROM g WHERE deeper BETWEEN 0 AND 2""")
def d10_w4_headings(spark, d):
    return detect.headings(markdown_lines(spark, d), "page_id")


@query("w8_offsets", f"WITH {S.LINES} SELECT doc_id, pos, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM lines")
def w8_offsets(spark, d):
    return chunks.line_offsets(S.lines(spark, d), "doc_id").select("doc_id", "pos", F.col("offset").cast("long").alias("byte_offset"))


@query("w5_indent_ends", f"WITH {S.LINES}, h AS (SELECT * FROM lines WHERE pos % 5 = 0 AND trim(line) <> ''), n AS (SELECT doc_id, max(pos) AS last_pos FROM lines GROUP BY 1) SELECT h.doc_id, h.pos, coalesce((SELECT min(l.pos) FROM lines l WHERE l.doc_id = h.doc_id AND l.pos > h.pos AND trim(l.line) <> '' AND length(l.line) - length(ltrim(l.line)) <= length(h.line) - length(ltrim(h.line))) - 1, n.last_pos)::INT AS end_pos FROM h JOIN n USING (doc_id)")
def w5_indent_ends(spark, d):
    ls = S.lines(spark, d)
    heads = ls.where((F.col("pos") % 5 == 0) & (F.trim("line") != "")).select("doc_id", "pos", F.length(F.regexp_extract("line", r"^\s*", 0)).alias("indent"))
    return relate.indented_ends(ls, heads, "doc_id").select("doc_id", "pos", "end_pos")


@query("w6_brace_ends", r"""WITH b0 AS (SELECT page_id, string_split_regex(regexp_replace(html, '([{}])', '\1' || chr(10), 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM pages), b1 AS (SELECT page_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM b0),
b2 AS (SELECT page_id, unnest(l) AS line, unnest(range(len(l)))::INT AS pos FROM b1), n AS (SELECT page_id, pos, (length(replace(line, '}', '')) - length(replace(line, '{', ''))) AS net FROM b2),
d AS (SELECT *, sum(net) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM n) SELECT h.page_id, h.pos, min(e.pos)::INT AS end_pos FROM d h JOIN d e ON e.page_id = h.page_id AND e.pos > h.pos AND e.depth <= h.depth - h.net WHERE h.net > 0 GROUP BY ALL""")
def w6_brace_ends(spark, d):
    ls = table(spark, d, "pages").select("page_id", F.posexplode(X.lines(F.regexp_replace("html", r"([{}])", "$1\n"))).alias("pos", "line"))
    return relate.braced_ends(ls, "page_id")


@query("c5_markdown_chunks")
def c5_markdown_chunks(spark, d):
    f = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("a.md").alias("path"), sources.html_as_markdown(F.col("html")).alias("text"))
    return chunks.described(chunks.chunked(f)).select("file_id", "chunk_id", "start_line", "end_line", "chunk_type", "tokens", "title")


@query("c1_code_chunks")
def c1_code_chunks(spark, d):
    f = docs(spark, d).select(F.col("doc_id").alias("file_id"), F.lit("a.py").alias("path"), "text")
    return chunks.described(chunks.chunked(f)).select("file_id", "chunk_id", "start_line", "end_line", "chunk_type", "non_whitespace_len", F.round("quality_score", 6).alias("quality"))


_PY = (r"^\s*import\s+.*$", r"^\s*from\s+.*\s+import\s+.*$", r"^\s*#.*$", r'"""[\s\S]*?"""', r"''''''[\s\S]*?''''''"), (r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+", r"^\s*@\w+", r"^\s*@(app|router)\.(get|post|put|delete|patch)")
_HITS = lambda ps: " + ".join(f"regexp_matches(line, '{p}')::INT" for p in ps)


@query("a6_x14_quality", f"""WITH {S.LINES}, t AS (SELECT doc_id, count(*) AS n, sum({_HITS(_PY[0])}) AS i, sum({_HITS(_PY[1])}) AS s FROM lines GROUP BY 1), r AS (SELECT doc_id, i / n::DOUBLE AS i, s / n::DOUBLE AS s FROM t)
SELECT doc_id, round(1 - i + s, 6) AS quality, CASE WHEN i > 0.7 THEN 'imports' WHEN i > 0.3 THEN 'mixed' WHEN s > 0.3 THEN 'structural' ELSE 'code' END AS chunk_type FROM r""")
def a6_x14_quality(spark, d):
    i, s = X.ratios("text", F.lit("python"))
    return docs(spark, d).where(F.size(X.lines("text")) > 0).select("doc_id", i.alias("i"), s.alias("s")).select("doc_id", F.round(X.quality(F.col("i"), F.col("s")), 6).alias("quality"), X.chunk_type(F.col("i"), F.col("s")).alias("chunk_type"))


# --- scalars


@query("x4_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def x4_hash(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash("text").alias("h"))


@query("x5_fallback_embedding", """WITH b AS (SELECT doc_id, list_transform(range(16), lambda i: ('0x' || md5(text)[2 * i + 1:2 * i + 2])::INT / 255.0::DOUBLE * 2 - 1) AS v FROM documents), n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS n FROM b)
SELECT doc_id, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS sixteenth, 64 AS dim FROM n""")
def x5_fallback_embedding(spark, d):
    v = docs(spark, d).select("doc_id", V.fallback_embedding(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("sixteenth"), F.size("v").alias("dim"))


@query("x7_a8_prepare", f"WITH {S.LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS prepared FROM lines GROUP BY 1")
def x7_a8_prepare(spark, d):
    """No document is indented or has two blank lines in a row, so the text comes back without its last line end."""
    return docs(spark, d).where(F.size(X.lines("text")) > 0).select("doc_id", X.prepare("text").alias("prepared"))


@query("a8_min_indent", f"WITH {S.LINES} SELECT doc_id, coalesce(min(CASE WHEN trim(line) <> '' AND pos % 5 > 0 THEN pos % 5 + 1 END), 0)::INT AS least FROM lines GROUP BY 1")
def a8_min_indent(spark, d):
    """Lines are indented by their place, and each fifth isn't."""
    ls = F.transform(X.lines("text"), lambda s, i: F.when(i % 5 > 0, F.concat(F.repeat(F.lit(" "), i % 5 + 1), F.ltrim(s))).otherwise(F.ltrim(s)))
    return docs(spark, d).where(F.size(X.lines("text")) > 0).withColumn("text", F.array_join(ls, "\n")).select("doc_id", X.min_indent("text").alias("least"))


@query("x7_context", "SELECT doc_id, 'Language: ' || lang || chr(10) || 'Type: code' || chr(10) || chr(10) || text AS t FROM documents")
def x7_context(spark, d):
    return docs(spark, d).select("doc_id", X.with_context(F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.lit("code")).alias("t"))


@query("x9_x10_counts", f"SELECT doc_id, {NBL.format('text')}::INT AS non_blank, (length(text) // 4)::INT AS tokens FROM documents")
def x9_x10_counts(spark, d):
    return docs(spark, d).select("doc_id", X.non_blank_length("text").alias("non_blank"), X.token_count("text").alias("tokens"))


@query("x11_x25_paths", rf"SELECT page_id, string_split({S.PATH}, '/')[-1] AS name, regexp_extract(string_split({S.PATH}, '/')[-1], '[^.](\.[^.]*)$', 1) AS ext, CASE lower(regexp_extract(string_split({S.PATH}, '/')[-1], '[^.](\.[^.]*)$', 1)) WHEN '.html' THEN 'html' WHEN '.py' THEN 'python' WHEN '.css' THEN 'css' WHEN '.c' THEN 'c' ELSE 'unknown' END AS language FROM pages")
def x11_x25_paths(spark, d):
    return S.paths(spark, d).select("page_id", X.base_name("path").alias("name"), X.extension("path").alias("ext"), X.language_of("path").alias("language"))


@query("x12_x13_framework", "SELECT page_id, CASE WHEN contains(html, 'createApp') OR contains(html, '<template>') THEN 'vue' END AS by_words, CASE WHEN regexp_matches(html, 'createApp|<template>|<script\\s+setup>') THEN 'vue' END AS by_patterns FROM pages")
def x12_x13_framework(spark, d):
    return table(spark, d, "pages").select("page_id", X.framework_of_file("html").alias("by_words"), X.framework_of_chunk("html").alias("by_patterns"))


@query("x15_x16_markdown_type", rf"WITH {MD} SELECT page_id, CASE WHEN contains(md, '```') THEN 'code_block' WHEN regexp_matches(md, '(?m)^#{{1,6}}\s+') THEN 'section' WHEN regexp_matches(md, '(?m)^\s*[-*+]\s+|^\s*\d+\.\s+') THEN 'list' ELSE 'text' END AS kind, CASE WHEN regexp_extract(md, '(?m)^#{{1,6}}\s+(.+)$', 1) <> '' THEN trim(regexp_extract(md, '(?m)^#{{1,6}}\s+(.+)$', 1)) ELSE 'Chunk 0-1' END AS title FROM m0")
def x15_x16_markdown_type(spark, d):
    p = table(spark, d, "pages").select("page_id", sources.html_as_markdown(F.col("html")).alias("md"))
    return p.select("page_id", X.markdown_type("md").alias("kind"), X.title("md", F.lit(0), F.lit(1)).alias("title"))


@query("x17_special_flags", r"SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(html, '<form[\s\S]*?</form>') THEN 'forms' END, CASE WHEN regexp_matches(html, '<script>[\s\S]*?</script>') THEN 'scripts' END, CASE WHEN regexp_matches(html, '<style>[\s\S]*?</style>') THEN 'styles' END) AS flags FROM pages")
def x17_special_flags(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.special_flags("html", F.lit("html"))), ",").alias("flags"))


@query("x18_structure_points", rf"WITH {S.LINES} SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS points FROM lines WHERE regexp_matches(CASE pos % 4 WHEN 0 THEN 'def f(' || line WHEN 2 THEN 'class C' ELSE line END, '{'|'.join(_PY[1])}') GROUP BY 1")
def x18_structure_points(spark, d):
    """Every fourth line is made a function's head and every other even one a class's."""
    ls = F.transform(X.lines("text"), lambda s, i: F.when(i % 4 == 0, F.concat(F.lit("def f("), s)).when(i % 4 == 2, "class C").otherwise(s))
    p = docs(spark, d).withColumn("text", F.array_join(ls, "\n")).select("doc_id", F.array_join(F.transform(X.structure_points("text", F.lit("python")), lambda i: i.cast("string")), ",").alias("points"))
    return p.where("points <> ''")


@query("x19_line_slice", f"WITH {S.LINES} SELECT doc_id, coalesce(string_agg(CASE WHEN pos BETWEEN 1 AND 3 THEN line END, chr(10) ORDER BY pos), '') AS part FROM lines GROUP BY 1")
def x19_line_slice(spark, d):
    return docs(spark, d).where(F.size(X.lines("text")) > 0).select("doc_id", X.line_slice("text", 1, 4).alias("part"))


@query("x20_escape", r"SELECT page_id, regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped FROM pages")
def x20_escape(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_regex("url").alias("escaped"))


@query("x21_names", r"SELECT doc_id, regexp_matches(string_split(text, ' ')[1], '^[A-Z][A-Za-z0-9]*$') AS pascal, regexp_matches(string_split(text, ' ')[1], '^use[A-Z]') AS hook FROM documents")
def x21_names(spark, d):
    w = F.split("text", " ")[0]
    return docs(spark, d).select("doc_id", X.is_pascal_case(w).alias("pascal"), X.is_hook_name(w).alias("hook"))


@query("x22_json", "SELECT event_id, json_object('k', CAST(json_extract_string(props, '$.k') AS INT))::VARCHAR AS j FROM events")
def x22_json(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k int")["k"].alias("k"))).alias("j"))


@query("x23_duration", """WITH t AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 60 THEN 1 WHEN n_chars < 3600 THEN 60 ELSE 3600 END AS per, CASE WHEN n_chars < 60 THEN 's' WHEN n_chars < 3600 THEN 'min' ELSE 'hr' END AS unit FROM documents),
u AS (SELECT doc_id, unit, floor(n_chars::DOUBLE * 100 / per + 0.5)::BIGINT AS n FROM t) SELECT doc_id, (n // 100)::VARCHAR || '.' || lpad((n % 100)::VARCHAR, 2, '0') || unit AS took FROM u""")
def x23_duration(spark, d):
    return docs(spark, d).select("doc_id", X.duration(F.col("n_chars").cast("double")).alias("took"))


@query("x24_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:77] || '...' ELSE text END AS name FROM documents")
def x24_truncate(spark, d):
    return docs(spark, d).select("doc_id", X.truncate("text", 80).alias("name"))


@query("f11_preview", f"WITH {S.LINES} SELECT doc_id, CASE WHEN length(line) > 60 THEN line[1:60] || '...' ELSE line END AS first FROM lines WHERE pos = 0")
def f11_preview(spark, d):
    from ..operators.search import preview

    first, _ = preview("text")
    return docs(spark, d).where(F.size(X.lines("text")) > 0).select("doc_id", first.alias("first"))


# --- detectors


@query("d4_html_tags", r"WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z0-9\-]+)', 1))) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t WHERE tag NOT IN ('p', 'span') GROUP BY 1")
def d4_html_tags(spark, d):
    t = table(spark, d, "pages").select("page_id", F.explode(detect.tag_counts("html")).alias("tag")).where(~F.col("tag").isin("p", "span"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("d5_css_selectors", r"SELECT page_id, trim(regexp_replace(unnest(regexp_extract_all(regexp_extract(html, '<style>(.*?)</style>', 1), '([^{}/]+)\{[^{}]*?\}', 1)), '\s+', ' ', 'g')) AS selector FROM pages")
def d5_css_selectors(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(detect.css_selectors(F.regexp_extract("html", "<style>(.*?)</style>", 1))).alias("selector"))


@query("d9_properties", rf"""WITH {S.LINES}, k AS (SELECT *, regexp_extract(line, '^\s*([^\s:=]+)\s*[:=\s]\s*(.*)', 1) AS k FROM lines WHERE trim(line) <> '')
SELECT doc_id, pos, CASE WHEN regexp_matches(trim(line), '^[#!]') THEN 'comment' WHEN k <> '' THEN 'key' ELSE 'unknown' END AS element_type FROM k""")
def d9_properties(spark, d):
    return detect.property_rows(S.lines(spark, d)).select("doc_id", "pos", "element_type")


@query("f4_truncate", rf"""WITH {S.LINES}, n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM lines)
SELECT doc_id, nth::INT AS nth, pos AS line, 'x' AS name FROM n WHERE nth <= 5 UNION ALL SELECT doc_id, 6, pos, '[... Truncated - 5/' || total || ' elements shown ...]' FROM n WHERE nth = 5 AND total > 5""")
def f4_truncate(spark, d):
    rows = S.lines(spark, d).select("doc_id", F.col("pos").alias("line"), F.col("pos").alias("end_line"), F.lit("x").alias("name"))
    return detect.truncated(rows, "doc_id", ["line"], 5).select("doc_id", "nth", "line", "name")


@query("a10_first_lines", """WITH t AS (SELECT event_id AS file_id, event_id % 3 AS pad, event_type FROM events)
SELECT file_id, unnest(['<root>', '<kind>', '<row n="1">', '<row n="2">']) AS name, unnest([0, pad + 1, pad + 2, pad + 2])::INT AS start_line FROM t""")
def a10_first_lines(spark, d):
    """A tag's line is the first where it stands whole; the root's never does, and repeated tags share theirs."""
    pad = F.repeat(F.lit("\n"), (F.col("event_id") % 3).cast("int"))
    text = F.concat(F.lit("<root>\n"), pad, F.lit("<kind>"), F.col("event_type"), F.lit('</kind>\n<row n="1"/>\n<row n="2"/>\n</root>'))
    files = table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.lit("a.xml").alias("path"), text.alias("text"))
    return detect.elements(files).select("file_id", "name", "start_line")


#: Sources made for each customer: {k} is its key; blank lines, as many as its key modulo 3, follow the line at which the file is cut.
#: Expected rows are (type, kind, name, first line, last line), lines counted without the blank ones.
_SOURCES = {
    "python": (
        ["import os", "from a.b import c{k}", "", "LIMIT_{k} = 3", "", "class Box{k}(Base):", "    def get{k}(self):", "        return c{k}", "", "def run{k}(x):", "    return os"], 3,
        [("import", "def", "import os", 0, 0), ("import", "def", "from a.b import c{k}", 1, 1), ("global_variable", "def", "LIMIT_{k}", 3, 3), ("class", "def", "Box{k}", 5, 8), ("class_method", "def", "Box{k}.get{k}", 6, 8), ("function", "def", "run{k}", 9, 10)],
    ),
    "java": (
        ["package com.acme;", "", "import com.acme.util.Tool{k};", "import java.util.List;", "", "public class Box{k} {", "    private int size{k} = 3;", "", "    public int get{k}(int x) {", "        return size{k};", "    }", "}"], 5,
        [("package", "def", "com.acme", 0, 0), ("import", "def", "com.acme.util.Tool{k}", 2, 2), ("class", "def", "Box{k}", 5, 11), ("field", "def", "Box{k}.size{k}", 6, 6), ("method", "def", "Box{k}.get{k}", 8, 10)],
    ),
    "javascript": (
        ["import {{ a{k} }} from './m{k}';", "", "const K{k} = 3;", "", "function get{k}(x) {{", "  return a{k};", "}}", "", "class Box{k} {{", "  run{k}() {{", "    return 1;", "  }}", "}}"], 4,
        [("import", "def", "{ a{k} } from './m{k}'", 0, 0), ("variable", "def", "K{k}", 2, 2), ("function", "def", "get{k} (uses: a{k})", 4, 6), ("class", "def", "Box{k}", 8, 12), ("method", "def", "Box{k}.run{k}", 9, 11)],
    ),
    "css": (  # a selector begins where what stands before it ends
        ["/* card {k} */", ".card{k} > a,", ".b {{ color: red; }}", "#id{k} {{}}", "@import 'x{k}';"], 1,
        [("comment", "comment", "/* card {k} */", 0, 0), ("selector", "def", ".card{k} > a, .b {...}", 0, 2), ("selector", "def", "#id{k} {...}", 2, 3), ("at-rule", "def", "@import ...", 4, 4)],
    ),
    "json": (
        ["{{", '  "name": "n{k}",', '  "size": 1{k}000000,', '  "on": true', "}}"], 1,
        [("object", "struct", "root {...}", 0, 4), ("key", "key", '"name" :', 1, 1), ("string", "literal", "'n{k}'", 0, 0), ("key", "key", '"size" :', 2, 2), ("number", "literal", "'1{k}000000'", 0, 0), ("key", "key", '"on" :', 3, 3), ("number", "literal", "'True'", 0, 0)],
    ),
}


def _made(spark, d, name):
    lines, cut, _ = _SOURCES[name]
    k = F.col("c_custkey").cast("string")
    filled = lambda part: F.replace(F.lit("\n".join(part).replace("{{", "{").replace("}}", "}")), F.lit("{k}"), k)
    text = F.concat(filled([*lines[:cut], ""]), F.repeat(F.lit("\n"), (F.col("c_custkey") % 3).cast("int")), filled(lines[cut:]))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.lit("a").alias("path"), text.alias("text"))


def _expected(name: str) -> str:
    _, cut, rows = _SOURCES[name]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(t)}, {quoted(kind)}, {quoted(n)}, {a}, {int(a >= cut)}, {b}, {int(b >= cut)})" for t, kind, n, a, b in rows)
    return f"""WITH r(element_type, kind, name, a, am, b, bm) AS (VALUES {values}), f AS (SELECT c_custkey AS file_id, c_custkey % 3 AS pad FROM customer)
SELECT file_id, element_type, kind, replace(name, '{{k}}', file_id::VARCHAR) AS name, (a + am * pad)::INT AS start_line, (b + bm * pad)::INT AS end_line FROM f, r"""


def _detector(name, make):
    def run(spark, d):
        return detect.elements(make(spark, d), name).select("file_id", "element_no", "element_type", "kind", "name", "start_line", "end_line")

    return run


def _docs(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("file_id"), F.lit("a").alias("path"), "text")


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("a").alias("path"), F.regexp_replace("html", "(</[a-z0-9]+>)", "$1\n").alias("text"))


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.lit("a").alias("path"), F.col("props").alias("text"))


for _no, _lang in (("d1", "python"), ("d2", "java"), ("d3", "javascript"), ("d5", "css"), ("d6", "json")):
    query(f"{_no}_{_lang}", _expected(_lang))(lambda spark, d, lang=_lang: detect.elements(_made(spark, d, lang), lang).select("file_id", "element_type", "kind", "name", "start_line", "end_line"))

for _name, _lang, _make in (
    ("d3_javascript_pages", "javascript", _pages), ("d4_html", "html", _pages), ("d5_css_pages", "css", _pages),
    ("d7_yaml", "yaml", _events), ("d8_xml", "xml", _pages), ("d9_properties_rows", "properties", _docs), ("d10_markdown", "markdown", lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("a").alias("path"), sources.html_as_markdown(F.col("html")).alias("text"))),
):
    query(_name)(_detector(_lang, _make))


@query("n1_structure_tree")
def n1_structure_tree(spark, d):
    return present.structure_tree(detect.elements(_pages(spark, d), "html").withColumn("page", F.col("file_id")), "page")


@query("n3_fragments")
def n3_fragments(spark, d):
    ls = S.lines(spark, d)
    e = S.elements(ls)
    return present.fragments(relate.assigned(S.line_blocks(ls).withColumnRenamed("block_id", "chunk_id"), e, "doc_id"), e, "doc_id")


@query("j13_fence_pairs", f"""WITH {S.LINES}, f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS end_pos FROM lines WHERE pos % 3 = 0)
SELECT doc_id, pos AS start_pos, end_pos, 'py' AS language FROM f WHERE nth % 2 = 1""")
def j13_fence_pairs(spark, d):
    """Every third line is made a fence."""
    ls = S.lines(spark, d).withColumn("line", F.when(F.col("pos") % 3 == 0, "```py").otherwise(F.col("line")))
    return detect.fences(ls, "doc_id")


@query("n7_chunk_display", "SELECT doc_id, 'Chunk ' || (doc_id % 50 + 1) || '-' || (doc_id % 50 + n_chars % 9 + 1) || ' ' || CASE doc_id % 3 WHEN 0 THEN 'CODE' WHEN 1 THEN 'MIXED' ELSE 'IMPORTS' END || CASE WHEN lang = 'en' THEN ' [en]' ELSE '' END || ' ' || source AS shown FROM documents")
def n7_chunk_display(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "code").when(F.col("doc_id") % 3 == 1, "mixed").otherwise("imports")
    start = (F.col("doc_id") % 50).cast("int")
    shown = present.chunk_line(start, start + (F.col("n_chars") % 9).cast("int") + 1, kind, F.when(F.col("lang") == "en", F.col("lang")), F.col("source"))
    return docs(spark, d).select("doc_id", shown.alias("shown"))


@query("n4_markdown_tree")
def n4_markdown_tree(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("a").alias("path"), sources.html_as_markdown(F.col("html")).alias("text"))
    return present.structure_tree(detect.elements(p, "markdown").withColumn("page", F.col("file_id")), "page")
