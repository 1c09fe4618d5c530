"""Search, filters, joins of blocks and elements, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import rank, relate, search, store
from ..session import table
from . import shapes as S
from .catalogue import query

COSINE = "list_cosine_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KEYWORD = f"SELECT d.doc_id AS block_id, l.quality::DOUBLE AS q, {{extra}} FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {FOLD.format('d.text')} LIKE '%The of%'.lower() ORDER BY q DESC NULLS LAST, block_id LIMIT 10".replace("'%The of%'.lower()", "'%the of%'")


def _vector(spark, d, kind, filters=search.Filters(language="en"), k=10):
    c = search.filtered(S.blocks(spark, d), S.files(spark, d), filters)
    return search.vector_topk(c, S.embeddings(spark, d), S.first_vector(spark, d), k, kind)


@query("f1_vector_topk", f"SELECT e.vec_id AS block_id, d.source AS repo_name, round({COSINE}, 6) AS distance, round(1 - {COSINE}, 6) AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en' ORDER BY {COSINE}, block_id LIMIT 10")
def f1_vector_topk(spark, d):
    return _vector(spark, d, "cosine").select("block_id", "repo_name", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("f1_vector_l2", "SELECT e.vec_id AS block_id, round(list_distance(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en' ORDER BY distance, block_id LIMIT 10")
def f1_vector_l2(spark, d):
    return _vector(spark, d, "l2").select("block_id", F.round("distance", 6).alias("distance"))


@query("f1_vector_dot", "SELECT e.vec_id AS block_id, round(-list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en' ORDER BY distance, block_id LIMIT 10")
def f1_vector_dot(spark, d):
    return _vector(spark, d, "dot").select("block_id", F.round("distance", 6).alias("distance"))


@query("f2_keyword_topk", KEYWORD.format(extra="d.lang AS language"))
def f2_keyword_topk(spark, d):
    hits = search.keyword_topk(search.filtered(S.blocks(spark, d), S.files(spark, d), search.Filters()), "The of", 10)
    return hits.select("block_id", F.col("quality_score").alias("q"), "language")


@query("g1_hybrid", f"""WITH k AS ({KEYWORD.format(extra="NULL::DOUBLE AS distance").replace("LIMIT 10", "LIMIT 4")}),
v AS (SELECT e.vec_id AS block_id, {COSINE} AS distance FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id ORDER BY distance, block_id LIMIT 10),
u AS (SELECT block_id, 0 AS source, row_number() OVER (ORDER BY q DESC NULLS LAST, block_id) AS place, NULL::DOUBLE AS distance FROM k
UNION ALL SELECT block_id, 1, row_number() OVER (ORDER BY distance, block_id), distance FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY source) AS nth FROM u)
SELECT block_id, source, place::INT AS place, round(distance, 6) AS distance FROM r WHERE nth = 1 ORDER BY source, place LIMIT 10""")
def g1_hybrid(spark, d):
    c = search.filtered(S.blocks(spark, d), S.files(spark, d), search.Filters())
    hits = search.hybrid_topk(search.keyword_topk(c, "The of", 4), search.vector_topk(c, S.embeddings(spark, d), S.first_vector(spark, d), 10), 10)
    return hits.select("block_id", "source", "place", F.round("distance", 6).alias("distance"))


@query("p1_equality", "SELECT doc_id AS block_id FROM documents WHERE source = 'src3' AND lang = 'en'")
def p1_equality(spark, d):
    return search.filtered(S.blocks(spark, d), S.files(spark, d), search.Filters("src3", "en")).select("block_id")


@query("p2_framework_or", "SELECT doc_id AS block_id FROM documents WHERE source = 'src5' OR (contains(text, 'src5') AND false)")
def p2_framework_or(spark, d):
    return search.filtered(S.blocks(spark, d), S.files(spark, d), search.Filters(framework="src5")).select("block_id")


@query("p3_j3_element_semi", f"WITH {S.LINES}, {S.ELEMENTS}, {S.BLOCKS} SELECT block_id, start_line, end_line FROM blocks b WHERE EXISTS (SELECT 1 FROM elements e WHERE e.doc_id = b.doc_id AND e.element_type = 'function' AND b.start_line <= e.end_line AND b.end_line >= e.start_line)")
def p3_j3_element_semi(spark, d):
    ls = S.lines(spark, d)
    b, e = S.line_blocks(ls), S.elements(ls).where("element_type = 'function'").select(F.col("doc_id").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("t"))
    return b.join(e, (b.doc_id == e.f) & search.overlap(b.start_line, b.end_line, e.s, e.t), "left_semi").select("block_id", "start_line", "end_line")


@query("p4_like_wildcards", f"SELECT doc_id FROM documents WHERE {FOLD.format('text')} LIKE '%th_t%and of%'")
def p4_like_wildcards(spark, d):
    return table(spark, d, "documents").where(X.like("text", "Th_t%AND of")).select("doc_id")


@query("p5_blank_after_limit", "SELECT conv_id, turn FROM (SELECT * FROM conversations ORDER BY length(text), conv_id, turn LIMIT 50) WHERE trim(text) <> ''")
def p5_blank_after_limit(spark, d):
    c = table(spark, d, "conversations").withColumn("content", F.col("text")).orderBy(F.length("text"), "conv_id", "turn").limit(50)
    return search.without_blank(c).select("conv_id", "turn")


@query("p6_min_quality", "SELECT d.doc_id AS block_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 0.5 AND d.lang = 'fr'")
def p6_min_quality(spark, d):
    return search.filtered(S.blocks(spark, d), S.files(spark, d), search.Filters(language="fr", min_quality=0.5)).select("block_id")


@query("p11_projection", f"SELECT e.vec_id AS block_id, d.source || '/' || d.doc_id || '.txt' AS file_path, d.doc_id || '.txt' AS filename, round(1 - {COSINE}, 6) AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id ORDER BY {COSINE}, block_id LIMIT 5")
def p11_projection(spark, d):
    v = S.first_vector(spark, d)
    e = S.elements(S.lines(spark, d)).withColumnRenamed("doc_id", "file_id")
    hits = search.search(S.files(spark, d), S.blocks(spark, d), e, S.embeddings(spark, d), "", lambda _: v)
    return hits.select("block_id", "file_path", "filename", F.round("similarity", 6).alias("similarity"))


@query("j1_three_way", "SELECT d.lang AS language, count(*) AS n, count(DISTINCT e.label) AS labels FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def j1_three_way(spark, d):
    b = S.blocks(spark, d).join(S.files(spark, d).select("file_id", "language"), "file_id")
    return b.join(table(spark, d, "embeddings"), b.block_id == F.col("vec_id")).groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@query("j4_f9_block_elements", f"""WITH {S.LINES}, {S.ELEMENTS}, {S.BLOCKS}, j AS (SELECT block_id, e.name, e.start_line AS s, e.element_id, row_number() OVER (PARTITION BY block_id ORDER BY e.start_line, e.element_id) AS nth
FROM blocks b JOIN elements e ON e.doc_id = b.doc_id AND b.start_line <= e.end_line AND b.end_line >= e.start_line)
SELECT block_id, string_agg(name, '|' ORDER BY nth) AS names, count(*) AS n FROM j WHERE nth <= 3 GROUP BY 1""")
def j4_f9_block_elements(spark, d):
    ls = S.lines(spark, d)
    hits = search.with_elements(S.line_blocks(ls).withColumnRenamed("doc_id", "file_id"), S.elements(ls).withColumnRenamed("doc_id", "file_id"), 3)
    return hits.where(F.size("semantic_elements") > 0).select("block_id", F.array_join(F.transform("semantic_elements", lambda e: e["name"]), "|").alias("names"), F.size("semantic_elements").cast("long").alias("n"))


@query("j6_chunk_assign", f"""WITH {S.LINES}, {S.ELEMENTS}, {S.BLOCKS} SELECT block_id, element_id FROM blocks b JOIN elements e USING (doc_id) WHERE (e.start_line >= b.start_line AND e.end_line < b.end_line) OR (e.start_line <= b.start_line AND e.end_line >= b.end_line)
OR (((e.start_line >= b.start_line AND e.start_line < b.end_line) OR (e.end_line >= b.start_line AND e.end_line < b.end_line)) AND e.end_line > e.start_line AND (least(e.end_line, b.end_line) - greatest(e.start_line, b.start_line)) / (e.end_line - e.start_line)::DOUBLE > 0.3)""")
def j6_chunk_assign(spark, d):
    ls = S.lines(spark, d)
    return relate.assigned(S.line_blocks(ls).withColumnRenamed("block_id", "chunk_id"), S.elements(ls), "doc_id").select(F.col("chunk_id").alias("block_id"), "element_id")


@query("j7_hierarchy", f"WITH {S.LINES}, {S.ELEMENTS} SELECT a.element_id AS outer_id, b.element_id AS inner_id FROM elements a JOIN elements b USING (doc_id) WHERE b.start_line >= a.start_line AND b.end_line <= a.end_line AND NOT (a.start_line = b.start_line AND a.end_line = b.end_line)")
def j7_hierarchy(spark, d):
    return relate.hierarchy(S.elements(S.lines(spark, d)), "doc_id").select(F.col("outer").alias("outer_id"), F.col("inner").alias("inner_id"))


@query("j8_parent", """WITH e AS (SELECT lang AS file_id, doc_id AS element_id, doc_id AS element_no, CASE WHEN doc_id % 5 = 0 THEN source ELSE source || '.m' || doc_id % 7 END AS name FROM documents),
p AS (SELECT file_id, name AS pname, arg_max(element_id, element_no) AS parent_id FROM e GROUP BY ALL)
SELECT e.element_id, p.parent_id FROM e LEFT JOIN p ON p.file_id = e.file_id AND contains(e.name, '.') AND p.pname = regexp_extract(e.name, '^(.*)\\.[^.]*$', 1)""")
def j8_parent(spark, d):
    name = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat("source", F.lit(".m"), (F.col("doc_id") % 7).cast("string")))
    e = table(spark, d, "documents").select(F.col("lang").alias("file_id"), F.col("doc_id").alias("element_id"), F.col("doc_id").alias("element_no"), name.alias("name"))
    return relate.parents(e).select("element_id", "parent_id")


@query("j9_anti_dedupe", f"WITH k AS (SELECT doc_id FROM documents WHERE {FOLD.format('text')} LIKE '%the of%') SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM k)")
def j9_anti_dedupe(spark, d):
    k = table(spark, d, "documents").where(X.like("text", "the of")).select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(k, "vec_id", "left_anti").select("vec_id")


@query("j10_m3_insert_if_absent", "WITH s AS (SELECT source, sha256(text) AS h FROM documents WHERE doc_id < 500), n AS (SELECT source, sha256(text) AS h FROM documents) SELECT DISTINCT source, h AS content_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = n.source AND s.h = n.h)")
def j10_m3_insert_if_absent(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", X.content_hash("text").alias("content_hash"))
    stored = rows.where("doc_id < 500")  # the half that a first run indexed
    return store.fresh_only(rows.drop("doc_id"), stored, ["source", "content_hash"])


@query("j11_used_names", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: w IN ('the', 'ing', 'with')))), ', ') AS used FROM documents""")
def j11_used_names(spark, d):
    return table(spark, d, "documents").select("doc_id", relate.used_names(F.col("text"), ["the", "ing", "with"]).alias("used"))


@query("j12_tag_pairs", r"""WITH t0 AS (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z0-9\-]+') AS ts FROM pages), t AS (SELECT page_id, unnest(ts) AS raw, unnest(range(len(ts)))::INT AS pos FROM t0),
u AS (SELECT page_id, pos, lower(replace(replace(raw, '<', ''), '/', '')) AS tag, starts_with(raw, '</') AS c FROM t),
v AS (SELECT *, sum(CASE WHEN c THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + c::INT AS depth FROM u),
w AS (SELECT *, last_value(CASE WHEN NOT c THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id, tag, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_pos FROM v)
SELECT page_id, tag, open_pos, pos AS close_pos FROM w WHERE c AND depth > 0 AND open_pos IS NOT NULL""")
def j12_tag_pairs(spark, d):
    t = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"</?[a-zA-Z0-9\-]+"), F.lit(0))).alias("pos", "raw"))
    t = t.select("page_id", "pos", F.lower(F.regexp_replace("raw", "[</]", "")).alias("tag"), F.col("raw").startswith("</").alias("is_close"))
    return relate.paired_tags(t, "page_id")


@query("a1_totals", "SELECT 'total_blocks' AS metric, '' AS key, (SELECT count(*) FROM conversations) AS value UNION ALL SELECT 'total_elements', '', (SELECT count(*) FROM pages) UNION ALL SELECT 'total_embeddings', '', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'total_files', '', (SELECT count(*) FROM documents)")
def a1_totals(spark, d):
    t = lambda n: table(spark, d, n)
    f = t("documents").select(*(F.lit(None).cast("string").alias(c) for c in ("language", "framework", "repo_name")))
    return store.stats(f, t("conversations"), t("pages"), t("embeddings"))


@query("a2_m8_distributions", "SELECT CASE WHEN grouping(lang) = 0 THEN 'language' ELSE 'repo_name' END AS metric, coalesce(lang, source) AS key, count(*) AS value FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def a2_m8_distributions(spark, d):
    return store.distributions(S.files(spark, d), ("language", "repo_name"))


@query("a2_grouping_sets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def a2_grouping_sets(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("documents_for_sets")
    return spark.sql("SELECT lang, source, count(*) AS n FROM documents_for_sets GROUP BY GROUPING SETS ((lang), (source), ())")


@query("a3_type_counts", r"WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z0-9\-]+)', 1))) AS tag FROM pages), c AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL) SELECT page_id, string_agg(tag || '=' || n, ',' ORDER BY tag) AS counts FROM c GROUP BY 1")
def a3_type_counts(spark, d):
    from ..operators.detect import tag_counts

    t = table(spark, d, "pages").select("page_id", F.explode(tag_counts("html")).alias("element_type"))
    m = relate.type_counts(t, "page_id")
    return m.select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries("element_type_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("a4_grouped_names", f"WITH {S.LINES}, {S.ELEMENTS} SELECT doc_id, element_type, string_agg(name, '|' ORDER BY name) AS names FROM elements GROUP BY ALL")
def a4_grouped_names(spark, d):
    return relate.grouped(S.elements(S.lines(spark, d)), "doc_id").select("doc_id", "element_type", F.array_join("names", "|").alias("names"))


@query("a7_summary", "SELECT count(*) AS total, sum(n_chars)::BIGINT AS chars, count_if(n_chars > 2000)::BIGINT AS large FROM documents")
def a7_summary(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("total"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 2000).alias("large"))


@query("m6_delete", "SELECT d.doc_id FROM documents d WHERE source <> 'src4' AND lang <> 'de'")
def m6_delete(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(docs.where("source = 'src4' or lang = 'de'").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("m9_file_info", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def m9_file_info(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("x1_zero_safe_cosine", "SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x1_zero_safe_cosine(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("o1_file_search", f"WITH p AS (SELECT DISTINCT {S.PATH.replace('regexp_replace(regexp_replace(url', 'regexp_replace(regexp_replace(url')} AS path FROM pages) SELECT path AS file_path, contains({FOLD.format('path')}, '7.html') AS contained, levenshtein({FOLD.format('string_split(path, chr(47))[-1]')}, '7.html')::INT AS edits FROM p ORDER BY contained DESC, edits, file_path LIMIT 10")
def o1_file_search(spark, d):
    return search.file_search(S.paths(spark, d).select(F.col("path").alias("file_path")).distinct(), "7.html")


@query("o4_weighted", f"""WITH l AS (SELECT doc_id AS block_id, quality::DOUBLE AS score FROM labels), v AS (SELECT e.vec_id AS block_id, 1 - {COSINE} AS score FROM embeddings e)
SELECT block_id, round((coalesce(l.score, 0) + 0.04 * coalesce(v.score, 0.04)) / 1.04, 6) AS score FROM l FULL JOIN v USING (block_id) ORDER BY (coalesce(l.score, 0) + 0.04 * coalesce(v.score, 0.04)) / 1.04 DESC, block_id LIMIT 20""")
def o4_weighted(spark, d):
    lex = table(spark, d, "labels").select(F.col("doc_id").alias("block_id"), F.col("quality").cast("double").alias("score"))
    vec = S.embeddings(spark, d).select("block_id", (1 - V.distance(F.col("embedding"), V.query_vector(S.first_vector(spark, d)))).alias("score"))
    return search.weighted(lex, vec, k=20).select("block_id", F.round("score", 6).alias("score"))


@query("o5_percentile", "SELECT doc_id, round(percent_rank() OVER (ORDER BY least(n_chars / 20, 10.0) * (doc_id % 7 + 1) / (doc_id % 11 + 1)), 6) AS percentile FROM documents")
def o5_percentile(spark, d):
    s = table(spark, d, "documents").select("doc_id", rank.quality_bonus(F.col("n_chars"), F.col("doc_id") % 7, F.col("doc_id") % 11).alias("s"))
    return rank.with_percentile(s, "s").select("doc_id", F.round("percentile", 6).alias("percentile"))


@query("o6_rerank", f"WITH h AS (SELECT e.vec_id AS block_id, row_number() OVER (ORDER BY {COSINE}, e.vec_id) AS place FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) SELECT h.block_id, h.place::INT AS place, d.n_chars::DOUBLE AS rerank FROM h JOIN documents d ON d.doc_id = h.block_id WHERE place <= 50 ORDER BY rerank DESC, place LIMIT 5")
def o6_rerank(spark, d):
    c = search.filtered(S.blocks(spark, d), S.files(spark, d), search.Filters())
    hits = search.ranked(search.vector_topk(c, S.embeddings(spark, d), S.first_vector(spark, d), 50), 1, F.col("distance"), F.col("block_id"))
    return search.reranked(hits, F.length("content").cast("double")).select("block_id", "place", "rerank")


@query("o7_embedding_cache", "WITH c AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE doc_id % 3 = 0) SELECT (SELECT count(*) FROM documents WHERE sha256(text) IN (SELECT k FROM c)) AS hits, (SELECT count(DISTINCT sha256(text)) FROM documents WHERE sha256(text) NOT IN (SELECT k FROM c)) AS misses")
def o7_embedding_cache(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = docs.where("id % 3 = 0").select(X.content_hash("text").alias("key")).distinct().withColumn("version", F.lit("v1")).withColumn("embedding", F.array(F.lit(0.0)))  # what an earlier run embedded
    hits, misses = store.embedding_cache(docs, cache, "v1")
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))


@query("o8_low_value", f"SELECT page_id FROM pages WHERE NOT ({S.PATH} LIKE '%.map' OR {S.PATH} LIKE '%.svg')")
def o8_low_value(spark, d):
    return S.paths(spark, d).where(~rank.is_low_value("path")).select("page_id")


@query("o9_corpus_map")
def o9_corpus_map(spark, d):
    """Pages as files: a page defines its path's words and refers to the paths that its links name."""
    p = S.paths(spark, d)
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z]{4,}"), F.lit(0))))
    defs = p.select("path", words("path").alias("name")).distinct()
    refs = p.select("path", words(F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " ")).alias("name"))
    return rank.corpus_map(defs, rank.reference_rank(defs, refs, 5)).select("path", "name", F.round("rank", 9).alias("rank"))
