"""Filters, vector, keyword and hybrid top-k, and what is attached to hits.

Tables: files(file_id, repo_name, file_path, language, framework), blocks(block_id, file_id, chunk_type, start_line, end_line, content,
quality_score, framework), elements(element_id, file_id, element_type, name, start_line, end_line), embeddings(block_id, embedding).
Each search is one plan: filters below the joins, the query vector a literal, TakeOrderedAndProject for the k best; only those k are enriched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V


@dataclass(frozen=True)
class Filters:
    """None or empty means no filter. min_quality filters blocks (0: off); directories are globs over file_path."""

    repo_name: str | None = None
    language: str | None = None
    framework: str | None = None
    element_type: str | None = None
    min_quality: float = 0.0
    directories: tuple[str, ...] = ()


def glob_regex(pattern: str) -> str:
    """* is anything, also across slashes, ? one character, [...] a class."""
    import fnmatch

    return fnmatch.translate(pattern).replace("(?s:", "(?s:^").replace(r"\Z", r"\z")


def overlap(start: Column, end: Column, e_start: Column, e_end: Column) -> Column:
    """A block and an element share a line, or the element begins where the block ends: block ends are compared as if inclusive."""
    return (start <= e_end) & (end >= e_start)


def filtered(blocks: DataFrame, files: DataFrame, filters: Filters, elements: DataFrame | None = None) -> DataFrame:
    """blocks joined with their files, both reduced before the join; framework is the file's, block_framework the block's."""
    f = files
    for name in ("repo_name", "language"):
        if getattr(filters, name):
            f = f.where(F.col(name) == getattr(filters, name))
    if filters.directories:
        f = f.where(F.col("file_path").rlike("|".join(f"(?:{glob_regex(g)})" for g in filters.directories)))
    b = blocks.withColumnRenamed("framework", "block_framework")
    if filters.min_quality:
        b = b.where(F.col("quality_score") >= filters.min_quality)
    out = b.join(f, "file_id")
    if filters.framework:
        out = out.where((F.col("framework") == filters.framework) | (F.col("block_framework") == filters.framework))
    if filters.element_type and elements is not None:
        e = elements.where(F.col("element_type") == filters.element_type).select(F.col("file_id").alias("e_file"), F.col("start_line").alias("e_start"), F.col("end_line").alias("e_end"))
        out = out.join(e, (F.col("file_id") == F.col("e_file")) & overlap(F.col("start_line"), F.col("end_line"), F.col("e_start"), F.col("e_end")), "left_semi")
    return out


def vector_topk(candidates: DataFrame, embeddings: DataFrame, query: list[float], k: int = 5, kind: str = "cosine", dim: int | None = None) -> DataFrame:
    """The k nearest blocks with distance and similarity, ties by block_id; vectors of another size or norm zero have no distance and are left out."""
    if dim is not None and len(query) != dim:
        raise ValueError(f"query has {len(query)} components, the index has {dim}")
    e = embeddings.where(F.size("embedding") == len(query)).withColumn("distance", V.distance(F.col("embedding"), V.query_vector(query), kind)).where("distance is not null")
    near = candidates.select("block_id").join(e.select("block_id", "distance"), "block_id").orderBy("distance", "block_id").limit(k)
    hits = candidates.join(F.broadcast(near.distinct()), "block_id").orderBy("distance", "block_id").limit(k)  # only these k rows bring their texts
    return hits.withColumn("similarity", 1 - F.col("distance"))


def keyword_topk(candidates: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Blocks whose content has the query, best quality first, ties by block_id."""
    return candidates.where(X.like("content", query)).orderBy(F.desc_nulls_last("quality_score"), "block_id").limit(k)


def ranked(hits: DataFrame, source: int, *order: Column) -> DataFrame:
    return hits.withColumn("source", F.lit(source)).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # k rows


def hybrid_topk(keyword: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Keyword hits in their order, then vector hits that aren't among them, k in all."""
    a = ranked(keyword, 0, F.desc_nulls_last("quality_score"), F.col("block_id"))
    b = ranked(vector, 1, F.col("distance"), F.col("block_id"))
    both = a.unionByName(b, allowMissingColumns=True)
    first = Window.partitionBy("block_id").orderBy("source")
    return both.withColumn("nth", F.row_number().over(first)).where("nth = 1").orderBy("source", "place").limit(k).drop("nth")


def without_blank(hits: DataFrame) -> DataFrame:
    """Applied after the limit, so fewer than k may stay."""
    return hits.where(F.trim("content") != "")


def search(files: DataFrame, blocks: DataFrame, elements: DataFrame, embeddings: DataFrame, query: str, embed, k: int = 5, search_type: str = "vector", filters: Filters | None = None, filter_empty: bool = True) -> DataFrame:
    """keyword, hybrid, or vector (any other name too); embed(query) gives the query's vector."""
    candidates = filtered(blocks, files, filters or Filters(), elements)
    if search_type == "keyword":
        hits = keyword_topk(candidates, query, k)
    elif search_type == "hybrid":
        hits = hybrid_topk(keyword_topk(candidates, query, k), vector_topk(candidates, embeddings, embed(query), k), k)
    else:
        hits = vector_topk(candidates, embeddings, embed(query), k)
    hits = without_blank(hits) if filter_empty else hits
    return hits.withColumn("filename", X.base_name("file_path")).withColumn("relative_path", F.col("file_path"))


def with_elements(hits: DataFrame, elements: DataFrame, most: int | None = None) -> DataFrame:
    """Adds semantic_elements: the overlapping elements by start line and id, the first `most` of them."""
    e = elements.select("file_id", F.struct(F.col("start_line").alias("start"), "element_id", "element_type", "name", F.col("end_line").alias("end")).alias("e"))
    h = hits.select("block_id", "file_id", "start_line", "end_line")
    found = h.join(e, (h.file_id == e.file_id) & overlap(h.start_line, h.end_line, F.col("e.start"), F.col("e.end")))
    lists = found.groupBy("block_id").agg(F.array_sort(F.collect_list("e")).alias("semantic_elements"))
    out = hits.join(lists, "block_id", "left").withColumn("semantic_elements", F.coalesce("semantic_elements", F.array().cast(lists.schema["semantic_elements"].dataType)))
    return out.withColumn("semantic_elements", F.slice("semantic_elements", 1, most)) if most else out


def preview(text: Column | str, context_lines: int = 10, first: int = 60) -> tuple[Column, Column]:
    """(the first line cut short, the middle lines)."""
    ls = X.lines(text)
    begin = F.greatest(F.floor((F.size(ls) - context_lines) / 2), F.lit(0)).cast("int")
    return X.truncate(F.coalesce(F.try_element_at(ls, F.lit(1)), F.lit("")), first, first), F.array_join(F.slice(ls, begin + 1, F.lit(context_lines)), "\n")


def weighted(lexical: DataFrame, vector: DataFrame, weight: float = 0.04, k: int = 10, missing_vector: float = 0.04, missing_lexical: float = 0.0) -> DataFrame:
    """(block_id, score): (lexical + weight * vector) / (weight + 1) over the outer join of (block_id, score) tables."""
    a, b = lexical.select("block_id", F.col("score").alias("lex")), vector.select("block_id", F.col("score").alias("vec"))
    score = (F.coalesce("lex", F.lit(missing_lexical)) + weight * F.coalesce("vec", F.lit(missing_vector))) / (weight + 1)
    return a.join(b, "block_id", "full").select("block_id", score.alias("score")).orderBy(F.desc("score"), "block_id").limit(k)


def reranked(hits: DataFrame, score: Column, first: int = 50, k: int = 5) -> DataFrame:
    """Two stages: the hits of the first `first` places (column place), then the k best by `score`."""
    return hits.where(F.col("place") <= first).withColumn("rerank", score).orderBy(F.desc("rerank"), "place").limit(k)


def file_search(files: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Paths by whether they contain the query (A-Z folded), then edit distance of the file name, then path."""
    inside = F.contains(X.fold("file_path"), X.fold(F.lit(query)))
    return files.select("file_path", inside.alias("contained"), F.levenshtein(X.fold(X.base_name("file_path")), X.fold(F.lit(query))).alias("edits")).orderBy(F.desc("contained"), "edits", "file_path").limit(k)
