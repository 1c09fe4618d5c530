"""The driver's tables in the shapes that the operators take, and the SQL for the same shapes.

documents stand for files and, whole, for blocks (quality from labels); embeddings belong to the document with their id; pages give paths and
markup; lines of documents that end in certain words stand for elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table

PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
#: DuckDB: lines(doc_id, pos, line) of documents; single quotes in the class are plain characters.
LINES = r"""l0 AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents),
l1 AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM l0),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS pos FROM l1)"""
ELEMENTS = "elements AS (SELECT doc_id * 100000 + pos AS element_id, doc_id, CASE WHEN line LIKE '%ing.' THEN 'function' ELSE 'class' END AS element_type, line[1:12] AS name, pos AS start_line, pos + length(line) % 4 AS end_line FROM lines WHERE line LIKE '%ing.' OR line LIKE '%er.')"
BLOCKS = "blocks AS (SELECT doc_id * 100000 + pos // 3 AS block_id, doc_id, (pos // 3 * 3)::INT AS start_line, (pos // 3 * 3 + 3)::INT AS end_line, count(*) AS n FROM lines GROUP BY ALL)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo_name"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.col("lang").alias("language"), X.framework_of_file("text").alias("framework"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality_score"))
    b = table(spark, d, "documents").join(q, "doc_id", "left")
    return b.select(F.col("doc_id").alias("block_id"), F.col("doc_id").alias("file_id"), F.lit("code").alias("chunk_type"), F.lit(0).alias("start_line"), F.size(X.lines("text")).alias("end_line"), F.col("text").alias("content"), "quality_score", F.col("source").alias("framework"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("block_id"), "embedding")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The embedding of id 0, as a query."""
    return [float(v) for v in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.lines("text")).alias("pos", "line"))


def elements(ls: DataFrame) -> DataFrame:
    e = ls.where(F.col("line").endswith("ing.") | F.col("line").endswith("er."))
    return e.select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("element_id"), "doc_id", F.when(F.col("line").endswith("ing."), "function").otherwise("class").alias("element_type"), F.substring("line", 1, 12).alias("name"),
        F.col("pos").alias("start_line"), (F.col("pos") + F.length("line") % 4).alias("end_line"), F.col("pos").alias("element_no"),
    )


def line_blocks(ls: DataFrame) -> DataFrame:
    """Blocks of three lines."""
    third = F.floor(F.col("pos") / 3).cast("int")
    return ls.groupBy("doc_id", third.alias("k")).agg(F.count("*").alias("n")).select((F.col("doc_id") * 100000 + F.col("k")).alias("block_id"), "doc_id", (F.col("k") * 3).alias("start_line"), (F.col("k") * 3 + 3).alias("end_line"), "n")


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(PATH).alias("path"), "html")
