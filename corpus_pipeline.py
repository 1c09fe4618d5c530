"""The corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again; all but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, packing, pii, quality, toxicity
from lodestone.llm.common import cut, table

#: A document goes when it is likelier toxic than not; the query's 0.3 is for finding, this is for rejecting.
TOXIC = 0.5


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but the needed ones renamed, so that nothing an operator adds can clash."""
    return docs.toDF(*(c if c in needed else f"col{i}_{c}" for i, c in enumerate(docs.columns)))


def _back(out: DataFrame, renamed: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(f"`{c}`") for c in renamed.columns)).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are judged by features of zero, null sources and languages are
    sites of their own, repeated rows are judged alike; an empty table stays empty."""
    own = _apart(docs, "doc_id", "text", "source", "lang")
    return _back(quality.classify(own, table(spark, sf_dir, "labels"), carry=True).where("keep"), own, docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC. Null and empty texts score the leak and stay; null ids and repeated rows are scored like others."""
    own = _apart(docs, "doc_id", "text")
    model = toxicity.fit(own, table(spark, sf_dir, "labels"))
    return _back(toxicity.score(own, model, carry=True).where(F.col("score") < TOXIC), own, docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id stays. An id is one document, however many rows and texts it has: its
    texts link whatever they are similar to, and of its rows the one with the smallest text stays, nulls first. Documents without
    words or without doc_id link with nothing and stay (rows of a null id all of them)."""
    info, _, labels = jaccard_join.join(docs.select("doc_id", "text"))
    found = info.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    gone = found.where(F.coalesce("component", "rep") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    first = Window.partitionBy("doc_id").orderBy("text")
    once = kept.where("doc_id is not null").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return once.unionByName(kept.where("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars following. Null and empty texts and texts without spans stay as they are."""
    own = _apart(docs, "doc_id", "text", "n_chars")
    return _back(pii.redact(own), own, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents. A null or empty text has the closing id alone; repeated rows and ids have pieces of their own."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicates_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Trained models and a tokenizer decide; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
