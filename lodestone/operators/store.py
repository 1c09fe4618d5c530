"""The corpus store: six Parquet tables under one folder, with idempotent indexing, versions, deletes and statistics.

Tables are appended to, partitioned by repository where rows know it; a delete rewrites what it must by anti-join into a new snapshot folder and moves the
pointer. Ids are hashes of what identifies a row (repository, path, content; then place), so they need no counter, and indexing a file again adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from . import chunks, detect, relate

SCHEMAS = {
    "code_files": "id long, repo_name string, file_path string, content_hash string, language string, framework string, structure_json string, element_count int, latest_commit string, summary_json string, indexed_at timestamp",
    "code_blocks": "id long, file_id long, chunk_type string, start_line int, end_line int, content string, non_whitespace_len int, quality_score double, framework string, special_patterns array<string>, metadata map<string,string>",
    "semantic_elements": "id long, file_id long, element_type string, name string, start_line int, end_line int, parent_element_id long, associated_block_ids array<long>, metadata map<string,string>",
    "special_patterns": "id long, code_block_id long, pattern_type string, pattern_line int",
    "file_versions": "id long, file_id long, git_commit string, commit_timestamp timestamp, is_deleted boolean",
    "embeddings": "code_block_id long, embedding array<float>, embedding_model string",
}


class Store:
    """root: a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, dim: int = 1024):
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim

    # -- tables

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self, name: str) -> str:
        p, fs = self._hadoop(f"{self.root}/{name}")
        if not fs.exists(p):
            raise FileNotFoundError(f"{self.root}/{name}: call init() first")
        return max(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def init(self) -> None:
        """Creates tables that aren't there; others stay."""
        for name, schema in SCHEMAS.items():
            p, fs = self._hadoop(f"{self.root}/{name}")
            if not fs.exists(p):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.root}/{name}/v000000")

    def table(self, name: str) -> DataFrame:
        """With all columns of the schema: files written before a column was added give nulls for it."""
        schema = T.StructType.fromDDL(SCHEMAS[name]) if hasattr(T.StructType, "fromDDL") else self.spark.createDataFrame([], SCHEMAS[name]).schema
        return self.spark.read.schema(schema).parquet(self._current(name))

    def append(self, name: str, rows: DataFrame) -> None:
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        have = set(rows.columns)
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds)).write.mode("append").parquet(self._current(name))

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """A new snapshot beside the old one, which readers that began before keep."""
        old = self._current(name)
        n = int(old.rsplit("v", 1)[-1]) + 1
        staged = f"{self.root}/{name}/.{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        src, fs = self._hadoop(staged)
        fs.rename(src, self._hadoop(f"{self.root}/{name}/v{n:06d}")[0])

    # -- indexing

    def index(self, files: DataFrame, repo_name: str | None = None, commit: str | None = None, model: str = "fallback", embed=None, filter_blank: bool = True) -> dict[str, int]:
        """Indexes files (path, text; repo_name unless given; error): returns counts. Files already stored with the same content aren't stored again; other contents are new versions."""
        repo = F.lit(repo_name) if repo_name is not None else F.col("repo_name")
        bad = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
        f = files.where(~bad & F.col("text").isNotNull()).select(repo.alias("repo_name"), F.col("path").alias("file_path"), "text").withColumn("content_hash", X.content_hash("text"))
        f = f.withColumn("id", F.xxhash64("repo_name", "file_path", "content_hash")).dropDuplicates(["id"])
        fresh = f.join(self.table("code_files").select("id"), "id", "left_anti").persist()
        src = fresh.select(F.col("id").alias("file_id"), F.col("file_path").alias("path"), "text")
        found = detect.elements(src).withColumn("element_id", F.xxhash64("file_id", "element_no", "name", "start_line")).dropDuplicates(["element_id"]).persist()
        blocks = chunks.described(chunks.chunked(src)).withColumn("id", F.xxhash64("file_id", "chunk_id"))
        blocks = (blocks.where(F.trim("content") != "") if filter_blank else blocks).persist()
        counts = found.groupBy("file_id").agg(F.count("*").cast("int").alias("element_count"))
        kinds = relate.type_counts(found)
        lang, framework = X.language_of("file_path"), X.framework_of_file("text")
        rows = fresh.join(counts, fresh.id == counts.file_id, "left").drop("file_id").join(kinds, fresh.id == kinds.file_id, "left").drop("file_id")
        lines = F.size(X.lines("text"))
        total = files.agg(F.count("*").alias("n"), F.count_if(bad | F.col("text").isNull()).alias("failed")).first()
        out = {"total_files": total.n, "failed_files": total.failed, "indexed_files": fresh.count(), "blocks": blocks.count(), "elements": found.count()}
        self.append("code_blocks", blocks.withColumn("metadata", F.create_map(F.lit("title"), F.col("title"))))
        self.append("special_patterns", blocks.select(F.col("id").alias("code_block_id"), F.explode("special_patterns").alias("pattern_type")).withColumn("id", F.xxhash64("code_block_id", "pattern_type")))
        text = X.with_context(X.prepare("content"), F.col("language"), F.col("framework"), F.col("chunk_type"))
        vector = embed(text) if embed else V.fallback_embedding(text, self.dim)
        self.append("embeddings", blocks.select(F.col("id").alias("code_block_id"), vector.alias("embedding"), F.lit(model).alias("embedding_model")).where(F.size("embedding") == self.dim))
        linked = relate.parents(found)
        of = relate.assigned(blocks.select("file_id", F.col("id").alias("chunk_id"), "start_line", "end_line"), found).groupBy("element_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("associated_block_ids"))
        linked = linked.join(of, "element_id", "left")
        self.append("semantic_elements", linked.select(F.col("element_id").alias("id"), "file_id", "element_type", "name", "start_line", "end_line", F.col("parent_id").alias("parent_element_id"), "associated_block_ids", F.create_map(F.lit("kind"), F.col("kind")).alias("metadata")))
        self.append("file_versions", fresh.select(F.xxhash64("id", F.lit(commit or "")).alias("id"), F.col("id").alias("file_id"), F.lit(commit).alias("git_commit"), F.current_timestamp().alias("commit_timestamp"), F.lit(False).alias("is_deleted")))
        # last, as a file counts as stored once its row is there; writing it also voids what is cached from that table
        self.append("code_files", rows.select(
            "id", "repo_name", "file_path", "content_hash", lang.alias("language"), framework.alias("framework"), F.to_json(F.struct("element_type_counts")).alias("structure_json"), F.coalesce("element_count", F.lit(0)).alias("element_count"),
            F.lit(commit).alias("latest_commit"), F.to_json(F.struct(lang.alias("language"), lines.alias("total_lines"), F.coalesce("element_count", F.lit(0)).alias("total_elements"))).alias("summary_json"), F.current_timestamp().alias("indexed_at"),
        ))
        for df in (fresh, found, blocks):
            df.unpersist()
        return out

    # -- deleting

    def repair(self) -> None:
        """Removes rows without a file, which an interrupted index() leaves."""
        files = self.table("code_files").select(F.col("id").alias("file_id"))
        for name in ("code_blocks", "semantic_elements", "file_versions"):
            self.rewrite(name, self.table(name).join(files, "file_id", "left_semi").select(*self._columns(name)))
        blocks = self.table("code_blocks").select(F.col("id").alias("code_block_id"))
        for name in ("embeddings", "special_patterns"):
            self.rewrite(name, self.table(name).join(blocks, "code_block_id", "left_semi").select(*self._columns(name)))

    @staticmethod
    def _columns(name: str) -> list[str]:
        return [c.split()[0] for c in SCHEMAS[name].split(", ")]

    def _delete(self, ids: DataFrame) -> None:
        ids = ids.select(F.col("id").alias("file_id")).persist()
        blocks = self.table("code_blocks").join(ids, "file_id", "left_semi").select(F.col("id").alias("code_block_id")).persist()
        gone = {"embeddings": (blocks, "code_block_id"), "special_patterns": (blocks, "code_block_id"), "semantic_elements": (ids, "file_id"), "code_blocks": (ids, "file_id"), "file_versions": (ids, "file_id"), "code_files": (ids.withColumnRenamed("file_id", "id"), "id")}
        blocks.count()
        for name, (keys, on) in gone.items():
            self.rewrite(name, self.table(name).join(keys, on, "left_anti").select(*self._columns(name)))
        ids.unpersist(), blocks.unpersist()

    def delete_file(self, repo_name: str, file_path: str) -> bool:
        """All versions of a path and what hangs on them; a path that isn't there is a success too."""
        ids = self.table("code_files").where((F.col("repo_name") == repo_name) & (F.col("file_path") == file_path))
        if ids.limit(1).count():
            self._delete(ids)
        return True

    def delete_repository(self, repo_name: str) -> bool:
        ids = self.table("code_files").where(F.col("repo_name") == repo_name)
        if ids.limit(1).count():
            self._delete(ids)
        return True

    # -- reading

    def file_info(self, file_id: int) -> DataFrame:
        summary = "language string, total_lines int, total_elements int"
        return self.table("code_files").where(F.col("id") == file_id).withColumn("summary", F.from_json("summary_json", summary))

    def versions(self, file_path: str) -> DataFrame:
        f = self.table("code_files").where(F.col("file_path") == file_path).select(F.col("id").alias("file_id"), "content_hash")
        return self.table("file_versions").join(f, "file_id")

    def stats(self) -> DataFrame:
        return stats(self.table("code_files"), self.table("code_blocks"), self.table("semantic_elements"), self.table("embeddings"))

    def search_tables(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(files, blocks, elements, embeddings) as operators.search takes them."""
        return (
            self.table("code_files").withColumnRenamed("id", "file_id").select("file_id", "repo_name", "file_path", "language", "framework"),
            self.table("code_blocks").withColumnRenamed("id", "block_id"),
            self.table("semantic_elements").withColumnRenamed("id", "element_id"),
            self.table("embeddings").withColumnRenamed("code_block_id", "block_id"),
        )


def stats(files: DataFrame, blocks: DataFrame, elements: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(metric, key, value): totals, then files by language, framework and repository, these in one pass by grouping sets."""
    totals = None
    for name, df in (("total_files", files), ("total_blocks", blocks), ("total_elements", elements), ("total_embeddings", embeddings)):
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")
        totals = row if totals is None else totals.union(row)
    return totals.union(distributions(files))


def distributions(files: DataFrame, columns: tuple[str, ...] = ("language", "framework", "repo_name")) -> DataFrame:
    """(metric, key, value): rows by each column, nulls left out; one Expand and one aggregation for all columns."""
    pairs = files.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("key")) for c in columns))).alias("p")).select("p.*")
    return pairs.where("key is not null").groupBy("metric", "key").agg(F.count("*").alias("value"))


def fresh_only(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that aren't stored yet, once each."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def embedding_cache(texts: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits with vectors, misses) of texts (id, text) against cache (key, version, embedding), keyed by the text's hash and the model's version."""
    keyed = texts.withColumn("key", X.content_hash("text"))
    own = cache.where(F.col("version") == version).select("key", "embedding")
    return keyed.join(own, "key"), keyed.join(own, "key", "left_anti").dropDuplicates(["key"])
