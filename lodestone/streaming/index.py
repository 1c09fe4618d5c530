"""Incremental indexing: a stream of files, and running counts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store


def file_stream(spark: SparkSession, folder: str, schema: str = "repo_name string, path string, text string", per_trigger: int = 100) -> DataFrame:
    """Parquet files of (repo_name, path, text) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def index_stream(files: DataFrame, store: Store, checkpoint: str):
    """Indexes each micro-batch. Ids are hashes of content, so a batch that is run again after a failure adds nothing."""
    return files.writeStream.foreachBatch(lambda batch, _: store.index(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; later ones than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
