"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if the session is local, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: a lost executor then costs no recomputation. The driver removes it when
    it ends. codec: of Parquet, the session's if not given; zstd pays for whole texts, which lie there through all later stages."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(size: str) -> int:
    """What a size setting of Spark says: 64, 64b, 64k, 64MB, 1g, -1."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", str(size).lower())
    if not m:
        raise ValueError(f"not a size: {size}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches in which whole texts go to Python workers. Lower settings of the session stay, higher ones are replaced
    in it, since they are read only when a plan runs."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = as_bytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def id_remainder(doc_id, mod: int):
    """crc32 of the id's decimal text modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def unit_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, y) per labelled document; repeated labels count as 1 if any is, null ones are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, keep=None) -> list:
    """At most `most` labelled texts (text, y), those of the smallest hashes of doc_id; the bound is also what is broadcast."""
    known = unit_labels(labels, column)
    known = known.where(keep) if keep is not None else known
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return [(r.text or "", int(r.y)) for r in rows]
