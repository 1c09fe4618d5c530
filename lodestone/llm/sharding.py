"""Sharding by global byte-size prefix sums.

Documents get one global order, by the text's md5 and then by doc_id, so equal texts lie side by side. It is dealt into parts: prefixes of
the md5, as long as the number of rows asks for, and, where one md5 alone has more rows than a part should, that md5 apart from what
stands before and after it, dealt out further by salt. Totals by part, summed inside groups of prefixes and then over the
groups, give each part its offset; the running sum inside a part does the rest; shard = start offset * shards / total. Each shard is a contiguous
run of that order, and its bytes differ from the target by less than one document at either end. The law is `bytes`: a group
of equal texts is cut only where a target falls into it.

Defined results: null and empty texts have 16 bytes and the crc32 0; repeated rows are separate rows; ties go by doc_id, except
between salts of one md5, and rows that are alike in everything may swap slots; a null doc_id comes first; an empty
table gives no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Added to each document's bytes.
ROW_BYTES = 16
#: Rows that a part should have at most; a single md5 with more is dealt out by salt.
PART_ROWS = 20_000
#: Prefixes of the md5 are this many bits at most, and are summed in groups by their first GROUP_BITS.
MOST_BITS, GROUP_BITS = 28, 10
#: md5 values with many rows, up to which their table goes to every task (about 100 bytes each).
BROADCAST_HOT = 10_000


def with_size(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the ordering columns; texts go no further than this."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5")
    )


def parted(sized: DataFrame, part_rows: int) -> DataFrame:
    """sized as a written table with bucket (the md5's prefix), bits, sub (around the md5 values of many rows in a bucket) and salt."""
    rows = cut(sized.withColumn("place", F.monotonically_increasing_id()), "sized")
    n = rows.count()
    bits = min(max(math.ceil(math.log2(max(n / part_rows, 1))) + 1, GROUP_BITS), MOST_BITS)
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("text_md5", 1, 7), 16, 10).cast("long"), MOST_BITS - bits))
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > part_rows).select("bucket")
    hot = rows.join(large, "bucket", "left_semi").groupBy("bucket", "text_md5").agg(F.count("*").alias("n")).where(F.col("n") > part_rows)
    hot = cut(hot.select("bucket", "text_md5", F.ceil(F.col("n") / part_rows).cast("int").alias("salts")), "hot")
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumn("sub", F.lit(0)).withColumn("salt", F.lit(0)).withColumn("bits", F.lit(bits))
    by_bucket = hot.groupBy("bucket").agg(F.collect_list(F.struct("text_md5", "salts")).alias("hot"))
    rows = rows.join(F.broadcast(by_bucket) if n_hot <= BROADCAST_HOT else by_bucket, "bucket", "left")
    hot = F.coalesce(F.col("hot"), F.array().cast("array<struct<text_md5:string,salts:int>>"))
    own = F.get(F.filter(hot, lambda h: h["text_md5"] == F.col("text_md5")), F.lit(0))["salts"]
    sub = 2 * F.size(F.filter(hot, lambda h: h["text_md5"] < F.col("text_md5"))) + own.isNotNull().cast("int")
    salt = F.coalesce(F.pmod(F.xxhash64("place"), own), F.lit(0)).cast("int")
    return rows.withColumn("sub", sub).withColumn("salt", salt).drop("hot").withColumn("bits", F.lit(bits))


def prefix_shards(sized: DataFrame, shards: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds shard, slot (place in the shard) and start (bytes before the row) to a table with doc_id, size and text_md5."""
    key = ["bucket", "sub", "salt"]
    rows = parted(sized, part_rows)
    totals = rows.groupBy("bits", *key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = cut(totals.select(*key, "bytes", "n", F.expr("shiftright(bucket, bits - {})".format(GROUP_BITS)).alias("group")), "totals")
    groups = totals.groupBy("group").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))  # 2 ** GROUP_BITS rows at most
    over = Window.orderBy("group")
    ahead, whole = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = lambda c: F.coalesce(c, F.lit(0))
    groups = groups.select("group", none(F.sum("bytes").over(ahead)).alias("b0"), none(F.sum("n").over(ahead)).alias("n0"), F.sum("bytes").over(whole).alias("total"))
    inner = Window.partitionBy("group").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("b1", none(F.sum("bytes").over(inner))).withColumn("n1", none(F.sum("n").over(inner))).join(F.broadcast(groups), "group")
    totals = totals.select(*key, (F.col("b0") + F.col("b1")).alias("bytes_before"), (F.col("n0") + F.col("n1")).alias("rows_before"), "total")
    inside = Window.partitionBy(*key).orderBy("text_md5", F.col("doc_id").asc_nulls_first(), "place")
    out = rows.join(totals, key).select(
        "doc_id", "size", "text_crc32", "total",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
    )
    out = cut(out.withColumn("shard", F.expr(f"cast(start * {int(shards)}L div total as int)")).drop("total"), "sharded")
    first = out.groupBy("shard").agg(F.min("place").alias("first"))
    return out.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first"))  # one row a shard


def op8_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    from .common import table

    out = prefix_shards(with_size(table(spark, sf_dir, "documents")), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
