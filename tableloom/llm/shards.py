"""Balanced contiguous shards from global prefix sums of byte sizes; DataFrame functions only.

Rows are put in order by ranges, so that every partition holds a run of the order. Totals per partition give the
bytes and rows before it, a running sum within the partition gives the rest, and equal targets cut the whole. No
step sees more than one run of rows or one row per partition, and copies of one text, which are neighbours in the
order, are spread over as many partitions as they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tableloom.llm.common import col
from tableloom.session import cut_lineage

# Bytes that a row takes besides its text.
ROW_BYTES = 8


def text_size(text: Column, row_bytes: int = ROW_BYTES) -> Column:
    """UTF-8 bytes of a text and what its row takes besides; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + row_bytes


def assign_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous runs of the order (md5 of the text, id) with equal bytes.

    A row goes to the shard in which the middle of its bytes lies, so shards differ from the target by less than
    the largest row. Equal texts are neighbours and share a shard unless a cut falls among them. Slots count from 0
    without gaps. Null and empty texts weigh `ROW_BYTES`; null texts come first, as do null ids; repeated rows are
    kept. Other columns are not looked at. An empty table gives none, and shards without rows do not show.
    """
    if n_shards < 1:
        raise ValueError("at least one shard")
    text = col(text_col)
    rows = df.select(
        col(id_col).alias("id"), text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_key"),
    ).withColumn("tie", F.monotonically_increasing_id())
    order = ["text_key", "id", "tie"]
    runs = cut_lineage(rows.repartitionByRange(*order).withColumn("run", F.spark_partition_id()))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("run").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).select(
        "run", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("run").orderBy(*order)
    placed = (
        runs.withColumn("bytes_to", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(own)).join(offsets, "run")
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(
            f"((2 * (bytes_before + bytes_to) - size) * {n_shards}L) div (2 * total)")).cast("int"))
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
        .select("id", "size", "text_crc32", "shard", "at"))
    placed = cut_lineage(placed)
    # One row per shard.
    first = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("first")))
    return placed.join(first, "shard").select("id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of `df`, whose ids are unique, as Parquet folders `shard=K`, sorted by slot."""
    where = shards.select(F.col("id").alias("__id"), "shard", "slot")
    joined = df.join(where, df[id_col].eqNullSafe(where["__id"])).drop("__id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
