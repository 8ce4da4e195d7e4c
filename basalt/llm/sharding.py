"""Sharding by bytes: contiguous, balanced shards from global prefix sums.

Documents are ordered by a 60-bit hash of their text and then by id, so equal texts are
neighbours. A range partitioning gives ordered parts; the parts' totals (one row per part)
give each part's offset, a running sum within the part the rest, and every document
falls to the shard that holds the middle of its byte range. The order has the id in it, so a large
group of equal texts spreads over parts, and no task holds more than a part.

A group of equal texts that a cut would split stays whole, in the shard of its own
middle, if it has at most `whole` of a shard's bytes; larger groups are cut by document.

Only ids, sizes and hashes are shuffled, never text. DataFrame operations only.

Nulls, empties, ties: a null text counts as empty, with size 1; null ids sort first; rows equal in
text and id are interchangeable. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._common import written


def shard_by_bytes(docs: DataFrame, shards: int = 8, whole: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless within the shard) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("bigint").alias("h"),
        ),
        "shard-sizes",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(rows.repartitionByRange(n, "h", "doc_id").withColumn("part", F.spark_partition_id()), "shard-parts")
    # One row per part: as many as shuffle partitions, whatever the input.
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("count"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("h", "doc_id", "size", "text_crc32")
    placed = parts.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "h",
        "total",
        (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("rank"),
    )
    shard_of = lambda twice_middle: F.least(F.expr(f"({twice_middle}) * {shards} div (2 * total)"), F.lit(shards - 1)).cast("int")
    placed = written(placed.withColumn("own", shard_of("2 * start + size")), "shard-places")
    # At most shards - 1 groups lie across a cut: those at both sides of one.
    edges = placed.groupBy("own").agg(F.min(F.struct("rank", "h"))["h"].alias("first"), F.max(F.struct("rank", "h"))["h"].alias("last"))
    ordered = Window.orderBy("own")
    split = edges.select(F.col("last").alias("h"), F.lead("first").over(ordered).alias("next")).filter("h = next").select("h").distinct()
    groups = (
        placed.join(F.broadcast(split), "h")
        .groupBy("h", "total")
        .agg(F.sum("size").alias("bytes"), F.min("start").alias("from"))
        .filter(F.col("bytes") * shards <= whole * F.col("total"))
        .select("h", shard_of("2 * from + bytes").alias("grouped"))
    )
    final = placed.join(F.broadcast(groups), "h", "left").withColumn("shard", F.coalesce("grouped", "own"))
    firsts = final.groupBy("shard").agg(F.min("rank").alias("first"))
    return final.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )
