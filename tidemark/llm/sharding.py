"""Contiguous shards of near equal byte size, cut from one global prefix sum."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import land


def byte_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Assign every row to one of ``shards`` contiguous ranges of the order by ``key`` whose byte sizes are near equal.

    Returns the key column, ``size`` (UTF-8 bytes of the text plus ``overhead``), ``text_crc32``, ``shard`` and ``slot``
    (gapless from 0 within the shard).  A row belongs to the shard its middle byte falls into, so a shard's size is off
    its target by less than one row.

    The rows are range-partitioned by key and written with only key, size and checksum; the totals of the partitions
    (one row each) give every partition its offset, and the running sums inside a partition complete the prefix sum.
    The cut into range partitions decides nothing: any cut gives the same prefix sums.

    A null text has no bytes and the checksum of none (0).  A null key sorts first.  Rows with the same key follow each
    other by size and checksum, and full repeats are interchangeable.  An empty table gives no rows.  When one row is
    larger than a target, shards it covers stay empty.  Extra columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), (F.octet_length(body).cast("long") + F.lit(overhead)).alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    order = ["_key", "size", "text_crc32"]
    parts = land(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-parts")

    totals = parts.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("base_size"),
                            F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("base_rows"), F.sum("part_size").over(whole).alias("all_size"))

    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select("*", (F.sum("size").over(run) - F.col("size")).alias("in_size"), (F.count(F.lit(1)).over(run) - 1).alias("in_rows")).join(offsets, "part")
    twice = 2 * (F.col("base_size") + F.col("in_size")) + F.col("size")
    shard = F.least(F.lit(shards - 1), F.expr(f"CAST({shards} AS DECIMAL(38,0)) * twice div (CAST(2 AS DECIMAL(38,0)) * all_size)")).cast("int")
    placed = land(placed.withColumn("twice", twice).withColumn("shard", shard)
                  .select("_key", "size", "text_crc32", "shard", (F.col("base_rows") + F.col("in_rows")).alias("at")), "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # at most one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
