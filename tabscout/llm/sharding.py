"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.functions.lineage import settle


def text_bytes(text: Column, overhead: int = 0) -> Column:
    """UTF-8 bytes of a text (none for null) plus a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(overhead)


def balanced_shards(df: DataFrame, order: Sequence[str], size: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    Rows stand in the order of the ``order`` columns, nulls first; a shard is a
    stretch of that order. With T bytes in all, cut k lies at k * T / shards,
    and a row belongs to the shard that holds its middle byte, so the bytes of
    a shard differ from T / shards by at most one row.

    Pass the columns to deal out and no payload: these rows are moved twice.
    They are range partitioned by ``order`` and settled, each range is summed,
    and a running sum inside a range plus the total of the ranges before it is
    the global prefix sum. The totals are one row per shuffle partition. Rows
    that tie in ``order`` stay together; add columns to ``order`` to split
    them. Null or negative sizes count as 0; an empty table gives no row;
    where all sizes are 0, every row is in shard 0.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(df.columns)
    keys = [F.col(f"row.`{n}`").asc_nulls_first() for n in order]
    # The row travels as one struct, so none of the working names can clash with its columns.
    rows = df.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
    )
    ranged = settle(rows.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "range",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(W.partitionBy()).alias("total"),
        )
    )
    inside = W.partitionBy("range").orderBy(*keys, "size")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "range")  # one row per shuffle partition
        .select(
            "row",
            (F.col("rows_before") + F.col("nth")).alias("nth"),
            F.expr(
                f"if(total > 0, least((2 * (bytes_before + upto) - size) * {int(shards)} div (2 * total), {int(shards) - 1}), 0)"
            ).cast("int").alias("shard"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        *[F.col(f"row.`{n}`").alias(n) for n in names if n not in ("shard", "slot")],
        "shard",
        (F.col("nth") - F.col("first")).cast("bigint").alias("slot"),
    )
