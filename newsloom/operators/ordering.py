"""Running totals and positions over tables too long for one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.session import stored

# Positions that agree in all but this many low bits share a window partition.
BUCKET_BITS = 20


def number_rows(rows: DataFrame, order_by: Sequence[str | Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with gapless numbers from 0 in an order, and how many there are.

    Rows are dealt by ranges, sorted and numbered within each, and written once: the ranges come from a
    sample, so they must not be computed twice. The sizes of the ranges, one number
    each, reach the driver. Ties are spread over several ranges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = source.repartitionByRange(parts, *order_by, "__tie").sortWithinPartitions(*order_by, "__tie").drop("__tie")
    first = F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    place = (F.monotonically_increasing_id() - first).alias("__place")
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("__range"), place), "numbered")
    starts, total = [], 0
    for row in dealt.groupBy("__range").count().orderBy("__range").collect():
        starts.append((row["__range"], total))
        total += row["count"]
    # One row per range, hence safe to broadcast; the planner cannot know.
    offsets = F.broadcast(spark.createDataFrame(starts, "__range int, __start bigint"))
    numbered = dealt.join(offsets, "__range").withColumn(name, F.col("__start") + F.col("__place"))
    return numbered.drop("__range", "__place", "__start"), total


def running_total(
    df: DataFrame, value: Column, bucket: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """Add the running sum of ``value`` in the order (bucket, order), ascending.

    The window sorts inside each bucket only; the buckets' totals, one row
    each, are the only thing summed in a single task. ``bucket`` columns must
    be non-null and ascend with the wanted order.
    """
    inside = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*bucket)
        .agg(F.sum(value).alias("__total"))
        .select(*bucket, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    )
    return (
        df.withColumn("__inside", F.sum(value).over(inside))
        .join(offsets, list(bucket))
        .withColumn(name, F.col("__inside") + F.col("__offset"))
        .drop("__inside", "__offset")
    )


def running_total_by(
    df: DataFrame, value: Column, position: str, name: str, bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """``running_total`` along a unique whole-number position column."""
    bucketed = df.withColumn("__bucket", F.shiftright(position, bucket_bits))
    return running_total(bucketed, value, ["__bucket"], [position], name).drop("__bucket")
