"""Sets of ids as bitmaps: a row of 4 KB for each 32,768 consecutive ids, of which at least one is in the set.

A dense set takes one bit per id, a hundredth of a list of ids, and its size depends on the span of ids, not on how often they were
added. Sets are merged by OR, so tables of parts (an epoch's ids, say) need no order and may overlap. Parquet
compresses rows with few bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.dedup import first_per_id, has_id
from newsloom.operators.scan import id_bounds
from newsloom.session import stored

BITMAP = "bucket bigint, bits binary"


def id_bitmaps(ids: DataFrame, id_column: str = "id") -> DataFrame:
    """(bucket, bits) of the ids that are there; NULL is none. Bits are set before the shuffle, so a hot id costs a bit."""
    value = F.col(id_column)
    grouped = ids.where(value.isNotNull()).groupBy(F.bitmap_bucket_number(value).alias("bucket"))
    return grouped.agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))


def merged_bitmaps(parts: DataFrame) -> DataFrame:
    """One row per bucket."""
    return parts.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_size(bitmaps: DataFrame) -> DataFrame:
    """Ids in a set, its rows and bytes, in one row."""
    return merged_bitmaps(bitmaps).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("ids"),
        F.count("*").alias("buckets"),
        F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bytes"),
    )


def holds(bits: Column, value: Column) -> Column:
    """Whether an id's bit is set in the bits of its bucket."""
    position = F.bitmap_bit_position(value)
    byte = F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (position % 8).cast("int")) == 1


def skip_known(df: DataFrame, bitmaps: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is not in the set; rows without an id stay.

    Only buckets between the least and the greatest id of ``df`` are read; merged and stored, their size is known, so a batch of new ids
    is joined without a shuffle. Otherwise AQE can split the rows of a bucket.
    """
    lo, hi = id_bounds(df, id_column)
    if lo is None:
        return df
    bucket = F.bitmap_bucket_number
    wanted = bitmaps.where(F.col("bucket").between(bucket(F.lit(lo)), bucket(F.lit(hi))))
    known = stored(merged_bitmaps(wanted).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")), "known-ids")
    joined = df.join(known, bucket(F.col(id_column)) == F.col("__bucket"), "left")
    return joined.where(F.col("__bits").isNull() | ~holds(F.col("__bits"), F.col(id_column))).select(*df.columns)


def merge_known(existing: DataFrame, bitmaps: DataFrame, batch: DataFrame, order: str, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """``merge_new`` by the bitmaps of ``existing``, whose own rows are only passed on; also the bitmaps of the new ids."""
    fresh = first_per_id(skip_known(batch.where(has_id(id_column)), bitmaps, id_column), order, id_column)
    fresh = stored(fresh.select(*existing.columns), "fresh")
    return existing.unionByName(fresh), id_bitmaps(fresh, id_column)
