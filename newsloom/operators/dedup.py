"""Keep-first deduplication and insert-only merging by article id.

"First" follows an explicit order column (or struct), so results do not depend on partitioning: the least
value comes first, NULL last. Of rows that tie, the one comes first that is least column by column, NULL before
all values; there is always one row per id. An id that is NULL or 0 counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.session import stored


def has_id(id_column: str = "id") -> Column:
    return F.coalesce(F.col(id_column), F.lit(0)) != 0


def _repeated(df: DataFrame, order: str, id_column: str) -> DataFrame:
    """(id, first order value) of the ids that several rows have.

    Only these two columns are read and only counts per id are shuffled, so an id holding
    most rows costs its reducer one row per task. The result is stored: its size is then known, and
    while repeats are few the rows of ``df`` need not be shuffled at all.
    """
    groups = df.select(F.col(id_column).alias("__id"), F.col(order).alias("__at")).groupBy("__id")
    counted = groups.agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    return stored(counted.where("__n > 1").select("__id", "__first"), "repeated-ids")


def _least(df: DataFrame) -> Column:
    """The row, whole, that is least column by column; maps have no order and are not compared."""
    ordered = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.min_by(F.struct(*df.columns), F.struct(*ordered))


def _first_rows(df: DataFrame, order: str, id_column: str, repeated: DataFrame) -> DataFrame:
    """Rows of ids that are not ``repeated``, and the first row of each that is.

    The joins keep rows of ``df``, the side that AQE splits at a hot id. Only where several rows of an id carry its first order value, which
    two narrow columns tell, are these rows reduced to the least, before they are shuffled.
    """
    if repeated.isEmpty():
        return df
    same, at_first = F.col(id_column).eqNullSafe(F.col("__id")), F.col(order).eqNullSafe(F.col("__first"))
    candidates = df.select(id_column, order).join(repeated, same & at_first, "left_semi").groupBy(F.col(id_column).alias("__tied"))
    tied = stored(candidates.count().where("count > 1").select("__tied"), "tied-ids")
    marked = repeated.withColumn("__several", F.lit(True))
    first = df.join(marked, same, "left").filter(F.col("__several").isNull() | at_first).select(*df.columns)
    if tied.isEmpty():
        return first
    among = F.col(id_column).eqNullSafe(F.col("__tied"))
    tying = first.join(tied, among, "left_semi").groupBy(F.col(id_column).alias("__of")).agg(_least(df).alias("__row"))
    return first.join(tied, among, "left_anti").unionByName(tying.select("__row.*"))


def first_per_id(df: DataFrame, order: str, id_column: str = "id") -> DataFrame:
    """First row of each id; rows without an id form one group.

    ``df`` is read more than once, at first for two of its columns; store it if it is dear to compute.
    """
    return _first_rows(df, order, id_column, _repeated(df, order, id_column))


def dedupe_keep_first(df: DataFrame, order: str, id_column: str = "id") -> DataFrame:
    """First row of each id, and every row without an id."""
    return _first_rows(df, order, id_column, _repeated(df.filter(has_id(id_column)), order, id_column))


def dedupe_metrics(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Row counts before and after ``dedupe_keep_first``, in one row."""
    per_id = (
        df.groupBy(F.coalesce(F.col(id_column), F.lit(0)).alias("__id"))
        .agg(F.count("*").alias("n"))
        .withColumn("kept", F.when(F.col("__id") != 0, F.lit(1)).otherwise(F.col("n")))
    )
    return per_id.agg(
        F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("cleaned"),
    )


def new_rows(existing: DataFrame, batch: DataFrame, order: str, id_column: str = "id") -> DataFrame:
    """Rows of ``batch`` that an insert-only merge would add to ``existing``.

    Only ids are read from ``existing``, and known ones leave the batch before its first rows are looked for.
    """
    fresh = skip_processed(batch.filter(has_id(id_column)), existing.filter(has_id(id_column)), id_column)
    return first_per_id(fresh, order, id_column)


def merge_new(existing: DataFrame, batch: DataFrame, order: str, id_column: str = "id") -> DataFrame:
    """``existing`` as it is, plus the first row of each new id in ``batch``."""
    fresh = new_rows(existing, batch, order, id_column)
    return existing.unionByName(fresh.select(*existing.columns))


def merge_metrics(existing: DataFrame, batch: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows saved, skipped and in total after ``merge_new``, in one row.

    Works on counts per id, so the payload is never read.
    """
    sides = existing.select(F.col(id_column), F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        batch.select(F.col(id_column), F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    per_id = (
        sides.groupBy(F.coalesce(F.col(id_column), F.lit(0)).alias("__id"))
        .agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
        .withColumn(
            "saved",
            F.when((F.col("__id") != 0) & (F.col("old") == 0) & (F.col("new") > 0), 1).otherwise(0),
        )
    )
    return per_id.agg(
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
        F.coalesce(F.sum(F.col("new") - F.col("saved")), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.col("old") + F.col("saved")), F.lit(0)).alias("total"),
    )


def skip_processed(df: DataFrame, processed: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose id has not been handled yet.

    The distinct ids are stored first. Their size is then known, and if it is
    small the rows of ``df``, which may be whole pages, are not shuffled. If it
    is not, AQE can split a hot id of ``df``, which it does only where no
    aggregation sits between the shuffle and the join.
    """
    done = stored(processed.select(id_column).distinct(), "processed")
    return df.join(done, id_column, "left_anti").select(*df.columns)
