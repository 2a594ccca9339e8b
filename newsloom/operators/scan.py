"""Id ranges, batch plans and scan outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom.functions.text import article_id, category_or_default
from newsloom.operators.ordering import BUCKET_BITS, running_total_by
from newsloom.schema import (
    FALLBACK_EARLIEST_ID,
    FALLBACK_LATEST_ID,
)
from newsloom.session import stored

# Planned ids that one task generates, at most, before more tasks are used.
PLAN_IDS_PER_TASK = 10_000_000


def feed_ids(items: DataFrame, host: str) -> DataFrame:
    """Article id of each feed item that links to an article of ``host``."""
    return items.select(article_id(F.col("link"), host).alias("id")).filter(F.col("id") != 0)


def feed_id_range(ids: DataFrame) -> DataFrame:
    """Latest and earliest id and their number, in one row; NULLs if none."""
    return ids.agg(
        F.max("id").alias("latest_id"), F.min("id").alias("earliest_id"), F.count("id").alias("items")
    )


def with_fallback(id_range: DataFrame) -> DataFrame:
    """Use the assumed range where the feed had no article."""
    return id_range.select(
        F.coalesce("latest_id", F.lit(FALLBACK_LATEST_ID)).alias("latest_id"),
        F.coalesce("earliest_id", F.lit(FALLBACK_EARLIEST_ID)).alias("earliest_id"),
        "items",
    )


def id_bounds(df: DataFrame, id_column: str = "id") -> tuple[int | None, int | None]:
    """Smallest and largest id: one narrow aggregate, two numbers."""
    row = df.agg(F.min(id_column).alias("lo"), F.max(id_column).alias("hi")).first()
    return row.lo, row.hi


def id_range(df: DataFrame, lo: int, hi: int, id_column: str = "id") -> DataFrame:
    """Rows with an id from lo to hi; on a scan the filter reaches parquet."""
    return df.filter(F.col(id_column).between(lo, hi))


def newest_span(latest: int, span: int | None) -> tuple[int, int]:
    """Bounds of the newest ``span`` ids; None starts at id 1."""
    return (1 if span is None else max(1, latest - span + 1)), latest


def newest_n(df: DataFrame, latest: int, span: int | None, id_column: str = "id") -> DataFrame:
    """Rows in the newest ``span`` ids: a span of ids, not a number of rows."""
    return id_range(df, *newest_span(latest, span), id_column)


def newest_first(direction: str) -> bool:
    """Direction of a scan by its letter: B is oldest first, all else newest."""
    return direction.strip().upper() != "B"


def batch_plan(
    spark: SparkSession, min_id: int, max_id: int, batch_size: int, step: int = 1, reverse: bool = True
) -> DataFrame:
    """Ids to scan as (batch_no, scan_no, id), newest first unless not reverse.

    ``scan_no`` is the offset in the span. Stepping restarts at each batch.
    """
    offset, span = F.col("scan_no"), max(0, max_id - min_id + 1)
    partitions = max(spark.sparkContext.defaultParallelism, span // PLAN_IDS_PER_TASK)
    return (
        spark.range(0, span, 1, partitions)
        .withColumnRenamed("id", "scan_no")
        .filter((offset % batch_size) % step == 0)
        .select(
            F.expr(f"scan_no div {batch_size}").alias("batch_no"),
            "scan_no",
            ((max_id - offset) if reverse else (min_id + offset)).alias("id"),
        )
    )


def scan_outcome(
    plan: DataFrame,
    articles: DataFrame,
    selection: list[str] | None = None,
    seen: DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """What became of each planned id.

    ``articles`` holds the accepted articles; of several with one id the first by ``order`` counts,
    without an order the one whose category comes first. ``seen`` has the ids handled
    earlier in the run. Only ids, orders and categories take part, reduced to one row per id before the join.
    """
    found = articles.groupBy("id").agg(F.min(_article_rank(order)).alias("__first"))
    found = found.select("id", F.col("__first.category").alias("category"), F.lit(True).alias("__found"))
    joined = plan.join(found, "id", "left")
    if seen is None:
        joined = joined.withColumn("__seen", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(seen.select("id").distinct().withColumn("__seen", F.lit(True)), "id", "left")
    outcome = _outcome_name(F.col("__seen"), F.col("__found").isNull(), F.col("category"), selection)
    return joined.select("batch_no", "scan_no", "id", outcome.alias("outcome"))


def _article_rank(order: str | None) -> Column:
    """The least of it is the article that counts for an id; its category comes along."""
    category = category_or_default(F.col("category")).alias("category")
    return F.struct(*([F.col(order).alias("at")] if order else []), category)


def _outcome_name(seen: Column, missing: Column, category: Column, selection: list[str] | None) -> Column:
    selected = category.isin(list(selection)) if selection else F.lit(True)
    return (
        F.when(seen, "duplicate")
        .when(missing, "not found")
        .when(~selected, "category not selected")
        .otherwise("found")
    )


def scan_outcome_runs(
    articles: DataFrame,
    min_id: int,
    max_id: int,
    batch_size: int,
    step: int = 1,
    reverse: bool = True,
    selection: list[str] | None = None,
    seen: DataFrame | None = None,
    order: str | None = None,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """``scan_outcome`` of a ``batch_plan``, as runs of planned ids with one outcome: from_no, from_id, to_id, ids, outcome.

    ``from_no`` is the ``scan_no`` of the first id; runs are maximal, in the direction of the scan, and cross batches. The plan is
    never generated: only ids that have an article or were seen before become rows, ids that are not found are what lies between
    two of them, so the work grows with the articles and not with the span. Planned ids are numbered without gaps, and runs are
    found in buckets of these numbers. The first and the last run of each bucket that holds an id are
    put together in one task: two rows for a million numbers.
    """
    span = max(0, max_id - min_id + 1)
    per_batch = -(-batch_size // step)
    planned = span // batch_size * per_batch + -(-(span % batch_size) // step)

    # One row per id that is in the plan and not missing, with its number in the plan.
    rows = articles.select("id", _article_rank(order).alias("first"), F.lit(False).alias("seen"))
    if seen is not None:
        nothing = F.lit(None).cast(rows.schema["first"].dataType)
        rows = rows.unionByName(seen.select("id", nothing.alias("first"), F.lit(True).alias("seen")))
    scan_no = (max_id - F.col("id")) if reverse else (F.col("id") - min_id)
    inside = rows.where(F.col("id").between(min_id, max_id)).where(scan_no % batch_size % step == 0)
    handled = inside.groupBy("id").agg(F.min("first").alias("first"), F.max("seen").alias("seen"))
    number = F.expr(f"scan_no div {batch_size} * {per_batch} + scan_no % {batch_size} div {step}")
    outcome = _outcome_name(F.col("seen"), F.lit(False), F.col("first.category"), selection)
    numbered = handled.select(scan_no.cast("bigint").alias("scan_no"), outcome.alias("outcome"))
    numbered = numbered.select(number.alias("no"), "outcome").withColumn("bucket", F.shiftright("no", bucket_bits))

    # Runs inside buckets.
    along = Window.partitionBy("bucket").orderBy("no")
    goes_on = (F.lag("no").over(along) == F.col("no") - 1) & (F.lag("outcome").over(along) == F.col("outcome"))
    starts = F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    pieces = numbered.withColumn("run", starts).groupBy("bucket", "run")
    pieces = pieces.agg(F.min("no").alias("low"), F.max("no").alias("high"), F.first("outcome").alias("outcome"))
    by_run = Window.partitionBy("bucket").orderBy("run")
    pieces = pieces.select("*", F.lead("low").over(by_run).alias("next"), (F.lag("low").over(by_run).isNull()).alias("is_first"))
    pieces = stored(pieces, "runs")

    # The outer runs of all buckets, in one order: what goes on across a border, and what follows a bucket.
    ordered = Window.orderBy("low")
    outer = pieces.where(F.col("is_first") | F.col("next").isNull()).drop("bucket", "run", "is_first")
    joins = (F.lag("high").over(ordered) == F.col("low") - 1) & (F.lag("outcome").over(ordered) == F.col("outcome"))
    outer = outer.select("low", "high", "outcome", F.coalesce("next", F.lead("low").over(ordered), F.lit(planned)).alias("next"), F.when(joins, 0).otherwise(1).alias("new"))
    chained = outer.withColumn("chain", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    chained = chained.groupBy("chain").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("outcome").alias("outcome"), F.max("next").alias("next"))
    inner = pieces.where(~F.col("is_first") & F.col("next").isNotNull())
    runs = inner.select("low", "high", "outcome", "next").unionByName(chained.drop("chain"))

    # A run, and the ids after it that are not found; before the first run, those from the start of the plan.
    after = F.struct((F.col("high") + 1).alias("low"), (F.col("next") - 1).alias("high"), F.lit("not found").alias("outcome"))
    both = runs.select(F.explode(F.array(F.struct("low", "high", "outcome"), after)).alias("r")).select("r.*")
    to_first = F.coalesce(F.min("low"), F.lit(planned)) - 1
    start = pieces.agg(F.lit(0).cast("bigint").alias("low"), to_first.alias("high"), F.lit("not found").alias("outcome"))
    whole = both.unionByName(start).where("low <= high")

    def at(no: str) -> Column:
        return F.expr(f"{no} div {per_batch} * {batch_size} + {no} % {per_batch} * {step}")

    def planned_id(no: str) -> Column:
        return (max_id - at(no)) if reverse else (min_id + at(no))

    return whole.select(
        at("low").alias("from_no"),
        planned_id("low").alias("from_id"),
        planned_id("high").alias("to_id"),
        (F.col("high") - F.col("low") + 1).alias("ids"),
        "outcome",
    )


def batch_progress(outcome: DataFrame) -> DataFrame:
    """Per batch: ids handled, articles found, and found so far."""
    found = F.sum(F.when(F.col("outcome") == "found", 1).otherwise(0))
    per_batch = outcome.groupBy("batch_no").agg(F.count("*").alias("ids"), found.alias("found"))
    batches = stored(per_batch, "batches")
    return running_total_by(batches, F.col("found"), "batch_no", "found_so_far").select(
        "batch_no", "ids", "found", "found_so_far"
    )


def collect_scan(
    spark: SparkSession,
    articles: DataFrame,
    min_id: int,
    max_id: int,
    step: int = 1,
    selection: list[str] | None = None,
    seen: DataFrame | None = None,
    order: str | None = None,
) -> DataFrame:
    """Unbatched scan, oldest first: outcome of every ``step``-th id."""
    plan = batch_plan(spark, min_id, max_id, max(1, max_id - min_id + 1), step, reverse=False)
    return scan_outcome(plan, articles, selection, seen, order)
