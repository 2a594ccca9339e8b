"""Category counting, ranking, shares, picks and filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.text import (
    category_or_default,
    display_share,
    keywords_preview,
    title_preview,
)
from newsloom.operators.ordering import number_rows
from newsloom.session import stored

# Most names of a selection that are put into the query as literals. Larger
# selections are joined.
MAX_LITERAL_NAMES = 10_000


def category_counts(articles: DataFrame, order: str | None = None) -> DataFrame:
    """Articles per category; with ``order`` also where each was first seen."""
    aggregates = [F.count("*").alias("n")]
    if order:
        aggregates.append(F.min(order).alias("first_seen"))
    return articles.groupBy(category_or_default(F.col("category")).alias("category")).agg(*aggregates)


def category_ranking(counts: DataFrame) -> DataFrame:
    """Rank of each category: by count, descending, ties by first appearance.

    ``counts`` comes from ``category_counts`` with an order column of any ordered type. Categories are free
    text, so their number is not bounded: they are numbered range by range.
    """
    numbered, _ = number_rows(counts, [F.desc("n"), "first_seen"], "__number")
    return numbered.select((F.col("__number") + 1).alias("rank"), "category", "n", "first_seen")


def category_share(counts: DataFrame) -> DataFrame:
    """Add each category's percentage of all articles, exact and for display."""
    counts = stored(counts, "category-counts")
    return _with_share(counts, counts)


def ranked_shares(counts: DataFrame) -> DataFrame:
    """Category listing: rank, category, count, share. Reads ``counts`` more
    than once, so what is costly to count should be ``stored`` first."""
    listing = _with_share(category_ranking(counts), counts)
    return listing.select("rank", "category", "n", "share", "share_text")


def _with_share(df: DataFrame, counts: DataFrame) -> DataFrame:
    share = F.col("n") * F.lit(100.0) / counts.agg(F.sum("n")).scalar()
    return df.withColumn("share", share).withColumn("share_text", display_share(F.col("share")))


def corpus_totals(articles: DataFrame) -> DataFrame:
    """Number of articles and of distinct categories, in one row."""
    return category_counts(articles).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("articles"), F.count("*").alias("categories")
    )


def parse_picks(text: str, allow_all: bool = True) -> list[int] | str | None:
    """Positions in a pick such as "1,3,5"; "all"; None if blank or invalid."""
    choice = text.strip().lower()
    if choice == "all" and allow_all:
        return choice
    try:
        return [int(part) for part in choice.split(",")] if choice else None
    except ValueError:
        return None


def resolve_picks(ranking: DataFrame, text: str, allow_all: bool = True) -> DataFrame:
    """Categories picked by rank as (pos, category), in the order of the pick.

    Ranks out of range are ignored and repeats kept. No rows means no filter.
    """
    picks = parse_picks(text, allow_all)
    if picks == "all":
        return ranking.select((F.col("rank") - 1).alias("pos"), "category")
    wanted = [(pos, rank) for pos, rank in enumerate(picks or []) if 0 < rank < 1 << 63]
    if not wanted:
        return ranking.select(F.lit(0).cast("bigint").alias("pos"), "category").limit(0)
    entries = F.array(
        *[F.struct(F.lit(p).cast("bigint").alias("pos"), F.lit(r).cast("bigint").alias("pick")) for p, r in wanted]
    )
    hits = F.filter(entries, lambda entry: entry["pick"] == F.col("rank"))
    named = ranking.filter(F.col("rank").isin([rank for _, rank in wanted]))
    return named.select("category", F.inline(hits)).select("pos", "category")


def filter_categories(
    articles: DataFrame, selection: DataFrame | Sequence[str] | None, max_literals: int = MAX_LITERAL_NAMES
) -> DataFrame:
    """Articles in one of the selected categories; all of them if none is.

    A selection of checked size becomes an ``IN`` list, which reaches the scan
    and prunes partitions. A longer one is joined. A category with most of the
    articles makes that join skewed on the articles' side, the one that AQE
    splits in a semi-join.
    """
    if selection is None:
        return articles
    category = category_or_default(F.col("category"))
    if isinstance(selection, DataFrame):
        wanted = stored(selection.select(F.col("category").alias("__category")).distinct(), "selection")
        names = [row[0] for row in wanted.limit(max_literals + 1).collect()]
        if len(names) > max_literals:
            return articles.join(wanted, category == F.col("__category"), "left_semi")
    else:
        names = list(selection)
    return articles.filter(category.isin(names)) if names else articles


def category_report_rows(counts: DataFrame, analysis_date: str) -> DataFrame:
    """The report as rows, one per category: the form for any number of categories."""
    counts = stored(counts, "category-counts")
    total = counts.agg(F.count("*")).scalar()
    return counts.select(F.lit(analysis_date).alias("analysis_date"), total.alias("total_categories"), "category", "n")


def category_report(counts: DataFrame, analysis_date: str) -> DataFrame:
    """The report document: date, number of categories, name to count map.

    Takes ``category_counts`` with an order column; names keep first-seen
    order. One document holds all names, so only aggregated counts get here.
    """
    entries = F.array_sort(F.collect_list(F.struct("first_seen", "category", "n")))
    pairs = F.transform(entries, lambda e: F.struct(e["category"], e["n"]))
    return counts.agg(F.count("*").alias("total_categories"), pairs.alias("pairs")).select(
        F.lit(analysis_date).alias("analysis_date"),
        "total_categories",
        F.map_from_entries("pairs").alias("categories"),
    )


def article_previews(articles: DataFrame) -> DataFrame:
    """Short title and keywords of each article."""
    return articles.select(
        "id",
        title_preview(F.col("title")).alias("title_preview"),
        keywords_preview(F.col("keywords")).alias("keywords_preview"),
    )
