"""Whole runs composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsloom.operators.categories import (
    category_counts,
    category_report,
    category_report_rows,
    filter_categories,
    ranked_shares,
    resolve_picks,
)
from newsloom.operators.dedup import first_per_id, has_id, skip_processed
from newsloom.operators.extraction import extract_articles
from newsloom.operators.scan import (
    batch_plan,
    batch_progress,
    id_range,
    newest_n,
    newest_span,
    scan_outcome,
)
from newsloom.schema import (
    ANALYSIS_SPAN,
    MIN_CLEAN_CHARS,
    SAMPLE_SPAN,
    SCAN_SPANS,
)
from newsloom.session import stored
from newsloom.sources.writers import exported_articles


def preset_bounds(preset: str, latest: int) -> tuple[int, int]:
    """First and last id of a preset's scan."""
    return newest_span(latest, None if preset == "maximum" else SCAN_SPANS[preset])


def pages_to_parse(
    pages: DataFrame, bounds: tuple[int, int], existing: DataFrame | None = None, processed: DataFrame | None = None
) -> DataFrame:
    """Pages of an id range that are neither in ``processed`` (page_id) nor in a corpus already.

    An article has the id of its page, so what is known is known before parsing.
    """
    wanted = id_range(pages, *bounds, "page_id")
    if processed is not None:
        wanted = skip_processed(wanted, processed, "page_id")
    if existing is not None:
        known = id_range(existing.filter(has_id()), *bounds).select(F.col("id").alias("page_id"))
        wanted = skip_processed(wanted, known, "page_id")
    return wanted


def range_scan(
    pages: DataFrame,
    existing: DataFrame | None,
    bounds: tuple[int, int],
    link_prefix: str,
    selection: DataFrame | Sequence[str] | None = None,
    processed: DataFrame | None = None,
    min_title_chars: int = MIN_CLEAN_CHARS,
    min_content_chars: int = MIN_CLEAN_CHARS,
    order: str = "page_id",
) -> DataFrame:
    """Articles that a scan of an id range adds to a corpus.

    Only ``pages_to_parse`` are parsed, and their articles stored once. ``order`` is the page column that
    tells which of several pages with one id comes first; of those that tie the least article does.
    """
    wanted = pages_to_parse(pages, bounds, existing, processed)
    wanted = wanted.withColumn("__order", F.col(order))
    articles = extract_articles(wanted, link_prefix, min_title_chars, min_content_chars, ["__order"])
    chosen = stored(filter_categories(articles, selection).filter(has_id()), "scanned")
    return first_per_id(chosen, "__order").drop("__order")


def page_articles(
    pages: DataFrame, bounds: tuple[int, int], link_prefix: str, order: str = "page_id", **limits: int
) -> DataFrame:
    """Accepted articles of the pages in an id range, with ``position``; parsed once and stored.

    The range reaches the page scan, so that no other page is parsed.
    """
    wanted = id_range(pages, *bounds, "page_id").withColumn("position", F.col(order))
    return stored(extract_articles(wanted, link_prefix, keep=["position"], **limits), "page-articles")


@dataclass
class ScanReport:
    """What became of each id, and the progress by batch."""

    outcome: DataFrame
    progress: DataFrame


def scan_report(
    articles: DataFrame,
    bounds: tuple[int, int],
    batch_size: int,
    reverse: bool = True,
    step: int = 1,
    selection: Sequence[str] | None = None,
    seen: DataFrame | None = None,
    order: str | None = None,
) -> ScanReport:
    """Report on a batched scan that can find ``articles``."""
    plan = batch_plan(articles.sparkSession, *bounds, batch_size, step, reverse)
    outcome = scan_outcome(plan, articles, selection, seen, order)
    return ScanReport(outcome, batch_progress(outcome))


def page_scan_report(
    pages: DataFrame, bounds: tuple[int, int], batch_size: int, link_prefix: str, order: str = "page_id", **options
) -> ScanReport:
    """``scan_report`` from pages; ``options`` as there."""
    articles = page_articles(pages, bounds, link_prefix, order)
    return scan_report(articles, bounds, batch_size, order="position", **options)


def sample_categories(articles: DataFrame, latest: int, order: str, span: int = SAMPLE_SPAN) -> DataFrame:
    """Category listing of the newest few articles."""
    counts = category_counts(newest_n(articles, latest, span), order)
    return ranked_shares(stored(counts, "category-counts"))


def page_sample_categories(
    pages: DataFrame, latest: int, link_prefix: str, order: str = "page_id", span: int = SAMPLE_SPAN
) -> DataFrame:
    """``sample_categories`` from pages; an id that was landed several times counts once, as first landed."""
    articles = page_articles(pages, newest_span(latest, span), link_prefix, order)
    return sample_categories(first_per_id(articles, "position"), latest, "position", span)


@dataclass
class CategoryAnalysis:
    """Results of an analysis. Only the counts behind them are computed at once."""

    listing: DataFrame
    report: DataFrame
    report_rows: DataFrame
    exported: DataFrame | None


def category_analysis(
    articles: DataFrame,
    latest: int,
    order: str,
    analysis_date: str,
    picks: str | None = None,
    span: int | None = ANALYSIS_SPAN,
) -> CategoryAnalysis:
    """Analyse the newest articles: listing, report, and export of the picks.

    The export filters the articles as scanned; listing and report see one row
    per id, as saved.
    """
    scanned = newest_n(articles, latest, span)
    saved = first_per_id(scanned.filter(has_id()), order)
    return _analysis(scanned, category_counts(saved, order), order, analysis_date, picks)


def page_category_analysis(
    pages: DataFrame,
    latest: int,
    link_prefix: str,
    analysis_date: str,
    picks: str | None = None,
    span: int | None = ANALYSIS_SPAN,
    order: str = "page_id",
) -> CategoryAnalysis:
    """``category_analysis`` from pages, each parsed once for listing, report and export."""
    articles = page_articles(pages, newest_span(latest, span), link_prefix, order)
    return category_analysis(articles, latest, "position", analysis_date, picks, span)


def post_filter(articles: DataFrame, order: str, analysis_date: str, picks: str) -> CategoryAnalysis:
    """Filter a finished corpus by picks; the report counts all of it."""
    return _analysis(articles, category_counts(articles, order), order, analysis_date, picks)


def _analysis(
    articles: DataFrame, counts: DataFrame, order: str, analysis_date: str, picks: str | None
) -> CategoryAnalysis:
    counts = stored(counts, "category-counts")
    listing = ranked_shares(counts)
    exported = None
    if picks:
        # As many names as the text has numbers, at most.
        picked = resolve_picks(listing, picks, allow_all=False).select("category").distinct()
        names = [row.category for row in picked.collect()]
        exported = exported_articles(articles, names, order) if names else None
    document, rows = category_report(counts, analysis_date), category_report_rows(counts, analysis_date)
    return CategoryAnalysis(listing, document, rows, exported)
