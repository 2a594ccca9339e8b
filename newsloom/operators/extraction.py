"""HTML pages to articles: one Arrow stage for the markup, columns for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.functions import html
from newsloom.functions.text import article_link, clean_text, collapse, normalize_keywords, strip
from newsloom.schema import MIN_CLEAN_CHARS, MIN_MAIN_TEXT_CHARS

# Rows turned into Python strings at a time, whatever the Arrow batch size.
_SLICE_ROWS = 128


def _markup_stage(
    pages: DataFrame, keep: Sequence[str], fields: Sequence[str], parse: Callable[[str | None], tuple]
) -> DataFrame:
    """Replace ``html`` by the string fields that ``parse`` reads from it.

    Only the named columns enter the stage, since Catalyst cannot prune
    through it; rows keep their partition, nothing is shuffled.
    """
    # Strings may hold any bytes in Spark; Python takes UTF-8 only.
    source = pages.select(*keep, F.make_valid_utf8("html").alias("html"))
    kept_types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "html"]
    schema = ", ".join([*kept_types, *(f"{name} string" for name in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(start, _SLICE_ROWS)
                markup = part.column("html")
                rows = [parse(text) for text in markup.to_pylist()]
                columns = [part.column(name) for name in keep]
                columns += [pa.array(values, markup.type) for values in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *fields])

    return source.mapInArrow(run, schema)


def spread(pages: DataFrame) -> DataFrame:
    """Use all task slots when a small input has fewer scan splits than that.

    Larger inputs already fill the cluster and are returned unshuffled. Meant
    for a DataFrame that only scans, where counting partitions is free.
    """
    slots = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(slots) if pages.rdd.getNumPartitions() < slots else pages


def extract_fields(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Raw title, content, date, keywords and category of each page."""
    names = ["title_raw", "content_raw", "date_raw", "keywords_raw", "category_raw"]
    return _markup_stage(pages, keep, names, html.article_fields)


def articles_from_fields(
    fields: DataFrame,
    link_prefix: str,
    min_title_chars: int = MIN_CLEAN_CHARS,
    min_content_chars: int = MIN_CLEAN_CHARS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Clean raw fields into the article schema; one row per page."""
    named = fields.withColumnsRenamed({"title_raw": "title", "content_raw": "content"})
    cleaned = clean_text(named, {"title": min_title_chars, "content": min_content_chars})
    return cleaned.select(
        "title",
        "content",
        article_link(F.col("page_id"), link_prefix).alias("link"),
        F.col("page_id").alias("id"),
        strip(F.col("date_raw")).alias("date"),
        normalize_keywords(F.col("keywords_raw")).alias("keywords"),
        strip(F.col("category_raw")).alias("category"),
        *keep,
    )


def accept_articles(articles: DataFrame) -> DataFrame:
    """Keep articles that have both a title and a content.

    A plain filter would be pushed below the cleaning, with all of its steps
    unfolded into the predicate, and so clean every text again. Spark pushes
    nothing below a generator.
    """
    row = F.array(F.struct(*articles.columns))
    complete = F.filter(row, lambda a: (F.length(a["title"]) > 0) & (F.length(a["content"]) > 0))
    return articles.select(F.inline(complete))


def extract_articles(
    pages: DataFrame,
    link_prefix: str,
    min_title_chars: int = MIN_CLEAN_CHARS,
    min_content_chars: int = MIN_CLEAN_CHARS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Accepted articles of ``pages(page_id, html, *keep)``."""
    fields = extract_fields(pages, ["page_id", *keep])
    return accept_articles(
        articles_from_fields(fields, link_prefix, min_title_chars, min_content_chars, keep)
    )


def extract_main_text(
    pages: DataFrame, keep: Sequence[str] = ("page_id",), min_chars: int = MIN_MAIN_TEXT_CHARS
) -> DataFrame:
    """Body text of pages of any site; NULL unless longer than ``min_chars``."""
    texts = _markup_stage(pages, keep, ["text_raw"], html.main_text)
    body = F.col("main_text")
    collapsed = texts.select(*keep, collapse(F.col("text_raw")).alias("main_text"))
    return collapsed.withColumn("main_text", F.when(F.length(body) > min_chars, body))
