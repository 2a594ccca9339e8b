"""Column expressions for text cleaning. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.schema import (
    CATEGORY_FOLDERS,
    DEFAULT_CATEGORY,
    MIN_KEYWORDS_CHARS,
    PREVIEW_KEYWORDS_CHARS,
    PREVIEW_TITLE_CHARS,
)

# Patterns that decide the results.
# Members of a class of Unicode white space, under the flag (?U).
WHITESPACE = r"\s\x{1c}-\x{1f}"
# A CDATA section on one line; (?d) makes "." exclude only the line feed.
CDATA = r"(?d)<!\[CDATA\[(.*?)\]\]>"
TAG = r"<[^>]++>"
ID_PARAMETER = r"id=(\d+)"

# An opening without an end would be searched to the end of the line or text
# again from each further opening in it. These match it whole, to be kept.
OPEN_CDATA = r"(<!\[CDATA\[.*+)"
OPEN_TAG = r"(<[^>]*+\z)"


def _trim_class(column: Column, members: str) -> Column:
    # The look-behind starts a match only at the head of a run, so that long
    # inner runs are not rescanned from each of their characters.
    return F.regexp_replace(column, f"(?U)^[{members}]++|(?<![{members}])[{members}]++$", "")


def strip(column: Column) -> Column:
    """Trim Unicode white space (``trim`` removes only U+0020)."""
    return _trim_class(column, WHITESPACE)


def collapse(column: Column) -> Column:
    """Trim, and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(column, f"(?U)[{WHITESPACE}]+", " "))


def _unwrap_cdata(column: Column) -> Column:
    unwrapped = F.regexp_replace(column, f"{CDATA}|{OPEN_CDATA}", "$1$2")
    return F.when(F.contains(column, F.lit("<![CDATA[")), unwrapped).otherwise(column)


def _drop_tags(column: Column) -> Column:
    # The plain pattern is several times faster; the other one is for texts
    # with an opening after their last end of a tag.
    tail = F.substring_index(column, ">", -1)
    return (
        F.when(~F.contains(column, F.lit("<")), column)
        .when(F.contains(tail, F.lit("<")), F.regexp_replace(column, f"{TAG}|{OPEN_TAG}", "$1"))
        .otherwise(F.regexp_replace(column, TAG, ""))
    )


def _long_enough(column: Column, min_chars: int) -> Column:
    return F.when(F.length(column) >= min_chars, column).otherwise("")


def clean_text(df: DataFrame, min_chars: dict[str, int]) -> DataFrame:
    """Clean the named columns: unwrap CDATA, delete tags, collapse white space.

    Missing texts, and those below their minimum length, become ''. Each step
    reads its input more than once, hence a column of its own per step: Spark
    then computes the step before only once.
    """
    names = list(min_chars)
    df = df.withColumns({name: _unwrap_cdata(F.col(name)) for name in names})
    df = df.withColumns({name: collapse(_drop_tags(F.col(name))) for name in names})
    return df.withColumns({name: _long_enough(F.col(name), n) for name, n in min_chars.items()})


def normalize_keywords(column: Column) -> Column:
    """Collapse, trim dashes and white space; NULL unless something is left."""
    trimmed = _trim_class(collapse(column), rf"\-–—{WHITESPACE}")
    return F.when(F.length(trimmed) > MIN_KEYWORDS_CHARS, trimmed)


def article_id(url: Column, host: str) -> Column:
    """Article id in a link to ``host``; NULL for other links."""
    digits = F.nullif(F.regexp_extract(url, ID_PARAMETER, 1), F.lit(""))
    return F.when(F.contains(url, F.lit(host)), digits.try_cast("bigint"))


def article_link(article_id: Column, prefix: str) -> Column:
    """Canonical link of an article: a site prefix followed by the id."""
    return F.concat(F.lit(prefix), article_id.cast("string"))


def category_folder(category: Column) -> Column:
    """Number of the folder for a category, in a corpus written by category."""
    return F.pmod(F.xxhash64(category), F.lit(CATEGORY_FOLDERS)).cast("int")


def category_or_default(category: Column) -> Column:
    """A missing category is a group of its own; '' stays ''."""
    return F.coalesce(category, F.lit(DEFAULT_CATEGORY))


def title_preview(title: Column) -> Column:
    return F.concat(F.substring(title, 1, PREVIEW_TITLE_CHARS), F.lit("..."))


def keywords_preview(keywords: Column) -> Column:
    """Preview of non-empty keywords, else NULL."""
    text = F.concat(F.substring(keywords, 1, PREVIEW_KEYWORDS_CHARS), F.lit("..."))
    return F.when(F.length(keywords) > 0, text)


def display_share(share: Column) -> Column:
    """Percentage with one decimal, halves rounded to even."""
    return F.format_number(share, 1)
