"""The given tables seen as articles and as rendered pages, in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.catalog.registry import table
from newsloom.operators.extraction import spread

LINK_PREFIX = "https://news.example.com/article?id="
HOST = "news.example.com"
ANALYSIS_DATE = "2025-10-10T12:00:00"
URL_LANGUAGE = "^https?://[^/]+/([a-z]{2})/"

# ---- documents as articles --------------------------------------------------


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a ``position``; some have no category, some an empty one."""
    doc_id = F.col("doc_id")
    category = (
        F.when(doc_id % 17 == 0, F.lit(None)).when(doc_id % 19 == 0, "").otherwise(F.col("lang"))
    )
    return table(spark, sf_dir, "documents").select(
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit(LINK_PREFIX), doc_id.cast("string")).alias("link"),
        doc_id.alias("id"),
        F.lit(None).cast("string").alias("date"),
        F.concat_ws(", ", "lang", "source").alias("keywords"),
        category.alias("category"),
        doc_id.alias("position"),
    )


ARTICLES_SQL = f"""
articles AS (
  SELECT substr(text, 1, 80) AS title, text AS content,
         '{LINK_PREFIX}' || doc_id AS link, doc_id AS id, CAST(NULL AS VARCHAR) AS date,
         lang || ', ' || source AS keywords,
         CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' ELSE lang END AS category,
         doc_id AS position
  FROM documents)
"""


def source_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles under their source as category: many groups of equal size."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return sources.select("id", F.col("source").alias("category"), F.col("id").alias("position"))


SOURCE_ARTICLES_SQL = """
articles AS (SELECT doc_id AS id, source AS category, doc_id AS position FROM documents)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as articles: ids repeat, and id 0 counts as none."""
    return table(spark, sf_dir, "conversations").select(
        F.col("role").alias("title"),
        F.col("text").alias("content"),
        F.col("conv_id").alias("id"),
        F.col("turn").alias("position"),
    )


TURNS_SQL = """
turns AS (SELECT role AS title, text AS content, conv_id AS id, turn AS position FROM conversations)
"""

# ---- cleaning in SQL ---------------------------------------------------------

SQL_WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"


def sql_collapse(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{SQL_WS}+', ' ', 'g'))"


def sql_clean(expression: str, min_chars: int = 50) -> str:
    unwrapped = rf"regexp_replace({expression}, '<!\[CDATA\[(.*?)\]\]>', '\1', 'g')"
    text = sql_collapse(f"regexp_replace({unwrapped}, '<[^>]+>', '', 'g')")
    return f"(CASE WHEN length({text}) >= {min_chars} THEN {text} ELSE '' END)"


def sql_entities(expression: str) -> str:
    """Decode the entities of the pages, some of which are cut off before the ";"."""
    for name, char in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")]:
        expression = rf"regexp_replace({expression}, '&{name}(?:;|\b)', '{char}', 'g')"
    return expression


def sql_text(markup: str) -> str:
    """Visible text of well-delimited markup: tags separate, entities decoded."""
    return sql_collapse(sql_entities(f"regexp_replace({markup}, '<[^>]+>', ' ', 'g')"))


# ---- documents rendered as pages ----------------------------------------------


def _escape(text: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article pages; ``variant`` says how keywords are given and
    which of date and category are missing."""
    documents = spread(table(spark, sf_dir, "documents"))
    variant = F.col("doc_id") % 6
    source, lang = F.col("source"), F.col("lang")

    def piece(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    meta = piece('<meta name="keywords" content=" meta ', source, ' ">')
    date = piece('<p itemprop="datePublished">\n Praha ', source, " (NEWS)\t</p>")
    keywords = (
        F.when(variant == 0, piece("<p>Klíčová slova: ", source, ", ", lang, "</p>"))
        .when(variant == 1, piece("<p><strong>Klíčová slova</strong> – ", source, "</p>"))
        .when(variant == 2, piece("<div>Klíčová slova —  ", source, " \n ", lang, " --</div>"))
        .when(variant == 3, piece("<div><i>Keywords ", source, "</i></div>"))
        .when(variant == 4, piece("<div>Tags ", lang, "</div><div>Tagy ", source, "</div>"))
        .otherwise("")
    )
    html = F.concat(
        piece("<!DOCTYPE html><html><head><title>", source, "</title>"),
        F.when(variant == 5, "").otherwise(meta),
        piece('</head><body><header><h1 itemprop="name headline">', _escape(F.substring("text", 1, 80)), "</h1></header>"),
        F.when(variant == 3, "").otherwise(date),
        piece('<div id="articlebody"><script>var p="</p>";</script><p>', _escape(F.col("text"))),
        piece('</p><div class="note">Keywords dropped</div><aside><time>lost</time></aside></div>'),
        F.when(variant == 4, "").otherwise(piece('<span itemprop="about">\n ', lang, " </span>")),
        keywords,
        piece("<footer>&copy; ", source, "</footer></body></html>"),
    )
    return documents.select(F.col("doc_id").alias("page_id"), html.alias("html"))


RENDERED_FIELDS_SQL = """
rendered AS (
  SELECT doc_id AS id, text, lang, source,
         CASE WHEN doc_id % 6 = 3 THEN NULL ELSE 'Praha ' || source || ' (NEWS)' END AS date,
         CASE WHEN doc_id % 6 = 4 THEN NULL ELSE lang END AS category,
         CASE doc_id % 6
           WHEN 0 THEN ': ' || source || ', ' || lang
           WHEN 1 THEN 'meta ' || source
           WHEN 2 THEN source || ' ' || lang
           WHEN 3 THEN source
           WHEN 4 THEN source
         END AS keywords
  FROM documents)
"""
