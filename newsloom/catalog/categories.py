"""Queries for counting, ranking, picking and filtering categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.extraction import PAGE_ARTICLES_SQL, pages
from newsloom.catalog.fixtures import (
    ANALYSIS_DATE,
    ARTICLES_SQL,
    LINK_PREFIX,
    SOURCE_ARTICLES_SQL,
    URL_LANGUAGE,
    articles,
    source_articles,
)
from newsloom.catalog.registry import query, table
from newsloom.operators.categories import (
    article_previews,
    category_counts,
    category_ranking,
    category_report,
    category_report_rows,
    category_share,
    corpus_totals,
    filter_categories,
    ranked_shares,
    resolve_picks,
)
from newsloom.operators.extraction import extract_articles, spread
from newsloom.operators.scan import id_bounds, newest_n
from newsloom.plans.analysis import (
    category_analysis,
    page_sample_categories,
    post_filter,
    sample_categories,
)
from newsloom.schema import ANALYSIS_SPAN
from newsloom.session import stored
from newsloom.sources.writers import exported_articles, output_summary

COUNTS_SQL = """
counts AS (
  SELECT coalesce(category, 'Uncategorized') AS category, count(*) AS n, min(position) AS first_seen
  FROM articles GROUP BY 1)
"""
RANKING_SQL = f"""
{COUNTS_SQL},
ranking AS (SELECT row_number() OVER (ORDER BY n DESC, first_seen) AS rank, * FROM counts)
"""
LISTING_SQL = f"""
{RANKING_SQL},
listing AS (
  SELECT rank, category, n, n * CAST(100.0 AS DOUBLE) / (SELECT sum(n) FROM counts) AS share,
         printf('%.1f', n * CAST(100.0 AS DOUBLE) / (SELECT sum(n) FROM counts)) AS share_text
  FROM ranking)
"""


@query("category_counts", f"WITH {ARTICLES_SQL}, {COUNTS_SQL} SELECT category, n FROM counts")
def _category_counts(spark, sf_dir):
    return category_counts(articles(spark, sf_dir))


@query("category_ranking", f"WITH {ARTICLES_SQL}, {RANKING_SQL} SELECT * FROM ranking")
def _category_ranking(spark, sf_dir):
    return category_ranking(category_counts(articles(spark, sf_dir), "position"))


@query("category_ranking_ties", f"WITH {SOURCE_ARTICLES_SQL}, {RANKING_SQL} SELECT * FROM ranking")
def _category_ranking_ties(spark, sf_dir):
    return category_ranking(category_counts(source_articles(spark, sf_dir), "position"))


@query(
    "category_ranking_texts",
    f"""WITH articles AS (SELECT text AS category, doc_id AS position FROM documents), {RANKING_SQL}
        SELECT * FROM ranking""",
)
def _category_ranking_texts(spark, sf_dir):
    """Free text as category: nearly as many groups as rows."""
    documents = table(spark, sf_dir, "documents")
    texts = documents.select(F.col("text").alias("category"), F.col("doc_id").alias("position"))
    return category_ranking(category_counts(texts, "position"))


@query("category_share", f"WITH {ARTICLES_SQL}, {LISTING_SQL} SELECT category, n, share, share_text FROM listing")
def _category_share(spark, sf_dir):
    return category_share(category_counts(articles(spark, sf_dir)))


@query("category_totals", f"WITH {ARTICLES_SQL}, {COUNTS_SQL} SELECT CAST(sum(n) AS BIGINT) AS articles, count(*) AS categories FROM counts")
def _category_totals(spark, sf_dir):
    return corpus_totals(articles(spark, sf_dir))


@query(
    "category_filter",
    f"""WITH {ARTICLES_SQL} SELECT * FROM articles
        WHERE coalesce(category, 'Uncategorized') IN ('en', 'Uncategorized')""",
)
def _category_filter(spark, sf_dir):
    return filter_categories(articles(spark, sf_dir), ["en", "Uncategorized"])


@query("category_filter_none", f"WITH {ARTICLES_SQL} SELECT * FROM articles")
def _category_filter_none(spark, sf_dir):
    return filter_categories(articles(spark, sf_dir), None)


PICKED_SQL = f"""
{ARTICLES_SQL}, {RANKING_SQL},
picked AS (
  SELECT pos, category FROM ranking
  JOIN (SELECT * FROM (VALUES (0, 3), (1, 1), (2, 99), (3, 1)) AS v(pos, pick)) ON rank = pick)
"""
PICKS = " 3, 1,99,1 "


@query("category_filter_picks", f"WITH {PICKED_SQL} SELECT * FROM articles WHERE coalesce(category, 'Uncategorized') IN (SELECT category FROM picked)")
def _category_filter_picks(spark, sf_dir):
    corpus = articles(spark, sf_dir)
    ranking = category_ranking(category_counts(corpus, "position"))
    return filter_categories(corpus, resolve_picks(ranking, PICKS))


@query("category_filter_long", f"WITH {PICKED_SQL} SELECT * FROM articles WHERE coalesce(category, 'Uncategorized') IN (SELECT category FROM picked)")
def _category_filter_long(spark, sf_dir):
    """The join that serves selections too long for literals."""
    corpus = articles(spark, sf_dir)
    ranking = category_ranking(category_counts(corpus, "position"))
    return filter_categories(corpus, resolve_picks(ranking, PICKS), max_literals=0)


@query("category_picks", f"WITH {PICKED_SQL} SELECT CAST(pos AS BIGINT) AS pos, category FROM picked")
def _category_picks(spark, sf_dir):
    return resolve_picks(category_ranking(category_counts(articles(spark, sf_dir), "position")), PICKS)


@query(
    "category_picks_all",
    f"WITH {SOURCE_ARTICLES_SQL}, {RANKING_SQL} SELECT rank - 1 AS pos, category FROM ranking",
)
def _category_picks_all(spark, sf_dir):
    return resolve_picks(category_ranking(category_counts(source_articles(spark, sf_dir), "position")), " ALL ")


REPORT_SQL = f"""
{ARTICLES_SQL}, {COUNTS_SQL},
report AS (
  SELECT '{{"analysis_date":"{ANALYSIS_DATE}","total_categories":' || count(*) || ',"categories":{{'
         || string_agg(to_json(category) || ':' || n, ',' ORDER BY first_seen) || '}}}}' AS report
  FROM counts)
"""


@query("category_report", f"WITH {REPORT_SQL} SELECT report FROM report")
def _category_report(spark, sf_dir):
    report = category_report(category_counts(articles(spark, sf_dir), "position"), ANALYSIS_DATE)
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


@query(
    "category_report_rows",
    f"""WITH {SOURCE_ARTICLES_SQL}, {COUNTS_SQL}
        SELECT '{ANALYSIS_DATE}' AS analysis_date, (SELECT count(*) FROM counts) AS total_categories, category, n
        FROM counts""",
)
def _category_report_rows(spark, sf_dir):
    return category_report_rows(category_counts(source_articles(spark, sf_dir), "position"), ANALYSIS_DATE)


@query(
    "article_preview",
    f"""WITH {ARTICLES_SQL} SELECT id, substr(title, 1, 50) || '...' AS title_preview,
        CASE WHEN length(keywords) > 0 THEN substr(keywords, 1, 30) || '...' END AS keywords_preview FROM articles""",
)
def _article_preview(spark, sf_dir):
    return article_previews(articles(spark, sf_dir))


# JSON text of one article: null fields are left out, and of the special
# characters only quotes, backslashes and control characters are escaped.
JSON_SIZE_SQL = """octet_length(encode('{"title":' || to_json(title) || ',"content":' || to_json(content)
  || ',"link":' || to_json(link) || ',"id":' || id || ',"keywords":' || to_json(keywords)
  || CASE WHEN category IS NULL THEN '' ELSE ',"category":' || to_json(category) END || '}'))"""


@query(
    "output_summary",
    f"""WITH {ARTICLES_SQL}, sizes AS (SELECT {JSON_SIZE_SQL} AS size FROM articles)
        SELECT count(*) AS articles, CAST(sum(size) AS BIGINT) AS json_bytes,
               printf('%.1f', sum(size) / 1024.0 / 1024.0) AS size_mb FROM sizes""",
)
def _output_summary(spark, sf_dir):
    return output_summary(articles(spark, sf_dir))


def _newest_sql(span: int) -> str:
    return f"newest AS (SELECT * FROM articles WHERE id BETWEEN greatest(1, (SELECT max(id) FROM articles) - {span} + 1) AND (SELECT max(id) FROM articles))"


@query(
    "sample_categories",
    f"""WITH {ARTICLES_SQL}, {_newest_sql(50)}, {LISTING_SQL.replace("FROM articles", "FROM newest")}
        SELECT * FROM listing""",
)
def _sample_categories(spark, sf_dir):
    corpus = articles(spark, sf_dir)
    return sample_categories(corpus, id_bounds(corpus)[1], "position")


def _analysis_of_documents(spark, sf_dir, picks=None):
    corpus = articles(spark, sf_dir)
    return category_analysis(corpus, id_bounds(corpus)[1], "position", ANALYSIS_DATE, picks)


SAVED_SQL = f"{_newest_sql(200)}, {LISTING_SQL.replace('FROM articles', 'FROM newest')}"


@query("category_analysis", f"WITH {ARTICLES_SQL}, {SAVED_SQL} SELECT * FROM listing")
def _category_analysis(spark, sf_dir):
    return _analysis_of_documents(spark, sf_dir).listing


@query(
    "category_analysis_export",
    f"""WITH {ARTICLES_SQL}, {SAVED_SQL}
        SELECT title, content, link, id, date, keywords, category FROM newest
        WHERE coalesce(category, 'Uncategorized') IN (SELECT category FROM ranking WHERE rank IN (1, 3))""",
)
def _category_analysis_export(spark, sf_dir):
    return _analysis_of_documents(spark, sf_dir, "1,3").exported


@query(
    "category_analysis_report",
    f"""WITH {ARTICLES_SQL}, {SAVED_SQL}
        SELECT '{ANALYSIS_DATE}' AS analysis_date, (SELECT count(*) FROM counts) AS total_categories, category, n
        FROM counts""",
)
def _category_analysis_report(spark, sf_dir):
    return _analysis_of_documents(spark, sf_dir).report_rows


def page_category_listing(spark, sf_dir):
    """Analysis of the newest pages: markup to articles to category listing.

    The pages carry no category of their own, so the language in their address
    stands in for it.
    """
    source = table(spark, sf_dir, "pages")
    latest = id_bounds(source, "page_id")[1]
    newest = spread(newest_n(source, latest, ANALYSIS_SPAN, "page_id"))
    language = F.nullif(F.regexp_extract("url", URL_LANGUAGE, 1), F.lit(""))
    corpus = (
        extract_articles(newest, LINK_PREFIX, keep=["url"])
        .withColumn("category", F.coalesce("category", language))
        .withColumn("position", F.col("id"))
        .drop("url")
    )
    return category_analysis(corpus, latest, "position", ANALYSIS_DATE).listing


@query(
    "page_category_analysis",
    f"""WITH {PAGE_ARTICLES_SQL}, articles AS (
          SELECT a.id, nullif(regexp_extract(url, '{URL_LANGUAGE}', 1), '') AS category, a.id AS position
          FROM page_articles a JOIN pages p ON p.page_id = a.id
          WHERE a.id BETWEEN greatest(1, (SELECT max(page_id) FROM pages) - 199) AND (SELECT max(page_id) FROM pages)),
        {LISTING_SQL} SELECT * FROM listing""",
)
def _page_category_analysis(spark, sf_dir):
    return page_category_listing(spark, sf_dir)


@query(
    "page_category_listing",
    f"""WITH {PAGE_ARTICLES_SQL}, articles AS (
          SELECT a.id, nullif(regexp_extract(url, '{URL_LANGUAGE}', 1), '') AS category, a.id AS position
          FROM page_articles a JOIN pages p ON p.page_id = a.id),
        {LISTING_SQL} SELECT * FROM listing""",
)
def _page_category_listing(spark, sf_dir):
    """The same listing over all pages."""
    language = F.nullif(F.regexp_extract("url", URL_LANGUAGE, 1), F.lit(""))
    corpus = (
        extract_articles(pages(spark, sf_dir), LINK_PREFIX, keep=["url"])
        .withColumn("category", F.coalesce("category", language))
        .withColumn("position", F.col("id"))
    )
    return ranked_shares(stored(category_counts(corpus, "position"), "category-counts"))


@query(
    "page_sample_categories",
    f"""WITH {PAGE_ARTICLES_SQL}, articles AS (
          SELECT id, category, id AS position FROM page_articles
          WHERE id BETWEEN greatest(1, (SELECT max(page_id) FROM pages) - 49) AND (SELECT max(page_id) FROM pages)),
        {LISTING_SQL} SELECT * FROM listing""",
)
def _page_sample_categories(spark, sf_dir):
    source = table(spark, sf_dir, "pages")
    return page_sample_categories(source, id_bounds(source, "page_id")[1], LINK_PREFIX)


@query(
    "page_sample_repeats",
    f"""WITH {PAGE_ARTICLES_SQL}, articles AS (
          SELECT id, category, id AS position FROM page_articles
          WHERE id BETWEEN greatest(1, (SELECT max(page_id) FROM pages) - 49) AND (SELECT max(page_id) FROM pages)),
        {LISTING_SQL} SELECT * FROM listing""",
)
def _page_sample_repeats(spark, sf_dir):
    """The same sample of pages that were landed twice: an id counts once."""
    source = table(spark, sf_dir, "pages")
    return page_sample_categories(source.unionByName(source), id_bounds(source, "page_id")[1], LINK_PREFIX)


@query("post_filter", f"WITH {ARTICLES_SQL}, {LISTING_SQL} SELECT * FROM listing")
def _post_filter(spark, sf_dir):
    return post_filter(articles(spark, sf_dir), "position", ANALYSIS_DATE, "2").listing


@query(
    "post_filter_export",
    f"""WITH {ARTICLES_SQL}, {RANKING_SQL}
        SELECT title, content, link, id, date, keywords, category FROM articles
        WHERE coalesce(id, 0) <> 0
          AND coalesce(category, 'Uncategorized') IN (SELECT category FROM ranking WHERE rank IN (2, 4))""",
)
def _post_filter_export(spark, sf_dir):
    return post_filter(articles(spark, sf_dir), "position", ANALYSIS_DATE, "2, 4").exported


@query(
    "export_filtered",
    f"""WITH {ARTICLES_SQL} SELECT title, content, link, id, date, keywords, category FROM articles
        WHERE coalesce(id, 0) <> 0 AND coalesce(category, 'Uncategorized') IN ('', 'fr')""",
)
def _export_filtered(spark, sf_dir):
    return exported_articles(articles(spark, sf_dir), ["", "fr"], "position")
