"""Queries over markup: cleaning, field extraction, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.catalog.fixtures import (
    HOST,
    LINK_PREFIX,
    RENDERED_FIELDS_SQL,
    rendered_pages,
    sql_clean,
    sql_entities,
    sql_text,
)
from newsloom.catalog.registry import query, table
from newsloom.functions.text import article_id, clean_text
from newsloom.operators.extraction import (
    articles_from_fields,
    extract_articles,
    extract_fields,
    extract_main_text,
    spread,
)
from newsloom.schema import MIN_CLEAN_CHARS
from newsloom.sources.readers import decode_pages


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


WRAPPED_SQL = (
    """('<div class="x">' || text || '</div> <![CDATA[' || source || ' ' || lang || ']]>' """
    """|| chr(9) || '<br/>' || chr(160) || ' <![CDATA[' || chr(10) || ']]> ')"""
)


@query("clean_text", f"SELECT doc_id, {sql_clean(WRAPPED_SQL)} AS cleaned FROM documents")
def _clean_text(spark, sf_dir):
    wrapped = F.concat(
        F.lit('<div class="x">'), "text", F.lit("</div> <![CDATA["), "source", F.lit(" "), "lang",
        F.lit("]]>\t<br/>  <![CDATA[\n]]> "),
    )
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return clean_text(texts.select("doc_id", wrapped.alias("cleaned")), {"cleaned": MIN_CLEAN_CHARS})


ARTICLE_MARKUP = "regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's')"
CONTENT_SQL = sql_clean(sql_text(ARTICLE_MARKUP))
HEADLINE_MARKUP = "regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')"
TITLE_SQL = sql_clean(sql_entities(f"regexp_replace({HEADLINE_MARKUP}, '<[^>]+>', '', 'g')"))


def _fields(spark, sf_dir):
    return articles_from_fields(extract_fields(pages(spark, sf_dir)), LINK_PREFIX)


@query("page_content", f"SELECT page_id AS id, {CONTENT_SQL} AS content FROM pages")
def _page_content(spark, sf_dir):
    return _fields(spark, sf_dir).select("id", "content")


@query("page_title", f"SELECT page_id AS id, {TITLE_SQL} AS title FROM pages")
def _page_title(spark, sf_dir):
    return _fields(spark, sf_dir).select("id", "title")


PAGE_ARTICLES_SQL = f"""
page_articles AS (
  SELECT * FROM (
    SELECT {TITLE_SQL} AS title, {CONTENT_SQL} AS content, '{LINK_PREFIX}' || page_id AS link, page_id AS id,
           CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS keywords, CAST(NULL AS VARCHAR) AS category
    FROM pages)
  WHERE length(title) > 0 AND length(content) > 0)
"""


@query("page_articles", f"WITH {PAGE_ARTICLES_SQL} SELECT * FROM page_articles")
def _page_articles(spark, sf_dir):
    return extract_articles(pages(spark, sf_dir), LINK_PREFIX)


@query(
    "page_articles_any_title",
    f"""SELECT page_id AS id, {sql_clean(sql_entities(f"regexp_replace({HEADLINE_MARKUP}, '<[^>]+>', '', 'g')"), 1)}
        AS title FROM pages WHERE length({CONTENT_SQL}) > 0""",
)
def _page_articles_any_title(spark, sf_dir):
    return extract_articles(pages(spark, sf_dir), LINK_PREFIX, min_title_chars=1).select("id", "title")


@query(
    "main_text",
    f"""SELECT page_id, CASE WHEN length(body) > 100 THEN body END AS main_text
        FROM (SELECT page_id, {sql_text(ARTICLE_MARKUP)} AS body FROM pages)""",
)
def _main_text(spark, sf_dir):
    return extract_main_text(pages(spark, sf_dir))


WITHOUT_BOILERPLATE = "html"
for _pattern in ["<!--.*?-->", "<style>.*?</style>", "<script>.*?</script>", "<nav>.*?</nav>", "<footer>.*?</footer>"]:
    WITHOUT_BOILERPLATE = f"regexp_replace({WITHOUT_BOILERPLATE}, '{_pattern}', ' ', 'gs')"


@query("page_fallback", f"SELECT page_id AS id, {sql_clean(sql_text(WITHOUT_BOILERPLATE))} AS content FROM pages")
def _page_fallback(spark, sf_dir):
    renamed = F.replace(
        F.replace("html", F.lit("<article"), F.lit("<section")), F.lit("</article>"), F.lit("</section>")
    )
    sections = pages(spark, sf_dir).withColumn("html", renamed)
    return articles_from_fields(extract_fields(sections), LINK_PREFIX).select("id", "content")


@query(
    "main_text_fallback",
    f"""SELECT page_id, CASE WHEN length(body) > 100 THEN body END AS main_text
        FROM (SELECT page_id, {sql_text(WITHOUT_BOILERPLATE)} AS body FROM pages)""",
)
def _main_text_fallback(spark, sf_dir):
    renamed = F.replace(
        F.replace("html", F.lit("<article"), F.lit("<section")), F.lit("</article>"), F.lit("</section>")
    )
    return extract_main_text(pages(spark, sf_dir).withColumn("html", renamed))


def _rendered_fields(spark, sf_dir):
    return articles_from_fields(extract_fields(rendered_pages(spark, sf_dir)), LINK_PREFIX)


@query("meta_fields", f"WITH {RENDERED_FIELDS_SQL} SELECT id, date, category FROM rendered")
def _meta_fields(spark, sf_dir):
    return _rendered_fields(spark, sf_dir).select("id", "date", "category")


@query("keywords_cascade", f"WITH {RENDERED_FIELDS_SQL} SELECT id, keywords FROM rendered")
def _keywords_cascade(spark, sf_dir):
    return _rendered_fields(spark, sf_dir).select("id", "keywords")


RENDERED_ARTICLES_SQL = f"""
{RENDERED_FIELDS_SQL}, rendered_articles AS (
  SELECT * FROM (
    SELECT {sql_clean("substr(text, 1, 80)")} AS title, {sql_clean("text")} AS content,
           '{LINK_PREFIX}' || id AS link, id, date, keywords, category
    FROM rendered)
  WHERE length(title) > 0 AND length(content) > 0)
"""


@query("rendered_articles", f"WITH {RENDERED_ARTICLES_SQL} SELECT * FROM rendered_articles")
def _rendered_articles(spark, sf_dir):
    return extract_articles(rendered_pages(spark, sf_dir), LINK_PREFIX)


@query(
    "decode_body",
    f"SELECT doc_id AS page_id, '{LINK_PREFIX}' || doc_id AS url, text AS html FROM documents",
)
def _decode_body(spark, sf_dir):
    """Bodies in two charsets; some UTF-8 ones contain a byte that is not."""
    latin = (F.col("doc_id") % 3 == 1) & F.col("text").rlike(r"^[\x{00}-\x{ff}]*$")
    broken = F.col("doc_id") % 10 == 0
    utf8 = F.encode("text", "UTF-8")
    cut = F.length(F.encode(F.substring_index("text", " ", 1), "UTF-8"))
    with_bad_byte = F.concat(
        F.substring(utf8, F.lit(1), cut), F.unhex(F.lit("FF")), F.substring(utf8, cut + 1, F.octet_length("text"))
    )
    body = (
        F.when(latin, F.encode("text", "ISO-8859-1")).when(broken, with_bad_byte).otherwise(utf8)
    )
    charset = F.when(latin, "ISO-8859-1").when(F.col("doc_id") % 2 == 0, "utf-8")
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), body.alias("body"), charset.alias("charset")
    )
    return decode_pages(raw, LINK_PREFIX)


@query(
    "article_id_from_url",
    f"""SELECT 'document' AS origin, doc_id AS key, doc_id AS article_id FROM documents
        UNION ALL SELECT 'other host', doc_id, NULL FROM documents
        UNION ALL SELECT 'page', page_id, NULL FROM pages
        UNION ALL SELECT 'pid', doc_id, doc_id FROM documents
        UNION ALL SELECT 'no digits', doc_id, NULL FROM documents""",
)
def _article_id_from_url(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    number = F.col("key").cast("string")
    linked = {
        "document": F.concat(F.lit(LINK_PREFIX), number),
        "other host": F.concat(F.lit("https://other.example.org/z.php?id="), number),
        "pid": F.concat(F.lit(f"https://{HOST}/z.php?pid="), number, F.lit("&id=7")),
        "no digits": F.concat(F.lit(f"https://{HOST}/z.php?id=x"), number),
    }
    origins = F.array(*[F.struct(F.lit(k).alias("origin"), url.alias("url")) for k, url in linked.items()])
    links = documents.select("key", F.inline(origins)).select("origin", "key", "url")
    urls = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("key"), "url")
    return links.unionByName(urls).select("origin", "key", article_id(F.col("url"), HOST).alias("article_id"))
