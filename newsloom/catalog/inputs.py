"""Queries that write inputs derived from the tables and read them back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from newsloom.catalog.extraction import PAGE_ARTICLES_SQL
from newsloom.catalog.fixtures import ARTICLES_SQL, HOST, LINK_PREFIX, articles
from newsloom.catalog.registry import query, table
from newsloom.functions.charset import CharsetModel, character_pairs, charsets_of_groups
from newsloom.functions.decode import decode_body
from newsloom.operators.categories import category_counts
from newsloom.operators.dedup import merge_new
from newsloom.operators.extraction import extract_articles
from newsloom.operators.scan import feed_id_range, feed_ids, id_bounds, newest_span, with_fallback
from newsloom.schema import ARTICLE, CATEGORY_VOCABULARY
from newsloom.session import shared_folder, stored
from newsloom.sources.clustered import ClusteredCorpus
from newsloom.sources.readers import (
    decode_pages,
    default_category_list,
    feed_items,
    read_article_arrays,
    read_articles,
    read_articles_or_empty,
    read_categories,
    read_category_list,
    read_feed_items,
    read_pages,
    read_raw_pages,
)
from newsloom.sources.writers import (
    enclosed,
    export_filtered,
    output_name_column,
    read_category_report_fragments,
    write_articles,
    write_category_report,
    write_category_report_fragments,
    write_page_files,
)

CORPUS_SQL = f"WITH {ARTICLES_SQL} SELECT title, content, link, id, date, keywords, category FROM articles"

# ---- feeds ---------------------------------------------------------------------------

# Items with a link, with an empty one, without one, and to another host.
FEED_RANGE_SQL = """
    SELECT max(doc_id) AS latest_id, min(doc_id) AS earliest_id, count(doc_id) AS items
    FROM documents WHERE doc_id % 4 = 0 AND doc_id <> 0"""


def item_column():
    number = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit(f"<item><title>t</title><link>{LINK_PREFIX}"), number, F.lit("</link></item>")))
        .when(kind == 1, F.lit("<item><title>t</title><link></link></item>"))
        .when(kind == 2, F.lit("<item><title>no link</title></item>"))
        .otherwise(F.concat(F.lit("<item><link>https://other.example.org/?id="), number, F.lit("</link></item>")))
        .alias("item")
    )


@query("feed_range", FEED_RANGE_SQL)
def _feed_range(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(item_column().alias("item"))
    return feed_id_range(feed_ids(feed_items(rows, "item"), HOST))


@query(
    "feed_range_fallback",
    "SELECT CAST(200000 AS BIGINT) AS latest_id, CAST(1 AS BIGINT) AS earliest_id, count(*) FILTER (doc_id < 0) AS items FROM documents",
)
def _feed_range_fallback(spark, sf_dir):
    """A feed that links to another site only: the assumed range."""
    rows = table(spark, sf_dir, "documents").select(item_column().alias("item"))
    return with_fallback(feed_id_range(feed_ids(feed_items(rows, "item"), "elsewhere.example.net")))


@query("read_feed", FEED_RANGE_SQL)
def _read_feed(spark, sf_dir):
    """Items written as feeds, one a partition."""
    path = shared_folder(spark, "feed")
    items = table(spark, sf_dir, "documents").select(item_column().alias("value"))
    enclosed(items, '<rss version="2.0"><channel>', "", "</channel></rss>").write.text(path)
    return feed_id_range(feed_ids(read_feed_items(spark, path), HOST))


# ---- pages ---------------------------------------------------------------------------

@query("read_pages", "SELECT page_id, url, html FROM pages")
def _read_pages(spark, sf_dir):
    path = shared_folder(spark, "pages")
    table(spark, sf_dir, "pages").write.parquet(path)
    return read_pages(spark, path)


def dump_pages(spark, sf_dir):
    """Pages as a dump of one file each, in folders named by id; each ends with a newline."""
    path = shared_folder(spark, "dump")
    write_page_files(table(spark, sf_dir, "pages").select("page_id", "html"), path, "page_id")
    return path


RAW_PAGES_SQL = f"SELECT page_id, '{LINK_PREFIX}' || page_id AS url, html || chr(10) AS html FROM pages"


@query("read_raw_pages", RAW_PAGES_SQL)
def _read_raw_pages(spark, sf_dir):
    return read_raw_pages(spark, dump_pages(spark, sf_dir), LINK_PREFIX, glob="*.txt", id_folder="page_id")


@query("raw_pages_newest", f"{RAW_PAGES_SQL} WHERE page_id > greatest(0, (SELECT max(page_id) FROM pages) - 100)")
def _raw_pages_newest(spark, sf_dir):
    """The newest span of ids; other folders of the dump are not opened."""
    span = newest_span(id_bounds(table(spark, sf_dir, "pages"), "page_id")[1], 100)
    return read_raw_pages(spark, dump_pages(spark, sf_dir), LINK_PREFIX, glob="*.txt", span=span, id_folder="page_id")


@query(
    "page_robust",
    f"""WITH {PAGE_ARTICLES_SQL}
        SELECT p.page_id, a.title, a.content FROM pages p
        LEFT JOIN (SELECT * FROM page_articles WHERE id % 5 <> 0) a ON a.id = p.page_id""",
)
def _page_robust(spark, sf_dir):
    """Every fifth page damaged: unusable charsets, a reference beyond all numbers, or bytes that are no text at all."""
    pages = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 5 == 0, (F.expr("page_id div 5") % 3)).otherwise(F.lit(-1))
    raw = pages.select(
        "page_id",
        F.when(kind == 1, F.concat(F.lit('<a href="&#'), F.repeat(F.lit("9"), F.lit(5000)), F.lit(';">'), "html"))
        .otherwise(F.col("html"))
        .cast("binary")
        .alias("body"),
        F.when(kind == 0, "undefined").when(kind == 2, "no\u0000charset").alias("charset"),
    )
    landed = decode_pages(raw, LINK_PREFIX)
    broken = F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-8")).cast("string")
    landed = landed.withColumn("html", F.when(F.col("page_id") % 5 == 4, broken).otherwise(F.col("html")))
    found = extract_articles(landed, LINK_PREFIX).select(F.col("id").alias("page_id"), "title", "content")
    return pages.select("page_id").join(found, "page_id", "left")


# Charsets of the documents of `detect_charset`, by id; a text that its charset cannot hold is left in UTF-8.
ENCODINGS = [
    "utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32-le",
    "windows-1252", "windows-1250", "iso-8859-15", "cp850", "mac-roman", "iso-8859-2",
]


def _encoded(documents, names):
    """Documents as bodies in one of the named charsets."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        bodies = []
        for text, number in zip(texts, numbers):
            try:
                bodies.append(None if text is None else text.encode(names[number]))
            except UnicodeEncodeError:
                bodies.append(text.encode())
        return pd.Series(bodies, dtype=object)

    number = F.pmod("doc_id", F.lit(len(names))).cast("int")
    return documents.withColumn("body", encode(F.col("text"), number)).drop("text")


@query("detect_charset", "SELECT doc_id, text FROM documents")
def _detect_charset(spark, sf_dir):
    """Every document in one of twelve charsets, told from its bytes alone, and decoded."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = CharsetModel(character_pairs(documents))
    raw = _encoded(documents, ENCODINGS).withColumnRenamed("doc_id", "page_id").withColumn("charset", F.lit(None).cast("string"))
    return decode_pages(raw, LINK_PREFIX, model).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


@query("detect_charset_groups", "SELECT doc_id, text FROM documents")
def _detect_charset_groups(spark, sf_dir):
    """Three dumps, each in one charset, judged by the added scores of its pages that are not UTF-8."""
    names = ["windows-1252", "cp850", "mac-roman"]
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = CharsetModel(character_pairs(documents))
    bodies = stored(_encoded(documents, names).withColumn("dump", F.pmod("doc_id", F.lit(len(names)))), "bodies")
    plain = F.is_valid_utf8(F.col("body").cast("string"))
    found = charsets_of_groups(bodies.where(~plain), "dump", "body", model)
    named = bodies.join(found, "dump", "left").withColumn("charset", F.when(~plain, F.col("charset")))
    return named.select("doc_id", decode_body(F.col("body"), F.col("charset")).alias("text"))


# ---- corpora by id -------------------------------------------------------------------


def _clustered(spark, rows):
    """A new table of these articles, with small folders so that there are many."""
    corpus = ClusteredCorpus(f"corpus_{uuid.uuid4().hex}", width=128, buckets=4)
    corpus.append(rows, shared_folder(spark, "clustered"))
    return corpus


@query("clustered_merge", CORPUS_SQL)
def _clustered_merge(spark, sf_dir):
    """One of three articles first, then all of them, one of four twice."""
    rows = articles(spark, sf_dir)
    corpus = _clustered(spark, rows.where("id % 3 = 0"))
    corpus.merge(rows.unionByName(rows.where("id % 4 = 0")), "position")
    return corpus.articles(spark)


@query("clustered_newest", f"{CORPUS_SQL} WHERE id BETWEEN (SELECT max(id) FROM articles) - 299 AND (SELECT max(id) FROM articles)")
def _clustered_newest(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return _clustered(spark, rows).span(spark, *newest_span(id_bounds(rows)[1], 300))


# ---- corpora -------------------------------------------------------------------------


def _round_trip(fmt):
    def run(spark, sf_dir):
        path = shared_folder(spark, "corpus")
        write_articles(articles(spark, sf_dir), path, fmt)
        return read_articles(spark, path, fmt)

    return run


query("write_read_jsonl", CORPUS_SQL)(_round_trip("jsonl"))
query("read_articles", CORPUS_SQL)(_round_trip("json"))


@query("read_article_arrays", CORPUS_SQL)
def _read_article_arrays(spark, sf_dir):
    """Arrays read by byte ranges, one of them damaged and left out."""
    path = shared_folder(spark, "corpus")
    corpus = articles(spark, sf_dir)
    write_articles(corpus, path, "json")
    corpus.limit(1).select(F.lit('[{"title": "cut", "content": "}').alias("value")).write.mode("append").text(path)
    return read_article_arrays(spark, path, broken="skip")


@query("write_read_default", CORPUS_SQL)
def _write_read_default(spark, sf_dir):
    path = shared_folder(spark, "corpus")
    write_articles(articles(spark, sf_dir), path)
    return read_articles(spark, path)


@query(
    "append_corpus",
    f"""WITH {ARTICLES_SQL}, old AS (SELECT * FROM articles WHERE id % 3 = 0)
        SELECT title, content, link, CASE WHEN id % 9 = 0 THEN NULL ELSE id END AS id, date, keywords, category FROM old
        UNION ALL SELECT title, content, link, id, date, keywords, category FROM articles
        WHERE coalesce(id, 0) <> 0 AND id NOT IN (SELECT id FROM old WHERE id % 9 <> 0)""",
)
def _append_corpus(spark, sf_dir):
    """A corpus with ids of a wrong type in some records is read back, and all articles are merged into it, twice in the batch."""
    path = shared_folder(spark, "corpus")
    corpus = articles(spark, sf_dir)
    record = F.to_json(F.struct(*ARTICLE.names))
    wrong = F.regexp_replace(record, '"id":(\\d+)', '"id":"no $1"')
    old = corpus.filter(F.col("id") % 3 == 0).select(F.when(F.col("id") % 9 == 0, wrong).otherwise(record).alias("value"))
    old.write.text(path)
    existing = read_articles_or_empty(spark, path)
    batch = corpus.select(*ARTICLE.names)
    return merge_new(existing, batch.unionByName(batch), "id")


@query("write_read_by_category", CORPUS_SQL)
def _write_read_by_category(spark, sf_dir):
    path = shared_folder(spark, "corpus")
    write_articles(articles(spark, sf_dir), path, "parquet", by_category=True)
    return read_articles(spark, path, "parquet")


@query(
    "read_categories",
    f"{CORPUS_SQL} WHERE coalesce(category, 'Uncategorized') IN ('', 'es', 'Uncategorized')",
)
def _read_categories(spark, sf_dir):
    path = shared_folder(spark, "corpus")
    write_articles(articles(spark, sf_dir), path, "parquet", by_category=True)
    return read_categories(spark, path, ["", "es", "Uncategorized"])


@query("read_articles_or_empty", CORPUS_SQL)
def _read_articles_or_empty(spark, sf_dir):
    """A good corpus, a broken one (each file cut short) and a missing one."""
    good, broken = shared_folder(spark, "arrays"), shared_folder(spark, "broken")
    write_articles(articles(spark, sf_dir), good, "json")
    cut = spark.read.text(good, wholetext=True).select(F.expr("left(value, length(value) - 10)").alias("value"))
    cut.write.text(broken)
    return (
        read_articles_or_empty(spark, good, "json")
        .unionByName(read_articles_or_empty(spark, broken, "json"))
        .unionByName(read_articles_or_empty(spark, f"{broken}-missing", "json"))
    )


@query("export_filtered_file", f"{CORPUS_SQL} WHERE id <> 0 AND category IN ('de', 'es')")
def _export_filtered_file(spark, sf_dir):
    path = shared_folder(spark, "export")
    export_filtered(articles(spark, sf_dir), ["de", "es"], "position", path)
    return read_articles(spark, path)


# ---- vocabulary and report -------------------------------------------------------------


@query(
    "read_category_list",
    """SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS pos, source AS category, CAST(0 AS BIGINT) AS n
       FROM (SELECT DISTINCT source FROM documents)""",
)
def _read_category_list(spark, sf_dir):
    path = shared_folder(spark, "vocabulary")
    names = table(spark, sf_dir, "documents").agg(F.array_sort(F.collect_set("source")).alias("names"))
    names.select(F.to_json("names")).write.text(path)
    return read_category_list(spark, path)


DEFAULT_NAMES_SQL = ", ".join(f"('{name}', {pos})" for pos, name in enumerate(CATEGORY_VOCABULARY))


@query(
    "default_category_list",
    f"""WITH vocabulary(category, pos) AS (VALUES {DEFAULT_NAMES_SQL})
        SELECT v.pos, v.category, count(d.doc_id) AS n
        FROM vocabulary v LEFT JOIN documents d ON d.doc_id % 20 = v.pos GROUP BY v.pos, v.category""",
)
def _default_category_list(spark, sf_dir):
    """Documents dealt to the built-in categories, counted in the order of the list."""
    listed = default_category_list(spark).drop("n")
    dealt = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 20).alias("pos")).agg(F.count("*").alias("n"))
    return listed.join(dealt, "pos", "left").select("pos", "category", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "write_category_report",
    f"""WITH {ARTICLES_SQL} SELECT category, count(*) AS n FROM
        (SELECT coalesce(category, 'Uncategorized') AS category FROM articles) GROUP BY category""",
)
def _write_category_report(spark, sf_dir):
    path = shared_folder(spark, "report")
    write_category_report(category_counts(articles(spark, sf_dir), "position"), "2025-10-10T12:00:00", path)
    report = spark.read.schema("categories map<string, bigint>").json(path)
    return report.select(F.explode("categories").alias("category", "n"))


@query(
    "report_fragments",
    """SELECT 'Customer "' || o_custkey || '", ' || o_orderpriority AS category, count(*) AS n FROM orders GROUP BY ALL""",
)
def _report_fragments(spark, sf_dir):
    """Orders as articles of as many categories as there are customers and priorities."""
    path = shared_folder(spark, "report")
    name = F.concat(F.lit('Customer "'), F.col("o_custkey").cast("string"), F.lit('", '), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select(name.alias("category"), "o_orderkey")
    write_category_report_fragments(category_counts(orders, "o_orderkey"), "2025-10-10T12:00:00", path)
    return read_category_report_fragments(spark, path)


@query(
    "output_names",
    "SELECT event_id, 'articles_' || strftime(ts, '%Y%m%d_%H%M%S') AS name FROM events",
)
def _output_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", output_name_column("articles", F.col("ts")).alias("name"))
