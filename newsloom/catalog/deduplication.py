"""Queries for keep-first deduplication and insert-only merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.fixtures import ARTICLES_SQL, TURNS_SQL, articles, turns
from newsloom.catalog.registry import query, table
from newsloom.operators.bitmaps import bitmap_size, id_bitmaps, merge_known, skip_known
from newsloom.operators.dedup import (
    dedupe_keep_first,
    dedupe_metrics,
    merge_metrics,
    merge_new,
    skip_processed,
)
from newsloom.session import stored


@query(
    "dedupe_first",
    f"""WITH {TURNS_SQL}, numbered AS (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS rn FROM turns)
        SELECT title, content, id, position FROM numbered WHERE rn = 1 OR coalesce(id, 0) = 0""",
)
def _dedupe_first(spark, sf_dir):
    return dedupe_keep_first(turns(spark, sf_dir), "position")


@query(
    "dedupe_events",
    """SELECT * EXCLUDE rn FROM (
         SELECT user_id AS id, * EXCLUDE user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
       WHERE rn = 1 OR coalesce(id, 0) = 0""",
)
def _dedupe_events(spark, sf_dir):
    return dedupe_keep_first(table(spark, sf_dir, "events").withColumnRenamed("user_id", "id"), "event_id")


@query(
    "dedupe_metrics",
    f"""WITH {TURNS_SQL}
        SELECT CAST(count(*) FILTER (id <> 0) - count(DISTINCT id) FILTER (id <> 0) AS BIGINT) AS duplicates,
               count(*) AS original,
               CAST(count(DISTINCT id) FILTER (id <> 0) + count(*) FILTER (coalesce(id, 0) = 0) AS BIGINT) AS cleaned
        FROM turns""",
)
def _dedupe_metrics(spark, sf_dir):
    return dedupe_metrics(turns(spark, sf_dir))


# A corpus of the labelled documents meets a batch of all documents and of all
# conversation turns, whose ids repeat and overlap with those of documents.
MERGE_SQL = f"""
{ARTICLES_SQL}, {TURNS_SQL},
existing AS (SELECT id, title, content, position FROM articles WHERE id IN (SELECT doc_id FROM labels)),
batch AS (
  SELECT id, title, content, position FROM articles
  UNION ALL SELECT id + 500, title, content, 1000000000 + position FROM turns
  UNION ALL SELECT id, title, content, 2000000000 + position FROM turns),
fresh AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS rn FROM batch
    WHERE coalesce(id, 0) <> 0 AND id NOT IN (SELECT id FROM existing WHERE coalesce(id, 0) <> 0))
  WHERE rn = 1)
"""


def _merge_inputs(spark, sf_dir):
    columns = ["id", "title", "content", "position"]
    documents = articles(spark, sf_dir).select(columns)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    existing = documents.join(labelled, "id", "left_semi")
    said = turns(spark, sf_dir).select(columns)
    shifted = said.withColumn("id", F.col("id") + 500).withColumn("position", F.col("position") + 1_000_000_000)
    repeated = said.withColumn("position", F.col("position") + 2_000_000_000)
    return existing, documents.unionByName(shifted).unionByName(repeated)


@query(
    "merge_new",
    f"""WITH {MERGE_SQL} SELECT id, title, content, position FROM existing
        UNION ALL SELECT id, title, content, position FROM fresh""",
)
def _merge_new(spark, sf_dir):
    return merge_new(*_merge_inputs(spark, sf_dir), "position")


@query(
    "merge_metrics",
    f"""WITH {MERGE_SQL}
        SELECT (SELECT count(*) FROM fresh) AS saved,
               (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS skipped,
               (SELECT count(*) FROM existing) + (SELECT count(*) FROM fresh) AS total""",
)
def _merge_metrics(spark, sf_dir):
    return merge_metrics(*_merge_inputs(spark, sf_dir))


@query(
    "merge_new_bitmaps",
    f"""WITH {MERGE_SQL} SELECT id, title, content, position FROM existing
        UNION ALL SELECT id, title, content, position FROM fresh""",
)
def _merge_new_bitmaps(spark, sf_dir):
    """The same merge, by the bitmaps of the corpus."""
    existing, batch = _merge_inputs(spark, sf_dir)
    return merge_known(existing, stored(id_bitmaps(existing), "bitmaps"), batch, "position")[0]


@query(
    "skip_processed_bitmaps",
    f"WITH {ARTICLES_SQL} SELECT * FROM articles WHERE id NOT IN (SELECT doc_id FROM labels)",
)
def _skip_processed_bitmaps(spark, sf_dir):
    """Labelled ids as two overlapping bitmap tables, as two epochs leave them."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    parts = id_bitmaps(labelled.where("id % 3 <> 0")).unionByName(id_bitmaps(labelled.where("id % 3 < 2")))
    return skip_known(articles(spark, sf_dir), stored(parts, "bitmaps"))


@query(
    "bitmap_size",
    """SELECT count(DISTINCT l_orderkey) AS ids, count(DISTINCT CASE WHEN l_orderkey > 0 THEN 1 + (l_orderkey - 1) // 32768 ELSE l_orderkey // 32768 END) AS buckets,
              4096 * count(DISTINCT CASE WHEN l_orderkey > 0 THEN 1 + (l_orderkey - 1) // 32768 ELSE l_orderkey // 32768 END) AS bytes FROM lineitem""",
)
def _bitmap_size(spark, sf_dir):
    """Order keys of all lines as a set, with the bytes that it takes."""
    return bitmap_size(id_bitmaps(table(spark, sf_dir, "lineitem"), "l_orderkey"))


@query(
    "skip_processed",
    f"WITH {ARTICLES_SQL} SELECT * FROM articles WHERE id NOT IN (SELECT doc_id FROM labels)",
)
def _skip_processed(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return skip_processed(articles(spark, sf_dir), labelled)


# Turns as articles whose order ties (the half turns of a conversation) or is missing (every seventh conversation).
TIES_SQL = f"""
{TURNS_SQL},
tied AS (SELECT title, content, id, CASE WHEN id % 7 <> 0 THEN position // 2 END AS "order" FROM turns),
old AS (SELECT title, content, id, CAST(NULL AS BIGINT) AS "order" FROM turns WHERE id % 5 = 0),
numbered AS (
  SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY "order" NULLS LAST, title NULLS FIRST, content NULLS FIRST) AS rn FROM tied)
"""


def _tied(spark, sf_dir):
    order = F.when(F.col("id") % 7 != 0, F.expr("position div 2"))
    return turns(spark, sf_dir).select("title", "content", "id", order.alias("order"))


@query(
    "dedupe_ties",
    f"""WITH {TIES_SQL} SELECT title, content, id, "order" FROM numbered WHERE rn = 1 OR coalesce(id, 0) = 0""",
)
def _dedupe_ties(spark, sf_dir):
    return dedupe_keep_first(_tied(spark, sf_dir), "order")


@query(
    "merge_ties",
    f"""WITH {TIES_SQL}
        SELECT title, content, id, "order" FROM old UNION ALL
        SELECT title, content, id, "order" FROM numbered
        WHERE rn = 1 AND id <> 0 AND id NOT IN (SELECT id FROM old WHERE id <> 0)""",
)
def _merge_ties(spark, sf_dir):
    batch = _tied(spark, sf_dir)
    old = batch.where("id % 5 = 0").withColumn("order", F.lit(None).cast("bigint"))
    return merge_new(old, batch, "order")
