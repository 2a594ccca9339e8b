"""Queries for id ranges, batch plans and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.extraction import PAGE_ARTICLES_SQL, pages
from newsloom.catalog.fixtures import ARTICLES_SQL, LINK_PREFIX, URL_LANGUAGE, articles
from newsloom.catalog.registry import query, table
from newsloom.operators.categories import resolve_picks
from newsloom.operators.extraction import spread
from newsloom.operators.scan import (
    batch_plan,
    batch_progress,
    collect_scan,
    id_bounds,
    id_range,
    newest_first,
    newest_n,
    scan_outcome,
    scan_outcome_runs,
)
from newsloom.plans.analysis import page_scan_report, preset_bounds, range_scan
from newsloom.schema import SCAN_SPANS
from newsloom.sources.readers import vocabulary_ranking

# ---- id ranges -----------------------------------------------------------------


# Order lines, whose ids reach far beyond the largest preset.
LINES_SQL = """lines AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey, l_extendedprice FROM lineitem)"""


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_extendedprice")


def _newest(span):
    def run(spark, sf_dir):
        lines = _lines(spark, sf_dir)
        return newest_n(lines, id_bounds(lines)[1], span)

    return run


for _preset, _span in [*SCAN_SPANS.items(), ("maximum", None)]:
    _low = 1 if _span is None else f"greatest(1, (SELECT max(id) FROM lines) - {_span} + 1)"
    query(
        f"newest_{_preset}",
        f"WITH {LINES_SQL} SELECT * FROM lines WHERE id BETWEEN {_low} AND (SELECT max(id) FROM lines)",
    )(_newest(_span))


@query(
    "id_range",
    f"""WITH {ARTICLES_SQL}, bounds AS (SELECT min(id) AS lo, max(id) AS hi FROM articles)
        SELECT articles.* FROM articles, bounds WHERE id BETWEEN lo + (hi - lo) // 4 AND hi - (hi - lo) // 4""",
)
def _id_range(spark, sf_dir):
    corpus = articles(spark, sf_dir)
    lo, hi = id_bounds(corpus)
    margin = (hi - lo) // 4
    return id_range(corpus, lo + margin, hi - margin)


# ---- plans -----------------------------------------------------------------------

BOUNDS_SQL = "bounds AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents)"


def _plan_sql(batch: str, step: int, reverse: bool) -> str:
    article_id = "hi - scan_no" if reverse else "lo + scan_no"
    return f"""
    {BOUNDS_SQL},
    offsets AS (SELECT unnest(range(hi - lo + 1)) AS scan_no, lo, hi FROM bounds),
    plan AS (
      SELECT scan_no // ({batch}) AS batch_no, scan_no, {article_id} AS id FROM offsets
      WHERE (scan_no % ({batch})) % {step} = 0)
    """


def _plan(spark, sf_dir, batch, step=1, reverse=True):
    lo, hi = id_bounds(table(spark, sf_dir, "documents"), "doc_id")
    return batch_plan(spark, lo, hi, batch, step, reverse)


@query("batch_plan", f"WITH {_plan_sql('50', 3, True)} SELECT batch_no, scan_no, id FROM plan")
def _batch_plan(spark, sf_dir):
    return _plan(spark, sf_dir, 50, 3)


# ---- outcomes ----------------------------------------------------------------------

# Found are the labelled documents; conversation ids were handled before.
SELECTED = ["en", "fr", "Uncategorized"]


def _outcome_sql(plan: str, selected: bool, seen: bool) -> str:
    not_selected = "coalesce(a.category, 'Uncategorized') NOT IN ('en', 'fr', 'Uncategorized')" if selected else "false"
    duplicate = "p.id IN (SELECT conv_id FROM conversations)" if seen else "false"
    return f"""
    {ARTICLES_SQL}, {plan},
    outcome AS (
      SELECT p.batch_no, p.scan_no, p.id,
             CASE WHEN {duplicate} THEN 'duplicate' WHEN a.id IS NULL THEN 'not found'
                  WHEN {not_selected} THEN 'category not selected' ELSE 'found' END AS outcome
      FROM plan p LEFT JOIN (SELECT * FROM articles WHERE id IN (SELECT doc_id FROM labels)) a ON a.id = p.id)
    """


def _found_articles(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return articles(spark, sf_dir).select("id", "category").join(labelled, "id", "left_semi")


def _outcome(spark, sf_dir, selection=None, seen=False, batch=50, step=1):
    handled = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")) if seen else None
    plan = _plan(spark, sf_dir, batch, step)
    return scan_outcome(plan, _found_articles(spark, sf_dir), selection, handled)


@query("scan_outcome", f"WITH {_outcome_sql(_plan_sql('50', 1, True), True, True)} SELECT * FROM outcome")
def _scan_outcome(spark, sf_dir):
    return _outcome(spark, sf_dir, SELECTED, seen=True)


@query("scan_outcome_all", f"WITH {_outcome_sql(_plan_sql('500', 1, True), False, False)} SELECT * FROM outcome")
def _scan_outcome_all(spark, sf_dir):
    return _outcome(spark, sf_dir, batch=500)


PROGRESS_SQL = f"""
{_outcome_sql(_plan_sql('50', 1, True), True, False)},
progress AS (
  SELECT batch_no, ids, found, CAST(sum(found) OVER (ORDER BY batch_no) AS BIGINT) AS found_so_far
  FROM (SELECT batch_no, count(*) AS ids, count(*) FILTER (outcome = 'found') AS found FROM outcome GROUP BY batch_no))
"""


def _progress(spark, sf_dir):
    return batch_progress(_outcome(spark, sf_dir, SELECTED))


@query("batch_progress", f"WITH {PROGRESS_SQL} SELECT * FROM progress")
def _batch_progress(spark, sf_dir):
    return _progress(spark, sf_dir)


@query(
    "scan_outcome_repeats",
    f"""WITH {ARTICLES_SQL}, {_plan_sql('50', 1, True)},
        said AS (SELECT conv_id AS id, arg_min(role, turn) AS category FROM conversations GROUP BY conv_id)
        SELECT p.batch_no, p.scan_no, p.id, CASE WHEN s.id IS NULL THEN 'not found'
               WHEN coalesce(s.category, 'Uncategorized') <> 'user' THEN 'category not selected' ELSE 'found' END AS outcome
        FROM plan p LEFT JOIN said s ON s.id = p.id""",
)
def _scan_outcome_repeats(spark, sf_dir):
    """Turns of conversations as articles: an id comes once per turn, and the first one counts."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.select(F.col("conv_id").alias("id"), F.col("role").alias("category"), "turn")
    return scan_outcome(_plan(spark, sf_dir, 50), said, ["user"], order="turn")


@query(
    "collect_scan",
    f"""WITH {_outcome_sql(_plan_sql('(SELECT hi - lo + 1 FROM bounds)', 3, False), True, False)}
        SELECT scan_no, id, outcome FROM outcome""",
)
def _collect_scan(spark, sf_dir):
    lo, hi = id_bounds(table(spark, sf_dir, "documents"), "doc_id")
    scan = collect_scan(spark, _found_articles(spark, sf_dir), lo, hi, step=3, selection=SELECTED)
    return scan.select("scan_no", "id", "outcome")


def _runs_sql(batch: str, step: int, reverse: bool, selected: bool, seen: bool) -> str:
    return f"""
    WITH {_outcome_sql(_plan_sql(batch, step, reverse), selected, seen)},
    placed AS (SELECT *, row_number() OVER (ORDER BY scan_no) AS no FROM outcome),
    grouped AS (SELECT *, no - row_number() OVER (PARTITION BY outcome ORDER BY scan_no) AS run FROM placed)
    SELECT min(scan_no) AS from_no, arg_min(id, scan_no) AS from_id, arg_max(id, scan_no) AS to_id, count(*) AS ids, outcome
    FROM grouped GROUP BY outcome, run"""


def _runs(spark, sf_dir, batch, step=1, reverse=True, selection=None, seen=False):
    handled = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")) if seen else None
    lo, hi = id_bounds(table(spark, sf_dir, "documents"), "doc_id")
    return scan_outcome_runs(_found_articles(spark, sf_dir), lo, hi, batch, step, reverse, selection, handled)


@query("scan_outcome_runs", _runs_sql("50", 1, True, True, True))
def _scan_outcome_runs(spark, sf_dir):
    return _runs(spark, sf_dir, 50, selection=SELECTED, seen=True)


@query("scan_outcome_runs_steps", _runs_sql("70", 3, False, False, False))
def _scan_outcome_runs_steps(spark, sf_dir):
    """Every third id, oldest first: neighbours in the plan are three ids apart, and less at the end of a batch."""
    return _runs(spark, sf_dir, 70, step=3, reverse=False)


# ---- scans of pages ------------------------------------------------------------------


@query(
    "range_scan",
    f"""WITH {PAGE_ARTICLES_SQL}
        SELECT * FROM page_articles
        WHERE id BETWEEN greatest(1, (SELECT max(page_id) FROM pages) - 999) AND (SELECT max(page_id) FROM pages)
          AND id NOT IN (SELECT conv_id FROM conversations) AND id NOT IN (SELECT doc_id FROM labels)""",
)
def _range_scan(spark, sf_dir):
    """Newest 1,000 ids, without those processed before or already in the corpus."""
    source = table(spark, sf_dir, "pages")
    latest = id_bounds(source, "page_id")[1]
    processed = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"))
    existing = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    bounds = preset_bounds("small", latest)
    return range_scan(spread(source), existing, bounds, LINK_PREFIX, processed=processed)


@query(
    "range_scan_maximum",
    f"WITH {PAGE_ARTICLES_SQL} SELECT * FROM page_articles WHERE id >= 1",
)
def _range_scan_maximum(spark, sf_dir):
    source = table(spark, sf_dir, "pages")
    latest = id_bounds(source, "page_id")[1]
    return range_scan(pages(spark, sf_dir), None, preset_bounds("maximum", latest), LINK_PREFIX)


@query("range_scan_repeats", f"WITH {PAGE_ARTICLES_SQL} SELECT * FROM page_articles WHERE id >= 1")
def _range_scan_repeats(spark, sf_dir):
    """All pages, landed twice by a crawl that was repeated, and one of three a third time: no order tells them apart."""
    source = table(spark, sf_dir, "pages")
    latest = id_bounds(source, "page_id")[1]
    landed = source.unionByName(source).unionByName(source.where("page_id % 3 = 0"))
    return range_scan(spread(landed), None, preset_bounds("maximum", latest), LINK_PREFIX)


def _page_progress_sql(batch: int, reverse: bool) -> str:
    article_id = "hi - scan_no" if reverse else "lo + scan_no"
    return f"""{PAGE_ARTICLES_SQL}, bounds AS (SELECT 1 AS lo, max(page_id) AS hi FROM pages),
        plan AS (SELECT scan_no // {batch} AS batch_no, {article_id} AS id
                 FROM (SELECT unnest(range(hi - lo + 1)) AS scan_no, lo, hi FROM bounds)),
        per_batch AS (SELECT batch_no, count(*) AS ids, count(a.id) AS found
                      FROM plan LEFT JOIN page_articles a USING (id) GROUP BY batch_no),
        progress AS (
          SELECT batch_no, ids, found, CAST(sum(found) OVER (ORDER BY batch_no) AS BIGINT) AS found_so_far
          FROM per_batch)"""


@query("page_scan_progress", f"WITH {_page_progress_sql(50, True)} SELECT * FROM progress")
def _page_scan_progress(spark, sf_dir):
    """All pages in small batches; one page of twenty is there twice."""
    source = table(spark, sf_dir, "pages")
    latest = id_bounds(source, "page_id")[1]
    landed = source.unionByName(source.where("page_id % 20 = 0"))
    bounds = preset_bounds("maximum", latest)
    return page_scan_report(spread(landed), bounds, 50, LINK_PREFIX, reverse=newest_first("A")).progress


@query(
    "page_scan_selection",
    f"""WITH {PAGE_ARTICLES_SQL}, bounds AS (SELECT max(page_id) AS hi FROM pages), listed AS (
          SELECT language, row_number() OVER (ORDER BY language) AS rank FROM
          (SELECT DISTINCT nullif(regexp_extract(url, '{URL_LANGUAGE}', 1), '') AS language FROM pages) WHERE language IS NOT NULL)
        SELECT a.* REPLACE (p.language AS category) FROM page_articles a
        JOIN (SELECT page_id, nullif(regexp_extract(url, '{URL_LANGUAGE}', 1), '') AS language FROM pages) p ON p.page_id = a.id
        WHERE p.language IN (SELECT language FROM listed WHERE rank IN (1, 3))""",
)
def _page_scan_selection(spark, sf_dir):
    """Picks from a vocabulary, here the languages of the addresses, select among the pages scanned."""
    source = table(spark, sf_dir, "pages")
    latest = id_bounds(source, "page_id")[1]
    language = F.nullif(F.regexp_extract("url", URL_LANGUAGE, 1), F.lit(""))
    names = source.agg(F.array_sort(F.collect_set(language)).alias("names"))
    vocabulary = names.select(F.posexplode("names").alias("pos", "category"), F.lit(0).cast("bigint").alias("n"))
    picked = resolve_picks(vocabulary_ranking(vocabulary), "1, 3")
    tagged = F.concat(F.lit('<span itemprop="about">'), language, F.lit("</span>"), F.col("html"))
    pages = source.withColumn("html", F.coalesce(tagged, "html"))
    return range_scan(spread(pages), None, preset_bounds("maximum", latest), LINK_PREFIX, picked)
