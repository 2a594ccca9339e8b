"""Counting, ranking, picks, filters and reports."""

import json

import pytest

from newsloom.operators.categories import (
    category_counts,
    category_ranking,
    category_report,
    category_share,
    corpus_totals,
    filter_categories,
    parse_picks,
    resolve_picks,
)
from newsloom.plans.analysis import category_analysis, post_filter
from newsloom.schema import ARTICLE
from newsloom.sources.writers import output_name, write_category_report

CATEGORIES = ["A", None, "B", "", "A", "B"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(n, c, n) for n, c in enumerate(CATEGORIES, 1)]
    return spark.createDataFrame(rows, "id bigint, category string, position bigint").repartition(3)


@pytest.fixture(scope="module")
def ranking(corpus):
    return category_ranking(category_counts(corpus, "position"))


def test_ranking_and_totals(corpus, ranking):
    rows = [(r.category, r.n) for r in ranking.orderBy("rank").collect()]
    assert rows == [("A", 2), ("B", 2), ("Uncategorized", 1), ("", 1)]
    assert corpus_totals(corpus).first().asDict() == {"articles": 6, "categories": 4}


def test_shares_sum_to_100(corpus):
    shares = category_share(category_counts(corpus)).collect()
    assert sum(r.share for r in shares) == pytest.approx(100)
    assert {r.category: r.share_text for r in shares}["A"] == "33.3"
    assert category_share(category_counts(corpus.limit(0))).collect() == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("all", ["A", "B", "Uncategorized", ""]),
        (" ALL ", ["A", "B", "Uncategorized", ""]),
        ("1,3", ["A", "Uncategorized"]),
        ("3,1,1", ["Uncategorized", "A", "A"]),
        (" 2 , +1", ["B", "A"]),
        ("0,9,-1", []),
        ("1,x", []),
        ("1,,2", []),
        ("", []),
        ("  ", []),
        ("1," + "9" * 30, ["A"]),
    ],
)
def test_picks(ranking, text, expected):
    assert [r.category for r in resolve_picks(ranking, text).orderBy("pos").collect()] == expected


def test_all_is_invalid_where_it_is_not_offered():
    assert parse_picks("all", allow_all=False) is None


@pytest.mark.parametrize("max_literals", [0, 100])
@pytest.mark.parametrize(
    "picks, ids", [("1", [1, 5]), ("3,4", [2, 4]), ("9", [1, 2, 3, 4, 5, 6]), ("all", [1, 2, 3, 4, 5, 6])]
)
def test_filter_by_picks(corpus, ranking, picks, ids, max_literals):
    chosen = filter_categories(corpus, resolve_picks(ranking, picks), max_literals)
    assert sorted(r.id for r in chosen.collect()) == ids


def test_filter_by_names(corpus):
    assert filter_categories(corpus, None) is corpus
    assert filter_categories(corpus, []) is corpus
    assert filter_categories(corpus, [""]).count() == 1


def test_report_keeps_first_seen_order(spark, corpus, tmp_path):
    counts = category_counts(corpus, "position")
    write_category_report(counts, "2025-01-01", str(tmp_path / "report"))
    written = spark.read.text(str(tmp_path / "report")).first().value
    assert list(json.loads(written)["categories"].items()) == [("A", 2), ("Uncategorized", 1), ("B", 2), ("", 1)]
    assert json.loads(written)["total_categories"] == 4
    empty = category_report(counts.limit(0), "2025-01-01").first()
    assert empty.total_categories == 0 and empty.categories == {}


def full(spark, rows):
    data = [("t" * 50, "c" * 50, f"l{i}", i, None, None, c, p) for i, c, p in rows]
    return spark.createDataFrame(data, ARTICLE.simpleString()[7:-1].replace(":", " ") + ", position bigint")


def test_analysis_counts_saved_rows_and_exports_scanned_ones(spark):
    corpus = full(spark, [(1, "A", 1), (2, "B", 2), (2, "A", 3), (3, "B", 4), (500, "C", 5)])
    analysis = category_analysis(corpus, 3, "position", "2025-01-01", "2")
    assert [(r.category, r.n) for r in analysis.listing.orderBy("rank").collect()] == [("B", 2), ("A", 1)]
    # Article 2 is saved under B, but its second row is exported under A.
    assert sorted(r.id for r in analysis.exported.collect()) == [1, 2]
    assert analysis.report.first().total_categories == 2
    assert category_analysis(corpus, 3, "position", "2025-01-01", "x").exported is None


def test_post_filter_reports_all_counts(spark):
    corpus = full(spark, [(1, "A", 1), (None, "A", 2), (2, "B", 3)])
    result = post_filter(corpus, "position", "2025-01-01", "1")
    assert [r.id for r in result.exported.collect()] == [1]
    assert result.report.first().categories == {"A": 2, "B": 1}


def test_output_name():
    from datetime import datetime

    assert output_name("content", datetime(2025, 1, 2, 3, 4, 5)) == "content_20250102_030405"
