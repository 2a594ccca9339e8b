"""Plans, outcomes and progress."""

import pytest

from newsloom.operators.ordering import number_rows, running_total_by
from newsloom.operators.scan import (
    batch_plan,
    batch_progress,
    collect_scan,
    feed_id_range,
    id_bounds,
    newest_first,
    newest_span,
    scan_outcome,
    scan_outcome_runs,
    with_fallback,
)
from newsloom.plans.analysis import preset_bounds
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "arguments, batches",
    [
        ((1, 10, 4, 1, True), [[10, 9, 8, 7], [6, 5, 4, 3], [2, 1]]),
        ((1, 10, 4, 3, True), [[10, 7], [6, 3], [2]]),
        ((1, 10, 4, 1, False), [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10]]),
        ((1, 10, 4, 3, False), [[1, 4], [5, 8], [9]]),
        ((5, 4, 4, 1, True), []),
    ],
)
def test_batch_plan(spark, arguments, batches):
    rows = batch_plan(spark, *arguments).orderBy("scan_no").collect()
    found = [[r.id for r in rows if r.batch_no == b] for b in range(len(batches))]
    assert found == batches and len(rows) == sum(map(len, batches))


def test_newest_span():
    assert newest_span(1000, 100) == (901, 1000)
    assert newest_span(50, 100) == (1, 50)
    assert newest_span(50, None) == (1, 50)


def test_choices():
    assert [newest_first(c) for c in ("A", "b ", "", "x")] == [True, False, True, True]
    assert preset_bounds("medium", 200_000) == (190_001, 200_000)
    assert preset_bounds("maximum", 7) == (1, 7)


def test_feed_fallback(spark):
    ids = spark.createDataFrame([(4,), (9,), (4,)], "id bigint")
    assert tuple(with_fallback(feed_id_range(ids)).first()) == (9, 4, 3)
    assert tuple(feed_id_range(ids.limit(0)).first()) == (None, None, 0)
    assert tuple(with_fallback(feed_id_range(ids.limit(0))).first()) == (200_000, 1, 0)
    assert id_bounds(ids.limit(0)) == (None, None)


def test_outcome_of_each_id(spark):
    articles = spark.createDataFrame([(1, "A"), (2, None), (3, ""), (4, "B"), (9, "A")], "id bigint, category string")
    seen = spark.createDataFrame([(1,), (1,), (5,)], "id bigint")
    plan = batch_plan(spark, 1, 5, 2)
    outcome = {r.id: r.outcome for r in scan_outcome(plan, articles, ["A", "Uncategorized"], seen).collect()}
    assert outcome == {
        1: "duplicate", 2: "found", 3: "category not selected", 4: "category not selected", 5: "duplicate",
    }
    unfiltered = {r.id: r.outcome for r in scan_outcome(plan, articles).collect()}
    assert unfiltered == {1: "found", 2: "found", 3: "found", 4: "found", 5: "not found"}
    assert {r.id for r in collect_scan(spark, articles, 1, 5, step=2).collect()} == {1, 3, 5}


def test_repeated_articles_count_once(spark):
    articles = spark.createDataFrame([(1, "B", 2), (1, "A", 1), (1, "A", 3), (2, "B", 1)], "id bigint, category string, position bigint")
    plan = batch_plan(spark, 1, 3, 2)
    outcome = scan_outcome(plan, articles, ["A"], order="position").orderBy("id").collect()
    assert [r.outcome for r in outcome] == ["found", "category not selected", "not found"]
    assert [r.found for r in batch_progress(scan_outcome(plan, articles)).orderBy("batch_no").collect()] == [1, 1]


def test_progress_of_a_long_scan(spark):
    outcome = batch_plan(spark, 1, 3000, 7).withColumn(
        "outcome", F.when(F.col("id") % 3 == 0, "found").otherwise("not found")
    )
    rows = batch_progress(outcome).orderBy("batch_no").collect()
    total = 0
    for row in rows:
        total += row.found
        assert row.found_so_far == total
    assert total == 1000 and sum(r.ids for r in rows) == 3000


def test_running_total_crosses_buckets(spark):
    rows = spark.range(0, 5000, 7).withColumn("v", F.col("id") % 5)
    result = running_total_by(rows, F.col("v"), "id", "total", bucket_bits=6).orderBy("id").collect()
    total = 0
    for row in result:
        total += row.v
        assert row.total == total


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(5000).select((F.col("id") % 97).alias("v"), F.col("id").alias("w")).repartition(5)
    numbered, total = number_rows(rows, [F.desc("v"), "w"], "no")
    found = numbered.orderBy("no").collect()
    assert total == 5000 and [r.no for r in found] == list(range(5000))
    assert [(r.v, r.w) for r in found] == sorted(((r.v, r.w) for r in found), key=lambda x: (-x[0], x[1]))
    ties, total = number_rows(rows.select(F.lit(1).alias("v")), ["v"], "no")
    assert total == 5000 and sorted(r.no for r in ties.collect()) == list(range(5000))
    assert number_rows(rows.limit(0), ["v"], "no")[1] == 0


def _expanded(runs, min_id, max_id, batch, step, reverse):
    """Outcome of each planned id by runs, which must follow each other and differ."""
    planned = [n for n in range(max(0, max_id - min_id + 1)) if n % batch % step == 0]
    outcomes = []
    for run in sorted(runs):
        assert planned[len(outcomes)] == run.from_no and (not outcomes or outcomes[-1] != run.outcome)
        outcomes += [run.outcome] * run.ids
        ends = [run.from_no, planned[len(outcomes) - 1]]
        assert [run.from_id, run.to_id] == [max_id - n if reverse else min_id + n for n in ends]
    assert len(outcomes) == len(planned)
    return dict(zip(planned, outcomes, strict=True))


@pytest.mark.parametrize("bits", [0, 1, 3, 20])
@pytest.mark.parametrize("plan", [(1, 60, 7, 1, True), (1, 60, 7, 3, True), (5, 58, 100, 2, False), (-9, 40, 4, 1, False)])
def test_runs_equal_the_expanded_plan(spark, bits, plan):
    ids = [*range(3, 21), 21, 21, 25, 26, 27, 40, 41, 58, 59, 60, 61, 400, None]
    rows = [(i, "BA"[i % 7 == 0] if i and i > 10 else "A", -(i or 0)) for i in ids] + [(21, "A", -50), (26, None, 3)]
    articles = spark.createDataFrame(rows, "id bigint, category string, at bigint")
    seen = spark.createDataFrame([(5,), (5,), (6,), (30,), (31,), (None,)], "id bigint")
    for selection, handled, order in [(["A"], seen, "at"), (None, None, None)]:
        runs = scan_outcome_runs(articles, *plan, selection, handled, order, bits).collect()
        outcome = scan_outcome(batch_plan(spark, *plan), articles, selection, handled, order).collect()
        assert _expanded(runs, *plan) == {r.scan_no: r.outcome for r in outcome}


def test_runs_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, category string")
    assert [tuple(r) for r in scan_outcome_runs(none, 1, 10**15, 50).collect()] == [(0, 10**15, 1, 10**15, "not found")]
    assert scan_outcome_runs(none, 5, 4, 50).collect() == []
    one = spark.createDataFrame([(10**14, "A")], "id bigint, category string")
    runs = sorted(scan_outcome_runs(one, 1, 10**15, 50, reverse=False).collect())
    assert [(r.from_id, r.to_id) for r in runs] == [(1, 10**14 - 1), (10**14, 10**14), (10**14 + 1, 10**15)]
