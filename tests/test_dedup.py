"""Keep-first and merge semantics."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from newsloom.operators.bitmaps import id_bitmaps, merge_known, skip_known
from newsloom.operators.dedup import (
    dedupe_keep_first,
    dedupe_metrics,
    first_per_id,
    merge_metrics,
    merge_new,
    skip_processed,
)

SCHEMA = "id bigint, position bigint, text string"


def corpus(spark, ids, start=1):
    rows = [(i, n, f"row {n}") for n, i in enumerate(ids, start)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def positions(df):
    return sorted(row.position for row in df.collect())


IDS = [1, 2, 1, None, 0, None]


def test_falsy_ids_survive_dedupe_but_not_merge(spark):
    df = corpus(spark, IDS)
    assert positions(dedupe_keep_first(df, "position")) == [1, 2, 4, 5, 6]
    assert dedupe_metrics(df).first().asDict() == {"duplicates": 1, "original": 6, "cleaned": 5}
    empty = spark.createDataFrame([], SCHEMA)
    assert positions(merge_new(empty, df, "position")) == [1, 2]
    assert merge_metrics(empty, df).first().asDict() == {"saved": 2, "skipped": 4, "total": 2}


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedupe_metrics(empty).first().asDict() == {"duplicates": 0, "original": 0, "cleaned": 0}
    assert merge_metrics(empty, empty).first().asDict() == {"saved": 0, "skipped": 0, "total": 0}


def test_existing_rows_are_never_updated_nor_cleaned(spark):
    existing, batch = corpus(spark, [7, 7, None, 3], 100), corpus(spark, [7, 3, 8, 8])
    merged = merge_new(existing, batch, "position")
    assert positions(merged) == [3, 100, 101, 102, 103]
    assert merge_metrics(existing, batch).first().asDict() == {"saved": 1, "skipped": 3, "total": 5}


def test_merge_is_idempotent(spark):
    existing, batch = corpus(spark, [1, 5], 100), corpus(spark, [5, 6, 6, 7, 0])
    once = merge_new(existing, batch, "position")
    assert positions(merge_new(once, batch, "position")) == positions(once)


def test_skip_processed(spark):
    done = spark.createDataFrame([(1,), (1,), (4,)], "id bigint")
    assert positions(skip_processed(corpus(spark, [1, 2, 4, 4, 2]), done)) == [2, 5]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=40), st.lists(st.integers(0, 9), max_size=10))
def test_against_plain_python(spark, ids, known):
    df, existing = corpus(spark, ids), corpus(spark, known, 1000)
    seen, kept, fresh = set(), [], []
    for n, i in enumerate(ids, 1):
        if not i or i not in seen:
            kept.append(n)
        if i and i not in seen and i not in known:
            fresh.append(n)
        seen.add(i)
    assert positions(dedupe_keep_first(df, "position")) == kept
    merged = merge_new(existing, df, "position")
    assert positions(merged) == sorted(fresh + list(range(1000, 1000 + len(known))))
    assert merge_metrics(existing, df).first().asDict() == {
        "saved": len(fresh), "skipped": len(ids) - len(fresh), "total": len(known) + len(fresh),
    }


@pytest.mark.parametrize("hot", [5, None, 0])
def test_hot_id_does_not_reach_one_task_whole(spark, hot):
    """A third of all rows share an id: at most one row per map task is shuffled."""
    rows = spark.range(30_000).selectExpr(
        f"if(id % 3 = 0, {'null' if hot is None else hot}, id + 100) as id", "id as position", "'x' as text"
    )
    result = dedupe_keep_first(rows, "position")
    assert result.count() == (20_001 if hot else 30_000)


def least(rows):
    """First of (order, text) rows as documented: by order, NULL last, then by text, NULL first."""
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 2)), st.sampled_from([None, "", "a", "b"])
        ),
        max_size=40,
    ),
    st.lists(st.integers(0, 4), max_size=3),
)
def test_ties_and_missing_orders_against_plain_python(spark, rows, known):
    """One row per id whatever ties: the least order, then the least row."""
    schema = "id bigint, order int, text string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    existing = spark.createDataFrame([(i, None, "old") for i in known], schema)
    groups = {}
    for i, order, text in rows:
        groups.setdefault(i, []).append((order, text))
    first = {i: (i, *least(found)) for i, found in groups.items()}
    without = [tuple(r) for r in rows if not r[0]]
    key = repr
    got = [tuple(r) for r in dedupe_keep_first(df, "order").collect()]
    assert sorted(got, key=key) == sorted(without + [r for i, r in first.items() if i], key=key)
    got = [tuple(r) for r in first_per_id(df, "order").collect()]
    assert sorted(got, key=key) == sorted(first.values(), key=key)
    got = [tuple(r) for r in merge_new(existing, df, "order").collect()]
    fresh = [r for i, r in first.items() if i and i not in known]
    assert sorted(got, key=key) == sorted([(i, None, "old") for i in known] + fresh, key=key)


def test_columns_without_an_order_are_carried(spark):
    rows = spark.sql("select 1L as id, 1 as at, map('k', v) as extra from values ('a'), ('a') as t(v)")
    assert [tuple(r) for r in dedupe_keep_first(rows, "at").collect()] == [(1, 1, {"k": "a"})]


def test_hot_ties_are_reduced_before_they_are_shuffled(spark):
    """All rows share an id and an order: one candidate per task reaches the reducer."""
    rows = spark.range(0, 40_000, 1, 8).selectExpr("1L as id", "0 as at", "id % 9 as payload")
    result = first_per_id(rows, "at")
    assert [tuple(r) for r in result.collect()] == [(1, 0, 0)]


def test_bitmaps_know_exactly_their_ids(spark):
    """Ids at the edges of bytes and buckets, negative and very large ones."""
    ids = [-32769, -32768, -32767, -8, -1, 0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 2**40, 2**62]
    around = sorted({i + d for i in ids for d in (-2, -1, 0, 1, 2)})
    df = spark.createDataFrame([(i,) for i in [*around, None]], "id bigint")
    bitmaps = id_bitmaps(spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "id bigint"))
    left = [r.id for r in skip_known(df, bitmaps).collect()]
    assert sorted(i for i in left if i is not None) == [i for i in around if i not in ids]
    assert left.count(None) == 1


def test_merge_by_bitmaps_equals_merge(spark):
    existing, batch = corpus(spark, [7, 7, None, 3], 100), corpus(spark, [7, 3, 8, 8, 0, None, 40_000])
    merged, added = merge_known(existing, id_bitmaps(existing), batch, "position")
    assert positions(merged) == positions(merge_new(existing, batch, "position"))
    assert positions(skip_known(batch, added)) == [1, 2, 5, 6]
