"""Corpora laid out by id, and reports in fragments."""

import json
import os
import uuid

import pytest
from newsloom.schema import ARTICLE
from newsloom.session import shared_folder
from newsloom.sources.clustered import ClusteredCorpus
from newsloom.sources.writers import read_category_report_fragments, write_category_report_fragments
from pyspark.sql import functions as F


def _articles(spark, ids, title="t"):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    others = [F.lit(title if c == "title" else None).cast(ARTICLE[c].dataType).alias(c) for c in ARTICLE.names if c != "id"]
    return rows.select("id", *others).select(*ARTICLE.names)


@pytest.fixture(params=[100, 128])
def corpus(spark, request):
    made = ClusteredCorpus(f"corpus_{uuid.uuid4().hex}", width=request.param, buckets=4)
    made.append(_articles(spark, [*range(1, 1001), -3, None]), shared_folder(spark, "clustered"))
    return made


def test_spans_open_only_their_folders(spark, corpus):
    span = corpus.span(spark, 512, 520)
    assert sorted(r.id for r in span.collect()) == list(range(512, 521))
    files = span.select(F.input_file_name().alias("f")).distinct().collect()
    assert {f.f.split("id_range=")[1].split("/")[0] for f in files} == {str(512 // corpus.width)}
    assert "PartitionFilters: [isnotnull(id_range" in span._jdf.queryExecution().toString()
    assert [r.id for r in corpus.span(spark, -5, 0).collect()] == [-3]


def test_merging_does_not_move_the_corpus(spark, corpus):
    batch = _articles(spark, [5, 5, 0, None, 1000, 1001, 1001, 5000], "new").withColumn("at", F.lit(1))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = corpus.span(spark, 1, 5000).select("id")
        plan = batch.join(known, "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    assert sorted(r.id for r in corpus.merge(batch, "at").collect()) == [1001, 5000]
    assert corpus.merge(batch, "at").count() == 0
    rows = corpus.articles(spark)
    assert (rows.count(), rows.where("title = 'new'").count(), rows.where("id IS NULL").count()) == (1004, 2, 1)
    assert corpus.merge(batch.limit(0), "at").count() == 0


def test_new_rows_keep_the_first_by_order(spark, corpus):
    first = _articles(spark, [2000], "first").withColumn("at", F.lit(1))
    later = _articles(spark, [2000], "later").withColumn("at", F.lit(2))
    assert [r.title for r in corpus.merge(later.unionByName(first), "at").collect()] == ["first"]


@pytest.mark.parametrize("names", [[], ["one"], ['quo"te', "", "}}", "a,", "{", "line\nend", "ü\\", *map(str, range(300))]])
def test_fragments_are_one_document(spark, names):
    rows = [(name, i + 1, i) for i, name in enumerate(names)]
    counts = spark.createDataFrame(rows, "category string, n bigint, first_seen bigint").repartition(5)
    path = shared_folder(spark, "report")
    write_category_report_fragments(counts, "2025-10-10T12:00:00", path)
    folder = f"{path}/fragments"
    files = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    text = "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in files)
    document = json.loads(text)
    assert document["analysis_date"] == "2025-10-10T12:00:00" and document["total_categories"] == len(names)
    assert list(document["categories"].items()) == [(name, n) for name, n, _ in rows]
    assert {(r.category, r.n) for r in read_category_report_fragments(spark, path).collect()} == {(name, n) for name, n, _ in rows}
    manifest = spark.read.json(f"{path}/manifest").collect()
    assert {m.file: m.bytes for m in manifest} == {f: os.path.getsize(f"{folder}/{f}") for f in files if os.path.getsize(f"{folder}/{f}")}
    assert sum(m.lines for m in manifest) == max(1, len(names)) and (len(names) < 100 or len(manifest) > 1)


def test_tasks_grow_with_the_articles_not_with_the_buckets(spark, corpus, monkeypatch):
    """Neither a write nor a merge sends articles to one task a bucket; a folder's bucket stays one file a write."""
    from newsloom.sources import clustered

    monkeypatch.setattr(clustered, "TASK_ROWS", 100)
    batch = _articles(spark, [*range(900, 3001), None], "new").withColumn("at", F.lit(1))
    plan = corpus.new_rows(batch, "at")._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(id, {corpus.buckets})" not in plan and "Bucketed: true" not in plan, plan
    seen = []
    real = type(batch).repartition
    monkeypatch.setattr(type(batch), "repartition", lambda self, number, *columns: seen.append(number) or real(self, number, *columns))
    fresh = corpus.merge(batch, "at")
    assert seen == [20] and fresh.count() == 2000
    files = corpus.span(spark, 2600, 2699).where("title = 'new'").groupBy(F.input_file_name().alias("f")).agg(F.collect_set(F.pmod(F.hash("id"), F.lit(4))).alias("b")).collect()
    assert all(len(f.b) == 1 for f in files) and len(files) <= 4 * (2699 // corpus.width - 2600 // corpus.width + 1)


def test_articles_without_an_id_are_written_by_many_tasks(spark):
    made = ClusteredCorpus(f"corpus_{uuid.uuid4().hex}", width=100, buckets=4)
    rows = spark.range(400).select(*(F.col("id").cast("string").alias(c) if c == "title" else F.lit(None).cast(ARTICLE[c].dataType).alias(c) for c in ARTICLE.names))
    made.append(rows, shared_folder(spark, "clustered"))
    assert made.articles(spark).count() == 400
    assert made.articles(spark).select(F.input_file_name()).distinct().count() > 1
