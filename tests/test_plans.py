"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from newsloom.catalog import QUERIES
from newsloom.catalog.fixtures import LINK_PREFIX, articles, turns
from newsloom.operators.categories import category_counts, category_ranking, filter_categories
from newsloom.operators.dedup import dedupe_keep_first, merge_metrics, new_rows, skip_processed
from newsloom.operators.extraction import extract_articles, spread
from newsloom.plans.analysis import pages_to_parse, preset_bounds
from newsloom.sources.readers import read_categories
from newsloom.sources.writers import write_articles

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_id_range_and_columns_reach_the_page_scan(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    text = plan(extract_articles(pages_to_parse(pages, preset_bounds("test", 40)), LINK_PREFIX))
    assert "GreaterThanOrEqual(page_id,1)" in text and "LessThanOrEqual(page_id,40)" in text
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_known_pages_leave_before_parsing(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    existing = pages.select(F.col("page_id").alias("id")).filter("id > 20")
    text = plan(extract_articles(pages_to_parse(pages, (1, 40), existing), LINK_PREFIX))
    tree = text[: text.index("\n\n\n")]
    assert tree.index("MapInArrow") < tree.index("LeftAnti") < tree.index("Scan parquet")


def test_counting_reads_only_what_it_counts(spark):
    text = plan(category_counts(articles(spark, SF_DIR), "position"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    assert "partial_count(1)" in text


def test_metrics_leave_the_payload_alone(spark):
    documents = articles(spark, SF_DIR)
    assert "text" not in plan(merge_metrics(documents, documents))


def test_cleaning_is_not_repeated_by_the_acceptance(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    text = plan(extract_articles(pages, LINK_PREFIX))
    assert "Condition" not in text and text.count("MapInArrow") == 2  # tree and details


def test_extraction_with_large_arrow_strings(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    usual = extract_articles(pages, LINK_PREFIX).count()
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert extract_articles(pages, LINK_PREFIX).count() == usual
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


@pytest.mark.parametrize("rows", ["few repeats", "many repeats"])
def test_keep_first_moves_no_payload_for_few_repeats(spark, rows):
    source = turns(spark, SF_DIR) if rows == "many repeats" else articles(spark, SF_DIR)
    text = plan(dedupe_keep_first(source, "position"))
    assert "SortAggregate" not in text and "Aggregate" not in text
    assert text.count("hashpartitioning") == 0 or rows == "many repeats"


def test_merge_does_not_aggregate_the_batch(spark):
    batch = articles(spark, SF_DIR)
    text = plan(new_rows(batch.select("id").filter("id > 100"), batch, "position"))
    assert "Aggregate" not in text


def test_hot_id_is_split(spark, small_skew):
    first = dedupe_keep_first(hot_corpus(spark).withColumn("position", F.monotonically_increasing_id()), "position")
    assert len(first.collect()) == 40_000  # row 7 has the hot id as well
    assert "skew" in plan(first)


def test_spread_only_moves_rows(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert pages.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert "RoundRobin" in plan(spread(pages))
    assert sorted(map(tuple, spread(pages).collect())) == sorted(map(tuple, pages.collect()))
    wide = pages.repartition(50)
    assert spread(wide) is wide


def test_category_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "corpus")
    write_articles(articles(spark, SF_DIR), path, "parquet", by_category=True)
    text = plan(read_categories(spark, path, ["fr"]))
    assert re.search(r"PartitionFilters: \[[^\]]*category_key", text)
    assert read_categories(spark, path, [""]).filter(F.col("category") != "").count() == 0


@pytest.mark.parametrize("max_literals", [0, 10])
def test_selected_categories_do_not_multiply_rows(spark, max_literals):
    corpus = articles(spark, SF_DIR)
    names = spark.createDataFrame([("en",), ("en",), ("fr",)], "category string")
    chosen = filter_categories(corpus, names, max_literals)
    assert chosen.count() == corpus.filter("category in ('en', 'fr')").count()


@pytest.fixture
def small_skew(spark):
    """Settings under which a few hundred kB count as a skewed partition."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)


def hot_corpus(spark):
    """Of 60,000 rows, a third share a category and an id."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, 60_000, 1, 8).select(
        F.when(hot, 7).otherwise(F.col("id")).alias("id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5000)).alias("category"),
        F.sha2(F.col("id").cast("string"), 256).alias("content"),
    )


def test_hot_category_is_split(spark, small_skew):
    names = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("category"))
    chosen = filter_categories(hot_corpus(spark), names.unionByName(names.limit(1).select(F.lit("hot").alias("category"))), 10)
    rows = chosen.collect()
    assert len(rows) == 20_000 + hot_corpus(spark).filter("category <> 'hot' and int(substr(category, 2)) < 4000").count()
    assert "skew" in plan(chosen)


def test_hot_processed_id_is_split(spark, small_skew):
    done = spark.range(50_000, 60_000).select("id")
    done = done.unionByName(done)
    left = skip_processed(hot_corpus(spark), done)
    assert len(left.collect()) == 60_000 - hot_corpus(spark).filter("id >= 50000").count()
    assert "skew" in plan(left)


def test_pages_stay_in_place_when_few_were_processed(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    done = pages.select("page_id").filter("page_id > 20")
    text = plan(skip_processed(pages, done, "page_id"))
    assert "BroadcastHashJoin LeftAnti" in text and "hashpartitioning" not in text


BATCH_QUERIES = [n for n in QUERIES if not n.startswith(("stream_", "read_", "write_"))]


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    rows = turns(spark, SF_DIR)
    first = {tuple(r) for r in dedupe_keep_first(rows, "position").collect()}
    assert {tuple(r) for r in dedupe_keep_first(rows.repartition(partitions), "position").collect()} == first
    corpus = articles(spark, SF_DIR)
    ranking = category_ranking(category_counts(corpus, "position")).orderBy("rank").collect()
    moved = category_counts(corpus.repartition(partitions), "position")
    assert category_ranking(moved).orderBy("rank").collect() == ranking
