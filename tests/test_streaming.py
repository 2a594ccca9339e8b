"""Streams give what the batch operators give, and restarts add nothing."""

import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from newsloom.catalog.incremental import page_to_article
from newsloom.operators.bitmaps import bitmap_size
from newsloom.operators.dedup import first_per_id
from newsloom.plans.analysis import range_scan
from newsloom.sources.readers import read_pages, stream_feed_items, stream_raw_pages
from newsloom.streaming.ingest import (
    append_stream,
    latest_category_counts,
    latest_feed_ranges,
    read_corpus,
    read_passed,
    stream_category_counts,
    stream_feed_range,
    stream_ingest,
    stream_pages,
    stream_pass_once,
    stream_skip_processed,
)

PAGE = "page_id bigint, url string, html string"


def page(i, text):
    words = f"{text} " * 20
    return (i, "u", f"<h1>{words}</h1><article>{words}</article>")


def land(spark, path, *pages):
    spark.createDataFrame(list(pages), PAGE).coalesce(1).write.mode("append").parquet(path)


def ingest(spark, root, files_per_batch=1):
    query = stream_ingest(
        stream_pages(spark, f"{root}/landed", files_per_batch), page_to_article, f"{root}/corpus", f"{root}/checkpoint"
    )
    query.awaitTermination()
    rows = read_corpus(spark, f"{root}/corpus").collect()
    return sorted((r.id, r.title.split()[0]) for r in rows)


def test_ingest_keeps_the_first_and_resumes(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/landed", page(3, "alpha"), page(2, "alpha"), (1, "u", "<p>too short</p>"))
    assert ingest(spark, root) == [(2, "alpha"), (3, "alpha")]
    assert ingest(spark, root) == [(2, "alpha"), (3, "alpha")]
    land(spark, f"{root}/landed", page(3, "beta"), page(1, "beta"), page(0, "beta"))
    land(spark, f"{root}/landed", page(1, "gamma"), page(9, "gamma"))
    assert ingest(spark, root) == [(1, "beta"), (2, "alpha"), (3, "alpha"), (9, "gamma")]


def test_earliest_landed_page_wins_within_a_batch(spark, tmp_path):
    root = str(tmp_path)
    for n, word in enumerate(["alpha", "beta", "gamma"]):
        land(spark, f"{root}/landed", page(7, word), page(7, f"{word}-again"), page(8 + n, word))
        time.sleep(0.05)
    assert ingest(spark, root, 10) == [(7, "alpha"), (8, "alpha"), (9, "beta"), (10, "gamma")]
    pages = read_pages(spark, f"{root}/landed", "position")
    found = range_scan(pages, None, (1, 10), "https://h.cz/?id=", order="position").collect()
    assert sorted((r.id, r.title.split()[0]) for r in found) == [
        (7, "alpha"), (8, "alpha"), (9, "beta"), (10, "gamma"),
    ]


def test_runs_with_their_own_checkpoints_share_a_corpus(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/landed", page(1, "alpha"), page(2, "alpha"))
    ingest(spark, root)
    land(spark, f"{root}/other", page(2, "beta"), page(3, "beta"))
    for _ in range(2):  # the second time with nothing new
        stream_ingest(
            stream_pages(spark, f"{root}/other", 1), page_to_article, f"{root}/corpus", f"{root}/second"
        ).awaitTermination()
        rows = read_corpus(spark, f"{root}/corpus").collect()
        assert sorted((r.id, r.title.split()[0]) for r in rows) == [(1, "alpha"), (2, "alpha"), (3, "beta")]


def test_a_repeated_epoch_replaces_its_own_output(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/landed", page(1, "alpha"))
    ingest(spark, root)
    # Without its commit the epoch runs again, as after a crash.
    for commit in Path(root, "checkpoint/commits").iterdir():
        commit.unlink()
    assert ingest(spark, root) == [(1, "alpha")]


def test_ingest_equals_batch(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(5).write.parquet(f"{root}/landed")
    positioned = pages.withColumn("position", F.col("page_id"))
    expected = first_per_id(page_to_article(positioned).filter("id <> 0"), "position").select("id").collect()
    assert [i for i, _ in ingest(spark, root)] == sorted(r.id for r in expected)


def test_skip_processed_once_per_run(spark, tmp_path):
    root, schema = str(tmp_path), "page_id bigint"
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    append_stream(stream_skip_processed(rows), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    assert sorted(r.page_id for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3]


def folders(path):
    return sorted((int(p.parent.name.split("=")[1]), int(p.name.split("=")[1])) for p in Path(path).glob("run=*/level=*/first=*"))


def land_categories(spark, path, *batches):
    for rows in batches:
        df = spark.createDataFrame(rows, "id bigint, category string")
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def count(spark, root, order=None):
    rows = spark.readStream.schema("id bigint, category string").option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    stream_category_counts(rows, f"{root}/counts", f"{root}/checkpoint", order).awaitTermination()
    return sorted(tuple(r) for r in latest_category_counts(spark, f"{root}/counts", "bigint" if order else None).collect())


def test_category_counts_grow_by_levels(spark, tmp_path):
    """Each epoch writes its own counts; eight of them become one folder, which the next epoch clears away."""
    root = str(tmp_path)
    land_categories(spark, f"{root}/landed", [(9, "A"), (2, None)], *([(10 + k, "A")] for k in range(6)))
    assert count(spark, root, "id") == [("A", 7, 9), ("Uncategorized", 1, 2)]
    assert folders(f"{root}/counts") == [(0, k) for k in range(7)]
    land_categories(spark, f"{root}/landed", [(1, "B")])
    assert count(spark, root, "id") == [("A", 7, 9), ("B", 1, 1), ("Uncategorized", 1, 2)]
    assert folders(f"{root}/counts") == [*((0, k) for k in range(8)), (1, 0)]
    land_categories(spark, f"{root}/landed", [(0, "B")])
    assert count(spark, root, "id") == [("A", 7, 9), ("B", 2, 0), ("Uncategorized", 1, 2)]
    assert folders(f"{root}/counts") == [(0, 8), (1, 0)]
    # What an epoch writes has the size of its own categories.
    assert spark.read.parquet(*map(str, Path(root, "counts").glob("run=*/level=0/first=8"))).count() == 1


def test_a_repeated_epoch_merges_again(spark, tmp_path):
    root = str(tmp_path)
    land_categories(spark, f"{root}/landed", *([(k, "A")] for k in range(8)))
    assert count(spark, root) == [("A", 8)]
    # Without its commit the epoch that merged runs again, as after a crash.
    Path(root, "checkpoint/commits/7").unlink()
    for crc in Path(root, "checkpoint/commits").glob(".7.crc"):
        crc.unlink()
    assert count(spark, root) == [("A", 8)]
    land_categories(spark, f"{root}/landed", [(9, "A")])
    assert count(spark, root) == [("A", 9)]


def test_ingest_compacts_epochs(spark, tmp_path):
    root = str(tmp_path)
    for k in range(9):
        land(spark, f"{root}/landed", page(20 + k, f"alpha{k}"), page(20, "again"))
        time.sleep(0.02)
    assert ingest(spark, root) == [(20 + k, f"alpha{k}") for k in range(9)]
    assert folders(f"{root}/corpus/articles") == folders(f"{root}/corpus/ids") == [(0, 8), (1, 0)]


def test_pass_once_keeps_ids_as_bits(spark, tmp_path):
    root, schema = str(tmp_path), "page_id bigint, at int"
    batches = [[(1, 5), (1, 4), (None, 1), (2, 1)], [(2, 0), (3, 1), (3, 1)], [(40_000_000_000, 1), (-5, 2), (1, 0)], [(-5, 1), (40_000_000_000, 0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/landed")
        time.sleep(0.02)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    for _ in range(2):  # a restart adds nothing
        stream_pass_once(rows, f"{root}/out", f"{root}/checkpoint", "at").awaitTermination()
        passed = read_passed(spark, f"{root}/out", rows.schema)
        assert sorted(tuple(r) for r in passed.collect()) == [(-5, 2), (1, 4), (2, 1), (3, 1), (40_000_000_000, 1)]
    ids = spark.read.parquet(*map(str, Path(root, "out/ids").glob("run=*/level=*/first=*")))
    assert bitmap_size(ids).first().asDict() == {"ids": 5, "buckets": 3, "bytes": 3 * 4096}


def test_raw_pages_as_a_stream(spark, tmp_path):
    """A dump that grows is read file by file, those of the span only; a restart reads none again."""
    dump, out, checkpoint = (str(tmp_path / name) for name in ("dump", "out", "checkpoint"))
    Path(dump).mkdir()

    def run():
        pages = stream_raw_pages(spark, dump, "u", span=(2, 30), files_per_batch=1)
        append_stream(pages, out, checkpoint).awaitTermination()
        return sorted((r.page_id, r.html) for r in spark.read.parquet(out).collect())

    for number in (1, 2, 3):
        Path(dump, f"{number}.html").write_text(f"page {number}")
    assert run() == [(2, "page 2"), (3, "page 3")]
    Path(dump, "p-030.html").write_text("page 30")
    Path(dump, "31.html").write_text("page 31")
    assert run() == run() == [(2, "page 2"), (3, "page 3"), (30, "page 30")]
    positions = spark.read.parquet(out).orderBy("position").collect()
    assert [r.page_id for r in positions][-1] == 30


def test_raw_pages_in_folders_by_id_as_a_stream(spark, tmp_path):
    """Folders named by id are no partitions for the driver to keep, and small files make neither as many tasks nor as many outputs."""
    dump = tmp_path / "dump"
    names = [*range(40 * spark.sparkContext.defaultParallelism), -7, "007000", "__HIVE_DEFAULT_PARTITION__"]
    for name in names:
        Path(dump, f"an id+é={name}", "part").mkdir(parents=True)
        Path(dump, f"an id+é={name}", "part", "page.txt").write_text(f"page {name}")
        Path(dump, f"an id+é={name}", "page.html").write_text("not of this glob")
    Path(dump, "page.txt").write_text("in no folder of an id")

    def run(name, **more):
        pages = stream_raw_pages(spark, str(dump), "u", glob="*.txt", id_folder="an id+é", files_per_batch=1000, **more)
        relation = next(line for line in str(pages._jdf.queryExecution().analyzed()).splitlines() if "StreamingRelation" in line)
        assert "content" in relation.rpartition("[")[2] and " id" not in relation.rpartition("[")[2], relation
        append_stream(pages, str(tmp_path / name), str(tmp_path / f"{name}-progress")).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    pages = run("all")
    ids = [None if str(n).startswith("_") else int(n) for n in names]
    assert sorted(map(tuple, pages.select("html", "page_id", "url").collect())) == sorted((f"page {n}", i, None if i is None else f"u{i}") for n, i in zip(names, ids))
    assert len(list(Path(tmp_path, "all").glob("*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism
    # Files beyond a span are not opened: this one is too long to be read.
    os.truncate(Path(dump, "an id+é=9", "part", "page.txt"), 3 << 30)
    assert sorted(r.page_id for r in run("some", span=(10, 20)).collect()) == list(range(10, 21))


def feed(path, *links):
    path.parent.mkdir(parents=True, exist_ok=True)
    items = "".join(f"<item><title>t</title>{f'<link>{x}</link>' if x else ''}</item>" for x in links)
    path.write_text(f"<rss><channel>{items}</channel></rss>")


def test_feed_ranges_with_late_snapshots(spark, tmp_path):
    """Ranges cover all snapshots, whatever the order they land in; a restart counts none again."""
    feeds, ranges, checkpoint = (str(tmp_path / name) for name in ("feeds", "ranges", "checkpoint"))

    def run():
        stream_feed_range(stream_feed_items(spark, feeds, 1), ranges, checkpoint, "h.cz").awaitTermination()
        return sorted(map(tuple, latest_feed_ranges(spark, ranges).collect()))

    feed(Path(feeds, "a b+c", "1.xml"), "https://h.cz/?id=50", "https://h.cz/?id=48", "https://h.cz/?id=0", "")
    feed(Path(feeds, "other", "1.xml"), "https://elsewhere.cz/?id=7", None)
    assert run() == [("a b+c", 50, 48, 2, 1), ("other", None, None, 0, 1)]
    for n in range(9):  # more epochs than a level holds
        feed(Path(feeds, "a b+c", f"later-{n}.xml"), f"https://h.cz/?id={60 + n}")
    feed(Path(feeds, "a b+c", "0.xml"), "https://h.cz/?id=50", "https://h.cz/?id=12")  # an old snapshot that lands last
    assert run() == run() == [("a b+c", 68, 12, 13, 11), ("other", None, None, 0, 1)]


def test_a_backlog_is_caught_up_with_in_a_fixed_number_of_epochs(spark, tmp_path):
    """The epochs of a backlog do not grow with its files, and neither do the tasks that list them."""
    from newsloom.streaming.ingest import BACKLOG_EPOCHS, files_per_epoch

    assert files_per_epoch(80, 40) == 40
    assert all(-(-n // files_per_epoch(n, 40)) <= BACKLOG_EPOCHS for n in (400, 401, 41_000, 246_000))
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.xml").write_text("<rss/>")
    stream_feed_items(spark, str(tmp_path))
    listing = int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"))
    assert listing <= 8 * spark.sparkContext.defaultParallelism
