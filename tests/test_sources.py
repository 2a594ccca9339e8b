"""Readers and writers on files."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.functions.decode import decode_body
from newsloom.operators.dedup import dedupe_keep_first
from newsloom.operators.scan import feed_id_range, feed_ids
from newsloom.sources.readers import (
    default_category_list,
    id_globs,
    read_articles,
    read_articles_or_empty,
    read_categories,
    read_category_list,
    read_feed_items,
    read_raw_pages,
    vocabulary_ranking,
)
from newsloom.sources.writers import output_name_column, output_summary, write_articles
from newsloom.operators.categories import category_counts, category_ranking, resolve_picks
from newsloom.schema import ARTICLE
from newsloom.session import scratch, stored

RECORD = {
    "title": "Titulek", "content": "Obsah č", "link": "https://h.cz/z?id=1", "id": 1,
    "date": "Praha 10. října 2025", "keywords": "a, b", "category": "Kultura",
}


def test_json_array_round_trip(spark, tmp_path):
    records = [RECORD, {"id": 2, "title": "x"}, {"id": 1, "title": "again"}, {"id": 3, "category": None}]
    (tmp_path / "a.json").write_text(json.dumps(records, ensure_ascii=False, indent=2), "utf-8")
    corpus = read_articles(spark, str(tmp_path / "a.json"), "json", position="position")
    rows = corpus.orderBy("position").collect()
    assert [r.id for r in rows] == [1, 2, 1, 3] and rows[0].asDict()["date"] == RECORD["date"]
    assert rows[1].category is None and rows[3].category is None
    first = dedupe_keep_first(corpus, "position")
    assert sorted((r.id, r.title) for r in first.collect() if r.title) == [(1, "Titulek"), (2, "x")]
    write_articles(first.drop("position"), str(tmp_path / "out"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "října" in text and len(text.splitlines()) == 3


@pytest.mark.parametrize("fmt", [None, "jsonl", "json", "parquet"])
def test_what_is_written_is_read_by_the_same_name(spark, tmp_path, fmt):
    rows = [(f"t{i}", "c\n", None, i, None, "k", None if i % 3 else "Č") for i in range(200)]
    corpus = spark.createDataFrame(rows, ARTICLE).repartition(3)
    named = [] if fmt is None else [fmt]
    for readable in (read_articles, read_articles_or_empty):
        path = str(tmp_path / readable.__name__)
        write_articles(corpus, path, *named)
        assert sorted(map(tuple, readable(spark, path, *named).collect())) == sorted(rows)


def test_impossible_formats_are_refused(spark, tmp_path):
    corpus = spark.createDataFrame([], ARTICLE)
    for arguments in ({"fmt": "csv"}, {"fmt": "json", "by_category": True}, {"fmt": "json", "max_records_per_file": 5}):
        with pytest.raises(ValueError):
            write_articles(corpus, str(tmp_path / "x"), **arguments)


@pytest.mark.parametrize("content", ["", "[", '[{"id": 1}, {"id"', "not json"])
def test_unusable_corpus_is_empty(spark, tmp_path, content):
    (tmp_path / "a.json").write_text(content)
    assert read_articles_or_empty(spark, str(tmp_path / "a.json"), "json").count() == 0
    assert read_articles_or_empty(spark, str(tmp_path / "missing.json"), "json").count() == 0


@pytest.mark.parametrize("fmt", ["json", "jsonl"])
def test_one_bad_record_spoils_nothing_else(spark, tmp_path, fmt):
    records = ['{"id":1,"title":"a"}', '{"id":"x","title":"b"}', '{"id":3,"title":7}']
    (tmp_path / "a.json").write_text("[" + ",".join(records) + "]" if fmt == "json" else "\n".join([*records, '{"id":4,']))
    rows = read_articles_or_empty(spark, str(tmp_path / "a.json"), fmt, "position").orderBy("position").collect()
    assert [(r.id, r.title) for r in rows] == [(1, "a"), (None, "b"), (3, "7")]


def test_a_corpus_cut_short_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id"')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_articles(spark, str(tmp_path / "a.json"), "json").collect()


@pytest.mark.parametrize("fmt", ["json", "jsonl"])
def test_position_follows_file_names_not_sizes(spark, tmp_path, fmt):
    for name, ids in (("a", [5]), ("b", list(range(10, 400)))):
        records = [json.dumps({"id": i, "content": "x" * 50}) for i in ids]
        (tmp_path / f"{name}.json").write_text("[" + ",".join(records) + "]" if fmt == "json" else "\n".join(records))
    for reader in (read_articles, read_articles_or_empty):
        corpus = reader(spark, str(tmp_path), fmt, "position")
        assert [r.id for r in corpus.orderBy("position").collect()] == [5, *range(10, 400)]
        listing = category_ranking(category_counts(corpus.withColumn("category", F.col("id").cast("string")), "position"))
        assert listing.orderBy("rank").first().category == "5"


def test_long_category_names(spark, tmp_path):
    names = ["č" * 300, "a/b=c", "", "short"]
    corpus = spark.createDataFrame([(None, None, None, i, None, None, n) for i, n in enumerate(names)], ARTICLE)
    write_articles(corpus, str(tmp_path / "x"), "parquet", by_category=True)
    for i, name in enumerate(names):
        assert [r.id for r in read_categories(spark, str(tmp_path / "x"), [name]).collect()] == [i]
    assert read_categories(spark, str(tmp_path / "x"), []).count() == 0


def test_stored_folders_go_with_their_block(spark):
    with scratch():
        kept = stored(spark.range(3), "test")
        folder = Path(kept.inputFiles()[0].removeprefix("file:")).parent
        assert folder.exists()
    assert not folder.exists()


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        read_articles(spark, str(tmp_path), "csv")


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text('["B", "A, x",\n "Č"]', "utf-8")
    rows = read_category_list(spark, str(tmp_path / "v.json")).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, "B", 0), (1, "A, x", 0), (2, "Č", 0)]
    builtin = default_category_list(spark)
    assert builtin.count() == 18
    picked = resolve_picks(vocabulary_ranking(builtin), "15,7").orderBy("pos").collect()
    assert [r.category for r in picked] == ["Sport", "Bez kategorie"]


def test_feed_file(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>č</title><link>https://h.cz/?id=999</link>'
        "<item><title>a</title><link> https://h.cz/z.php?id=7&amp;x=1 </link></item>"
        "<item><link><![CDATA[https://h.cz/z.php?id=12]]></link></item>"
        "<item><title>none</title></item><item><link/></item>"
        "<item><link>https://h.cz/z.php?id=0</link></item>"
        "<item><link>https://other/z.php?id=50</link></item></channel></rss>",
        "utf-8",
    )
    ids = feed_ids(read_feed_items(spark, str(tmp_path / "feed.xml")), "h.cz")
    assert tuple(feed_id_range(ids).first()) == (12, 7, 2)


def test_raw_pages(spark, tmp_path):
    (tmp_path / "17.html").write_bytes("<h1>č</h1>".encode("windows-1250"))
    (tmp_path / "page-18.html").write_bytes(b"<h1>\xe8</h1>")
    (tmp_path / "none.txt").write_bytes(b"x")
    pages = read_raw_pages(spark, str(tmp_path), "https://h.cz/?id=", "windows-1250")
    assert sorted(map(tuple, pages.collect())) == [
        (17, "https://h.cz/?id=17", "<h1>č</h1>"), (18, "https://h.cz/?id=18", "<h1>č</h1>"),
    ]


def test_decode_body(spark):
    cases = [
        ("č".encode(), None, "č"),
        ("č".encode(), "", "č"),
        ("č".encode(), "ASCII", "č"),
        (b"a\xffb", "utf-8", "ab"),
        (b"a\xc4", "utf-8", "a"),
        ("﻿x".encode(), "utf-8", "﻿x"),
        ("č".encode("windows-1250"), "Windows-1250", "č"),
        (b"\xe8\x81", "windows-1252", ""),
        ("č".encode("utf-16"), "UTF-16", "č"),
        ("é".encode("latin-1"), "iso-8859-1", "é"),
        (b"x", "no-such-charset", None),
        (b"x", "no\0charset", None),
        (b"x", "undefined", None),
        (b"a\\ud800b", "raw_unicode_escape", "ab"),
        (None, "utf-8", None),
        (b"", "utf-8", ""),
    ]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c) for i, (b, c, _) in enumerate(cases)], "i int, b binary, c string")
    found = rows.select("i", decode_body(F.col("b"), F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [t for _, _, t in cases]


def test_output_summary_of_nothing(spark):
    assert tuple(output_summary(spark.createDataFrame([], ARTICLE)).first()) == (0, 0, "0.0")


def test_output_name_column(spark):
    row = spark.sql("select timestamp'2025-01-02 03:04:05' as t").select(output_name_column("content", "t")).first()
    assert row[0] == "content_20250102_030405"


@pytest.mark.parametrize("lo, hi", [(0, 0), (0, 9), (1, 10), (7, 123), (95, 105), (100, 999), (1, 1000), (998, 12_345), (5, 4), (-3, 2)])
def test_id_globs(lo, hi):
    """Each number of the span matches exactly one pattern, others none."""
    patterns = [re.compile(g) for g in id_globs(lo, hi)]
    for number in range(13_000):
        assert sum(bool(p.fullmatch(str(number))) for p in patterns) == (lo <= number <= hi)


def test_id_globs_of_long_spans_are_few():
    assert len(id_globs(1, 2**63 - 1)) < 60


def test_raw_pages_of_a_span(spark, tmp_path):
    """Only files whose names hold an id of the span are opened, however the number is written."""
    names = {"9.html": 9, "10.html": 10, "page-011.html": 11, "12-a.html": 12, "0013 x.html": 13, "14.html": 14, "114.html": 114, "a.html": None}
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "12.txt").write_bytes(b"x")
    pages = read_raw_pages(spark, str(tmp_path), "u", span=(10, 13))
    assert sorted(r.page_id for r in pages.collect()) == [10, 11, 12, 13]
    assert len(pages.inputFiles()) == 4
    assert read_raw_pages(spark, str(tmp_path), "u", span=(20, 10)).count() == 0
    assert sorted(r.page_id for r in read_raw_pages(spark, str(tmp_path), "u").collect() if r.page_id) == [9, 10, 11, 12, 13, 14, 114]
    with pytest.raises(ValueError, match="ending"):
        read_raw_pages(spark, str(tmp_path), "u", glob="p*.html", span=(1, 2))


def test_raw_pages_in_folders_by_id(spark, tmp_path):
    """A span prunes folders; what lies in others need not be readable."""
    for number in (7, 8, 2**40):
        folder = tmp_path / f"id={number}"
        folder.mkdir()
        (folder / "body").write_bytes(b"b%d" % number)
    pages = read_raw_pages(spark, str(tmp_path), "u", glob="*", span=(8, 2**41), id_folder="id")
    assert sorted(map(tuple, pages.collect())) == [(8, "u8", "b8"), (2**40, f"u{2**40}", f"b{2**40}")]
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id" in plan


def test_pages_are_written_one_file_each(spark, tmp_path):
    """Rows with one id are lines of one file, without a job's commit; a NULL id is Spark's folder for it."""
    from newsloom.sources.writers import write_page_files

    rows = [(1, "a"), (1, "b"), (2, None), (None, "x"), (-3, "é\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").repartition(3)
    for path in (f"{tmp_path}/one dump", f"file://{tmp_path}/two"):
        assert write_page_files(pages, path, "page_id") == 4
        read = read_raw_pages(spark, path, "u", glob="*.txt", id_folder="page_id")
        found = {(r.page_id, r.html) for r in read.collect()}
        assert found == {(1, "a\nb\n"), (2, "\n"), (None, "x\n"), (-3, "é\n\n")}


def test_a_span_lists_its_folders_only(spark, tmp_path):
    """Folders of other ids are not listed at all; leading zeros and deeper folders are found."""
    for name in ("id=7", "id=08", "id=12", "id=112"):
        (tmp_path / "flat" / name).mkdir(parents=True)
        (tmp_path / "flat" / name / "p.html").write_text(name)
    flat = read_raw_pages(spark, str(tmp_path / "flat"), "u", span=(8, 12), id_folder="id")
    assert len(flat.inputFiles()) == 2 and sorted(r.page_id for r in flat.collect()) == [8, 12]
    assert read_raw_pages(spark, str(tmp_path / "flat"), "u", span=(20, 30), id_folder="id").count() == 0
    (tmp_path / "deep" / "year=2024" / "id=9").mkdir(parents=True)
    (tmp_path / "deep" / "year=2024" / "id=9" / "p.html").write_text("d")
    deep = read_raw_pages(spark, str(tmp_path / "deep"), "u", span=(8, 12), id_folder="id")
    assert [r.page_id for r in deep.collect()] == [9]


def test_arrays_are_written_a_few_lines_at_a_time():
    from newsloom.sources.writers import SLICE_ROWS, enclosed

    class Rows:
        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)])], ["value"])
            return list(run(iter([batch, batch.slice(0, 1)])))

    batches = enclosed(Rows(), "[", ",", "]")
    assert max(b.num_rows for b in batches) <= SLICE_ROWS
    lines = [v for b in batches for v in b.column(0).to_pylist()]
    assert lines[0] == "[" and lines[1:] == [f"{i}," for i in range(1000)] + ["0]"]
