"""Landed inputs as DataFrames: pages, feeds, article corpora, vocabularies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from newsloom.functions.charset import CharsetModel, detect_charset
from newsloom.functions.decode import decode_body
from newsloom.functions.text import category_folder, category_or_default
from newsloom.schema import (
    ARTICLE,
    CATEGORY_KEY,
    CATEGORY_VOCABULARY,
    CORPUS_FORMATS,
    DEFAULT_CORPUS_FORMAT,
    HIVE_NULL,
    PAGE,
    RAW_FILE,
)
from newsloom.session import list_in_few_tasks
from newsloom.sources.arrays import read_records


# Tasks that read a micro-batch of raw files, at most.
TASKS_PER_CORE = 4


def landing_order() -> Column:
    """Where a row of a file source was landed: file time, file, row. It orders
    pages with the same id, whatever order tasks read them in."""
    meta = F.col("_metadata")
    return F.struct(
        F.unix_micros(meta["file_modification_time"]).alias("landed"),
        meta["file_path"].alias("file"),
        meta["row_index"].alias("row"),
    )


def read_pages(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """Decoded pages (page_id, url, html) from parquet; ``position`` adds a
    column with their landing order."""
    pages = spark.read.schema(PAGE).parquet(path)
    return pages.withColumn(position, landing_order()) if position else pages


def id_globs(lo: int, hi: int) -> list[str]:
    """File-name patterns that the decimal numbers from ``lo`` to ``hi`` match, and no others; some two a digit."""
    globs = ["0"] if lo <= 0 <= hi else []
    at = max(lo, 1)
    while at <= hi:
        size, free = 1, 0
        while at % (size * 10) == 0 and at + size * 10 - 1 <= hi:
            size, free = size * 10, free + 1
        head, digit = divmod(at // size, 10)
        last = min(9, digit + (hi - at + 1) // size - 1)
        globs.append((str(head) if head else "") + f"[{digit}-{last}]" + "[0-9]" * free)
        at += (last - digit + 1) * size
    return globs


def _named_within(glob: str, span: tuple[int, int] | None) -> str:
    """The glob, narrowed to names whose number lies in the span. A few others may match: digits that follow letters and digits."""
    if span is None:
        return glob
    ending = glob.removeprefix("*")
    if ending == glob or re.match(r"\d", ending) or set(ending) & set("*?[]{},\\"):
        raise ValueError(f"ids can be looked for only where the glob is * and an ending: {glob}")
    zeros = ",".join("0" * n for n in range(19))
    numbers = ",".join(id_globs(*span)) or "-"  # no name holds a number that is "-"
    return f"{{,*[^0-9]}}{{{zeros}}}{{{numbers}}}{{,[^0-9]*}}{ending}"


def _within_folders(reader, path: str, id_folder: str, span: tuple[int, int]) -> DataFrame | None:
    """The files of the folders with ids of a span, none other listed; None if there are none or they lie deeper."""
    zeros = ",".join("0" * n for n in range(19))
    names = f"{id_folder}={{{zeros}}}{{{','.join(id_globs(*span)) or '-'}}}"
    try:
        return reader.option("basePath", path).load(f"{path.rstrip('/')}/{names}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _raw_files(spark: SparkSession, reader, path: str, glob: str, span: tuple[int, int] | None, id_folder: str | None) -> DataFrame:
    """(page_id, content, modificationTime, path) of files of pages; a span is met by the listing."""
    list_in_few_tasks(spark)
    schema = T.StructType([*RAW_FILE.fields, *([T.StructField(id_folder, T.LongType())] if id_folder else [])])
    reader = reader.format("binaryFile").schema(schema)
    if id_folder and not isinstance(reader, DataFrameReader):
        # Folders found as partitions would cost the driver some kilobytes each, in every micro-batch again: ids are read from the paths instead.
        files = reader.schema(RAW_FILE).options(pathGlobFilter=glob, recursiveFileLookup="true").load(path)
        name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # in paths a plus is no space
        folder = F.regexp_extract(name, f"(?i).*/{re.escape(id_folder)}=([^/]*)/", 1)
        files = files.filter(folder != "")
        page_id = F.nullif(folder, F.lit(HIVE_NULL)).cast("bigint")
    elif id_folder:
        files, page_id = None, F.col(id_folder)
        reader = reader.option("pathGlobFilter", glob)
        if span is not None and span[0] >= 0:
            files = _within_folders(reader, path, id_folder, span)
        if files is None:
            files = reader.load(path)
    else:
        files = reader.option("pathGlobFilter", _named_within(glob, span)).load(path)
        page_id = F.nullif(F.regexp_extract("path", r"(\d+)[^/]*$", 1), F.lit("")).try_cast("bigint")
    if span is not None:
        files = files.filter(page_id.between(*span))
    return files.select(page_id.alias("page_id"), "content", "modificationTime", "path")


def _raw_pages(files: DataFrame, link_prefix: str, charset: str | None, model: CharsetModel | None) -> list[Column]:
    page_id, content = files["page_id"], files["content"]
    return [
        page_id,
        F.concat(F.lit(link_prefix), page_id.cast("string")).alias("url"),
        decode_body(content, _charset(F.lit(charset).cast("string"), content, model)).alias("html"),
    ]


def read_raw_pages(
    spark: SparkSession,
    path: str,
    link_prefix: str,
    charset: str | None = None,
    glob: str = "*.html",
    model: CharsetModel | None = None,
    span: tuple[int, int] | None = None,
    id_folder: str | None = None,
) -> DataFrame:
    """Pages from a dump with one file per page, named by its id.

    ``charset`` is the declared one of the dump; without one ``model`` tells each page's. Files without digits in their
    name get no id. With ``id_folder`` the ids stand in names of folders instead, such as ``id=17``.

    ``span`` (from, to) takes the pages with these ids: by patterns of names, or by pruned folders, so that no file beyond
    them is opened.
    """
    files = _raw_files(spark, spark.read, path, glob, span, id_folder)
    return files.select(*_raw_pages(files, link_prefix, charset, model))


def stream_raw_pages(
    spark: SparkSession,
    path: str,
    link_prefix: str,
    charset: str | None = None,
    glob: str = "*.html",
    model: CharsetModel | None = None,
    span: tuple[int, int] | None = None,
    id_folder: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """``read_raw_pages`` of a dump that grows, oldest files first, with the ``position`` of each page: file time and name."""
    files = _raw_files(spark, spark.readStream.option("maxFilesPerTrigger", files_per_batch), path, glob, span, id_folder)
    # Small files fill a task by what opening them is said to cost, some at a time; that many tasks, and as many files written, would burden the driver.
    files = files.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    position = F.struct(F.unix_micros("modificationTime").alias("landed"), F.col("path").alias("file"))
    return files.select(*_raw_pages(files, link_prefix, charset, model), position.alias("position"))


def decode_pages(raw: DataFrame, link_prefix: str, model: CharsetModel | None = None) -> DataFrame:
    """Pages from (page_id, body, charset) rows; where no charset is given ``model`` tells it, or else it is UTF-8."""
    return raw.select(
        "page_id",
        F.concat(F.lit(link_prefix), F.col("page_id").cast("string")).alias("url"),
        decode_body(F.col("body"), _charset(F.col("charset"), F.col("body"), model)).alias("html"),
    )


def _charset(given: Column, body: Column, model: CharsetModel | None) -> Column:
    if model is None:
        return given
    given = F.nullif(given, F.lit(""))
    return F.coalesce(given, detect_charset(F.when(given.isNull(), body), model))


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Links of the items of RSS files; items without a link are left out."""
    items = spark.read.format("xml").option("rowTag", "item").schema("link string").load(path)
    return _with_link(items)


def stream_feed_items(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Links of the items of RSS snapshots as they land, with the ``feed`` and ``snapshot`` they come from.

    A feed is a folder below ``path``, a snapshot a file in it.
    """
    reader = spark.readStream.format("xml").option("rowTag", "item").option("maxFilesPerTrigger", files_per_batch)
    list_in_few_tasks(spark)
    items = reader.schema("link string").load(f"{path.rstrip('/')}/*/*")
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"([^/]*)/[^/]*$", 1)
    feed = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))  # in paths a plus is no space
    return items.select("link", feed.alias("feed"), file.alias("snapshot"))


def feed_items(feeds: DataFrame, column: str) -> DataFrame:
    """Links of items held one per row as XML text in a column."""
    item = F.from_xml(F.col(column), "link string")
    return _with_link(feeds.select(item["link"].alias("link")))


def _with_link(items: DataFrame) -> DataFrame:
    return items.filter(F.length("link") > 0)


def file_order() -> Column:
    """Where a row of a file source stands: file, split, row. It follows neither the
    sizes of files nor the order in which tasks read them."""
    meta = F.col("_metadata")
    return F.struct(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_articles(
    spark: SparkSession, path: str, fmt: str = DEFAULT_CORPUS_FORMAT, position: str | None = None
) -> DataFrame:
    """An article corpus: ``jsonl`` (a record a line), ``json`` (an array a file) or ``parquet``.

    Records that cannot be read, of JSON cut short for instance, end the job; see
    ``read_articles_or_empty`` for a corpus that may be damaged. One task reads a file holding one array;
    ``read_article_arrays`` splits it.
    ``position`` adds a column in the order of file name and row.
    """
    _check_format(fmt)
    reader = spark.read.schema(ARTICLE)
    if fmt == "parquet":
        articles = reader.parquet(path)
    else:
        articles = reader.json(path, multiLine=fmt == "json", mode="FAILFAST")
    ordered = articles.withColumn(position, file_order()) if position else articles
    return ordered.select(*ARTICLE.names, *([position] if position else []))  # without columns found in folder names


def read_article_arrays(spark: SparkSession, path: str, position: str | None = None, broken: str = "fail") -> DataFrame:
    """``read_articles`` of ``json`` for arrays of any size: many tasks read one file.

    A file that is not a whole array ends the job, or is left out if ``broken`` is "skip"; a record that is no JSON ends it in any case.
    """
    found = read_records(spark, path, broken).select(F.from_json("value", ARTICLE, {"mode": "FAILFAST"}).alias("a"), "position")
    columns = [F.col("a")[name].alias(name) for name in ARTICLE.names]
    return found.select(*columns, *([F.col("position").alias(position)] if position else []))


def _check_format(fmt: str) -> None:
    if fmt not in CORPUS_FORMATS:
        raise ValueError(f"unknown corpus format: {fmt}")


def read_categories(spark: SparkSession, path: str, names: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Articles of the named categories from a corpus written by category.

    Only the folders that may hold those categories are read.
    """
    _check_format(fmt)
    schema = T.StructType([*ARTICLE.fields, T.StructField(CATEGORY_KEY, T.IntegerType())])
    if fmt == "parquet":
        articles = spark.read.schema(schema).parquet(path)
    else:
        articles = spark.read.schema(schema).json(path, multiLine=fmt == "json")
    folders = F.array(*(category_folder(F.lit(name)) for name in names)) if names else F.array().cast("array<int>")
    exact = category_or_default(F.col("category")).isin(list(names))
    return articles.filter(F.array_contains(folders, F.col(CATEGORY_KEY)) & exact).select(*ARTICLE.names)


def read_articles_or_empty(
    spark: SparkSession, path: str, fmt: str = DEFAULT_CORPUS_FORMAT, position: str | None = None
) -> DataFrame:
    """A corpus to append to, as far as it can be read; a missing one is empty.

    What is not JSON counts as empty: a file of ``json``, a line of ``jsonl``. Of each record a field
    of the wrong type is NULL; the record stays.
    """
    _check_format(fmt)
    try:
        if fmt == "parquet":
            return read_articles(spark, path, fmt, position)
        files = spark.read.text(path, wholetext=fmt == "json").withColumn("__at", file_order())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        order = "struct<file: string, block: bigint, row: bigint>"
        schema = T.StructType([*ARTICLE.fields, *([T.StructField(position, T._parse_datatype_string(order))] if position else [])])
        return spark.createDataFrame([], schema)
    if fmt == "json":
        # An array of strings takes each record as it is written.
        records = files.select("__at", F.posexplode(F.from_json("value", "array<string>")).alias("row", "record"))
        at = F.struct("__at.file", "__at.block", F.col("row").cast("bigint").alias("row"))
    else:
        records, at = files.select("__at", F.col("value").alias("record")), F.col("__at")
    readable = records.filter(F.try_parse_json("record").isNotNull())
    parsed = readable.select(F.from_json("record", ARTICLE).alias("a"), at.alias("__order"))
    columns = [F.col("a")[name].alias(name) for name in ARTICLE.names]
    return parsed.select(*columns, *([F.col("__order").alias(position)] if position else []))


def read_category_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of names as (pos, category, n), in order, with count 0."""
    names = F.from_json("value", T.ArrayType(T.StringType()))
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(names).alias("pos", "category"))
        .withColumn("n", F.lit(0).cast("bigint"))
    )


def default_category_list(spark: SparkSession) -> DataFrame:
    """The built-in vocabulary in the shape of ``read_category_list``."""
    rows = [(pos, name, 0) for pos, name in enumerate(CATEGORY_VOCABULARY)]
    return spark.createDataFrame(rows, "pos int, category string, n bigint")


def vocabulary_ranking(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary in the shape of a ranking, so that picks resolve against it."""
    return vocabulary.select((F.col("pos") + 1).cast("bigint").alias("rank"), "category", "n")

