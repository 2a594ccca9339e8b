"""Table schemas and the fixed values of the article data model."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# A file as Spark's binary source gives it.
RAW_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Folder column of a corpus written by category.
CATEGORY_KEY = "category_key"
# Folders of such a corpus: a category's name may be longer than a file name, so folders are numbered by its hash.
CATEGORY_FOLDERS = 4096

# One name per corpus format, for reading and writing: a record a line, an array a file, parquet.
CORPUS_FORMATS = ["jsonl", "json", "parquet"]
DEFAULT_CORPUS_FORMAT = "jsonl"

# ---------------------------------------------------------------------------
# The results depend on these exact names, numbers and formats.
# ---------------------------------------------------------------------------

# Group name of an article without a category.
DEFAULT_CATEGORY = "Uncategorized"

# Texts shorter than this after cleaning count as empty.
MIN_CLEAN_CHARS = 50

# A site-neutral body must be longer than this.
MIN_MAIN_TEXT_CHARS = 100

# Normalised keywords must be longer than this.
MIN_KEYWORDS_CHARS = 2

# Latest and earliest id assumed when a feed yields none.
FALLBACK_LATEST_ID = 200_000
FALLBACK_EARLIEST_ID = 1

# Id spans of the scan presets ("maximum" scans from id 1 and has no span).
SCAN_SPANS = {
    "test": 100,
    "small": 1_000,
    "medium": 10_000,
    "large": 50_000,
    "massive": 100_000,
}
ANALYSIS_SPAN = 200
SAMPLE_SPAN = 50

# Preview lengths.
PREVIEW_TITLE_CHARS = 50
PREVIEW_KEYWORDS_CHARS = 30

# File-name suffix of outputs and reports.
FILE_TIMESTAMP_FORMAT = "yyyyMMdd_HHmmss"

# The folder of a NULL, as Spark's partitioned tables name it.
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"

# Category vocabulary offered when no list is given, in its own order.
CATEGORY_VOCABULARY = [
    "Finance, ekonomika",
    "Média, společnost a životní styl",
    "Služby, cestovní ruch",
    "Auto-moto, doprava a stroje",
    "Obchod, marketing",
    "IT, telekomunikace",
    "Bez kategorie",
    "Kultura",
    "Energetika, suroviny",
    "Věda, vzdělávání a školství",
    "Zpracovatelský a výrobní průmysl",
    "Zdravotnictví",
    "Stavebnictví, bydlení a reality",
    "Politika, veřejná správa a soudy",
    "Sport",
    "Chemický a farmaceutický průmysl",
    "Potraviny, gastronomie",
    "Zemědělství, životní prostředí",
]
