"""A corpus laid out by id: folders of consecutive ids, each dealt to the same number of buckets by hash of the id.

Spans of ids read only the folders they touch. Merging reads only the folders between a batch's least
and greatest id, of these only the ids, and joins them as they lie: the batch's ids are dealt to the corpus's buckets, the corpus is not shuffled.
Articles themselves are dealt by folder and bucket, to tasks whose number grows with them. Each write adds at most one file per folder and
bucket; articles without an id, whose folder is one bucket, come in a file a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators.dedup import first_per_id, has_id
from newsloom.operators.scan import id_bounds
from newsloom.schema import ARTICLE
from newsloom.session import stored

RANGE = "id_range"

# Articles that a task writes, on average.
TASK_ROWS = 1 << 14


@dataclass(frozen=True)
class ClusteredCorpus:
    """Name and layout of such a table; all who write to it must name the same layout.

    ``width`` ids share a folder: take so many that a folder's buckets hold some hundred MB each.
    """

    table: str
    width: int = 1 << 20
    buckets: int = 16

    def _range(self, number):
        return F.floor(number / self.width)

    def append(self, articles: DataFrame, path: str | None = None) -> None:
        """Add articles, as they are; the first call makes the table, at ``path`` if one is given. Those without an id are in a folder of their own.

        ``articles`` are counted first; store them if they are dear to compute.
        """
        number = F.col("id")
        placed = articles.select(*ARTICLE.names).withColumn(RANGE, self._range(number))
        tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // TASK_ROWS))
        # A task holds whole buckets of folders and writes them one after another.
        salt = F.when(number.isNull(), F.pmod(F.xxhash64(*ARTICLE.names), F.lit(tasks)))
        writer = placed.repartition(tasks, RANGE, F.pmod(F.hash(number), F.lit(self.buckets)), salt).write.mode("append").format("parquet")
        writer = writer.partitionBy(RANGE).bucketBy(self.buckets, "id").sortBy("id")
        (writer.option("path", path) if path else writer).saveAsTable(self.table)

    def span(self, spark: SparkSession, lo: int, hi: int) -> DataFrame:
        """Articles with an id from lo to hi, from the folders that can hold one."""
        inside = F.col(RANGE).between(self._range(F.lit(lo).cast("bigint")), self._range(F.lit(hi).cast("bigint")))
        return spark.table(self.table).where(inside & F.col("id").between(lo, hi)).select(*ARTICLE.names)

    def articles(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table).select(*ARTICLE.names)

    def new_rows(self, batch: DataFrame, order: str) -> DataFrame:
        """First row of each id of ``batch`` that the corpus does not hold; rows without an id are left out."""
        batch = batch.where(has_id())
        lo, hi = id_bounds(batch)
        if lo is None:
            return batch
        known = self.span(batch.sparkSession, lo, hi).select("id")
        # Only ids meet the corpus, in as many tasks as it has buckets; stored, so that the articles are not dealt like these.
        fresh = stored(batch.select("id").distinct().join(known, "id", "left_anti"), "fresh-ids")
        return first_per_id(batch.join(fresh, "id", "left_semi").select(*batch.columns), order)

    def merge(self, batch: DataFrame, order: str) -> DataFrame:
        """Add the new rows and return them. A merge that is repeated adds nothing."""
        fresh = stored(self.new_rows(batch, order), "fresh")
        self.append(fresh)
        return fresh
