"""Results of epochs in folders that are merged by levels, as a log-structured store.

An epoch of a run writes its own rows to level 0. Every eighth epoch merges the last eight folders into one of level 1, every 64th the last
eight of those, and so on: what an epoch writes depends on its own rows and is written again once per
level, and a run of n epochs leaves some 7 log8(n) folders. Names follow from run and epoch alone, so a repeated epoch
overwrites what it wrote before. What has been merged is removed by the epoch after, when the merge is known to be
committed; until then a reader takes the merged folder.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

FANOUT = 8


@dataclass(frozen=True)
class Folder:
    """Rows of the epochs from ``first`` on, ``FANOUT`` ** ``level`` of them, of one run."""

    path: str
    run: str
    level: int
    first: int
    written: int

    @property
    def after(self) -> int:
        return self.first + FANOUT**self.level


def _name(path: str, run: str, level: int, first: int) -> str:
    return f"{path}/run={run}/level={level}/first={first}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _folders(spark: SparkSession, path: str) -> list[Folder]:
    """All finished folders of all runs; their number is bounded by the levels."""
    files, where = _files(spark, f"{path}/run=*/level=*/first=*/_SUCCESS")
    found = []
    for status in files.globStatus(where) or []:
        name = status.getPath().getParent().toString()
        run, level, first = re.search(r"/run=([^/]*)/level=(\d+)/first=(\d+)$", name).groups()
        found.append(Folder(name, run, int(level), int(first), status.getModificationTime()))
    return found


def covering(spark: SparkSession, path: str, before: tuple[str, int] | None = None) -> list[Folder]:
    """The fewest folders that hold every epoch once; ``before`` (run, epoch) leaves out that epoch of the run and later ones."""
    chosen: list[Folder] = []
    for folder in sorted(_folders(spark, path), key=lambda f: (-f.level, f.run, f.first)):
        if before and folder.run == before[0] and folder.after > before[1]:
            continue
        if not any(c.run == folder.run and c.first <= folder.first < c.after for c in chosen):
            chosen.append(folder)
    return chosen


def read_levels(spark: SparkSession, folders: list[Folder], schema: str | T.StructType) -> DataFrame:
    paths = [f.path for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def add_epoch(
    rows: DataFrame, path: str, run: str, epoch: int, merge: Callable[[DataFrame], DataFrame], top: int | None = None
) -> None:
    """Write an epoch's rows and the merges that are due with it; none above level ``top``."""
    spark, schema = rows.sparkSession, rows.schema
    rows.write.mode("overwrite").parquet(_name(path, run, 0, epoch))
    size, level = FANOUT, 1
    while (epoch + 1) % size == 0 and (top is None or level <= top):
        first = epoch + 1 - size
        parts = [f for f in _folders(spark, path) if f.run == run and f.level == level - 1 and first <= f.first <= epoch]
        merge(read_levels(spark, parts, schema)).write.mode("overwrite").parquet(_name(path, run, level, first))
        size, level = size * FANOUT, level + 1


def remove_merged(spark: SparkSession, path: str, run: str, epoch: int) -> None:
    """Remove folders that epochs before this one, all committed, have merged."""
    mine = [f for f in _folders(spark, path) if f.run == run]
    for folder in mine:
        if any(f.level > folder.level and f.first <= folder.first < f.after <= epoch for f in mine):
            files, where = _files(spark, folder.path)
            files.delete(where, True)
