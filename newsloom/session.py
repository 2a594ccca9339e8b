"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffles, turns joins into broadcasts once the small side has been
# measured, and splits skewed partitions. Web pages are wide rows, so Arrow
# batches are bounded by bytes and scan splits are smaller than the default:
# parsing is CPU-bound and pages expand roughly ten-fold from parquet. Streaming
# state goes to disk, since the ids seen so far may outgrow the memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "newsloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the recommended settings; ``extra`` uses __ for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path under the folder named by ``spark.checkpoint.dir``.

    Every executor must reach it, so only a local-mode session may fall back to
    a temporary folder of this machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="newsloom-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def list_in_few_tasks(spark: SparkSession) -> None:
    """Folders and files of large dumps are listed by some tasks a core, not by one each: from now on, since a stream goes on listing with the session's settings."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.set(name, min(int(spark.conf.get(name)), 8 * spark.sparkContext.defaultParallelism))


# Folders of stored results by owner: the innermost ``scratch`` of the thread, else the process.
_PROCESS: list[str] = []
_BLOCKS = threading.local()


def _owner() -> list[str]:
    blocks = getattr(_BLOCKS, "open", None)
    return blocks[-1] if blocks else _PROCESS


def _remove(paths: list[str]) -> None:
    """Delete folders by Spark's own file systems; those that cannot be reached any more stay."""
    context = SparkContext._active_spark_context
    while paths and context is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Results that this thread stores inside belong to this block and are removed at its end.

    So what is computed from them has to be written or collected inside as well.
    """
    _BLOCKS.open = [*getattr(_BLOCKS, "open", []), []]
    try:
        yield
    finally:
        _remove(_BLOCKS.open.pop())


@atexit.register
def _remove_all() -> None:
    with suppress(Exception):  # the JVM may be gone
        _remove(_PROCESS)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` computed once and read back from the shared folder.

    For small results that several branches of a plan read. Column pruning
    would make their computations differ, and Spark shares equal ones only;
    the table survives lost executors and brings its size along. It is removed at the end of the
    enclosing ``scratch`` block, or of the process.
    """
    path = shared_folder(df.sparkSession, purpose)
    _owner().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
