"""Loads that take up only the pages that arrived since the last run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import Store
from ..sources.pages import DETAIL, file_key, files_below, local_path, read_files
from ..sources.storage import exists
from .manifest import in_parts


#: Settings of Spark: tasks that look at a batch's files, and what opening a file counts as when files are dealt to tasks.
LISTING, OPEN_COST = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"
#: That cost where a file is one page: a few hundred pages a task. Spark's own, 4 MB, gives each 32 pages a task and an output file.
PAGE_COST = 256 << 10


@contextmanager
def _at_most(spark: SparkSession, settings: dict[str, int]) -> Iterator[None]:
    """Settings lowered to these values, and put back after."""
    before = {k: spark.conf.get(k) for k in settings}
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for k, v in settings.items():
        spark.conf.set(k, str(min(v, in_bytes(before[k]))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _run(stream: DataFrame, store: Store, kind: str, checkpoint: str, opened: Callable[[DataFrame], DataFrame] = lambda batch: batch, **settings: int) -> None:
    """A batch that was published before a crash is not loaded again when the stream replays it. `opened` makes pages of a batch."""
    spark = stream.sparkSession
    # Spark's file stream names each file of a batch, which are looked at in a task each, up to ten thousand
    with _at_most(spark, {LISTING: 2 * spark.sparkContext.defaultParallelism} | settings):
        query = (
            stream.writeStream.foreachBatch(lambda batch, n: None if batch.isEmpty() else store.ingest(opened(batch), kind, batch=(checkpoint, n)))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _arrivals(spark: SparkSession, at: str, named: str, suffix: str, size: int) -> None:
    """Add the paths of the files below a local folder that are not named yet to a table of paths, `size` at most to a file of it."""
    found = files_below(spark, at, suffix).select("path")
    if exists(spark, named):
        found = found.join(spark.read.schema("path string").parquet(named), "path", "left_anti")
    for part in in_parts(found, size):
        part.coalesce(1).write.mode("append").parquet(named)


def incremental_ingest(spark: SparkSession, folder: str, store: Store, kind: str, checkpoint: str, files_per_batch: int = 100_000, suffix: str = DETAIL) -> None:
    """Load the gzipped pages that are new in a folder. A page fetched again must come under a new file name, as read files are not read again.

    Spark's file stream holds a status and a name for every file of the folder on the driver. So of a local folder tasks list the files, the
    paths of new ones are added to a table beside the checkpoint, and the stream is of that table: a batch is one file of paths, which tasks
    open. Other stores, and checkpoints of a stream of the folder itself, keep that stream.
    """
    if (at := local_path(spark, folder)) and not exists(spark, f"{checkpoint}/offsets"):
        named, marks = f"{checkpoint}/paths", f"{checkpoint}/stream"
        _arrivals(spark, at, named, suffix, files_per_batch)
        if exists(spark, named):
            stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(named)
            _run(stream, store, kind, marks, lambda batch: read_files(batch, suffix).select("key", "html"))
        return
    stream = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    _run(stream.select(file_key(F.col("_metadata.file_path"), suffix).alias("key"), F.col("value").alias("html")), store, kind, checkpoint, **{OPEN_COST: PAGE_COST})


def incremental_ingest_table(spark: SparkSession, folder: str, store: Store, kind: str, checkpoint: str, files_per_batch: int = 1_000) -> None:
    """The same from landed Parquet files with key and html."""
    stream = spark.readStream.schema("key string, html string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    _run(stream, store, kind, checkpoint)
