"""Loads by the difference between a folder and what was taken up from it before, so that pages fetched again are found."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import page_sha256
from ..operators.upsert import Store
from ..sources.pages import DETAIL, file_key, files_below, local_path, read_files
from ..sources.storage import exists, kept

#: The table of files that were taken up, in the store; its key.
TABLE, KEY = "manifest", ("source", "path")
MANIFEST = StructType().add("source", "string").add("path", "string").add("length", "long").add("modified", "timestamp").add("sha256", "string")


def listing(spark: SparkSession, folder: str, suffix: str = DETAIL) -> DataFrame:
    """path, length and modified of each file; contents are not read. A missing folder is empty."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, length long, modified timestamp")
    if at := local_path(spark, folder):
        return files_below(spark, at, suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").toDF("path", "length", "modified")


def difference(now: DataFrame, known: DataFrame) -> DataFrame:
    """path and change of every file: new, changed (another length or time), same, or removed (known, but not there)."""
    old = known.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    change = (
        F.when(F.col("_length").isNull(), "new")
        .when(F.col("length").isNull(), "removed")
        .when((F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified")), "changed")
        .otherwise("same")
    )
    return now.join(old, "path", "full").select("path", change.alias("change"))


def _in_batches(paths: DataFrame, size: int) -> Iterator[list[str]]:
    """The files' paths, `size` at a time; the driver holds one batch and one partition."""
    rows = paths.toLocalIterator()
    while some := [r[0] for r in islice(rows, size)]:
        yield some


def in_parts(paths: DataFrame, size: int) -> Iterator[DataFrame]:
    """Frames of `size` of the given paths each, and of what is left; the driver learns one count for each partition."""
    spark = paths.sparkSession
    held = kept(paths.select("path", F.spark_partition_id().alias("_at")), "paths")
    starts, total = [], 0
    for at, n in sorted((r[0], r[1]) for r in held.groupBy("_at").count().collect()):
        starts.append((at, total))
        total += n
    if total > size:
        place = F.row_number().over(Window.partitionBy("_at").orderBy("path")) - 1 + F.col("_start")
        numbered = held.join(F.broadcast(spark.createDataFrame(starts, "_at int, _start long")), "_at")
        held = kept(numbered.select("path", F.floor(place / size).alias("_part")), "parts")
        for part in range(-(-total // size)):
            yield held.where(F.col("_part") == part).select("path")
    elif total:
        yield held.select("path")


def _read(spark: SparkSession, folder: str, paths: list[str], suffix: str) -> DataFrame:
    """The files of a folder that have these very paths. Spark leaves the others out of its listing by the filter, so it does not read them;
    naming each file to the reader instead takes a look at the store, and a task, for every one."""
    quoted = ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in paths)
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    found = found.where(F.expr(f"_metadata.file_path IN ({quoted})"))
    at = F.col("_metadata.file_path")
    return found.select(at.alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"), file_key(at, suffix).alias("key"), F.col("value").alias("html"), page_sha256("value").alias("sha256"))


def _batches(spark: SparkSession, folder: str, paths: DataFrame, size: int, suffix: str) -> Iterator[DataFrame]:
    """The contents of a folder's files, some at a time. Local files are read from a frame of paths, which never are on the driver."""
    if local_path(spark, folder):
        for part in in_parts(paths, size):
            yield kept(read_files(part, suffix).withColumn("sha256", page_sha256("html")), "read")
    else:
        for some in _in_batches(paths, size):
            yield kept(_read(spark, folder, some, suffix), "read")


def ingest_changes(spark: SparkSession, folder: str, store: Store, kind: str, files_per_batch: int = 100_000, suffix: str = DETAIL) -> DataFrame:
    """Load the pages of a folder that are new or changed since the last call; returns (path, change) of all files that are not the same.

    `touched` files have another time or length, but the content that was loaded before: they are read and not loaded. Files that are
    the same are not read. A removed file is reported once; what was loaded from it stays. A batch and its part of the manifest are
    published as one version, so after a crash the next call takes up the batches that are left.
    """
    source = f"{kind} {folder.rstrip('/')} *{suffix}"
    known = lambda: store.versions.read(TABLE, MANIFEST, KEY).where(F.col("source") == source)
    found = kept(difference(listing(spark, folder, suffix), known()).where("change <> 'same'"), "changes")
    before = kept(known().join(found.where("change = 'changed'").select("path"), "path", "left_semi").select("path", "sha256"), "before")
    touched = []
    for read in _batches(spark, folder, found.where("change <> 'removed'").select("path"), files_per_batch, suffix):
        rows = store.versions.write(read.select(F.lit(source).alias("source"), "path", "length", "modified", "sha256"), TABLE)
        manifest = {TABLE: (rows, store.versions.write_keys(read.select(F.lit(source).alias("source"), "path"), TABLE))}
        fresh = read.join(before, ["path", "sha256"], "left_anti")
        touched.append(read.join(before, ["path", "sha256"], "left_semi").select("path"))
        if fresh.isEmpty():
            store.publish(manifest)
        else:
            store.ingest(fresh, kind, beside=manifest)
    gone = found.where("change = 'removed'").select(F.lit(source).alias("source"), "path")
    if not gone.isEmpty():
        store.publish({TABLE: (None, store.versions.write_keys(gone, TABLE))})
    store.versions.tend(TABLE, MANIFEST, KEY)
    return _report(found, touched)


def _report(found: DataFrame, touched: list[DataFrame]) -> DataFrame:
    if not touched:
        return found.select("path", "change")
    same = touched[0]
    for t in touched[1:]:
        same = same.unionByName(t)
    same = same.withColumn("_touched", F.lit(True))
    return found.join(same, "path", "left").select("path", F.when(F.col("_touched"), "touched").otherwise(F.col("change")).alias("change"))
