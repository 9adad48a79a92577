"""The raw zone: landed pages, as gzipped files or as a table in shards."""

from __future__ import annotations

import gzip
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import safe_key, shard_key
from . import counts
from .storage import Tables, exists, kept, path_of

LANDED = StructType([StructField(c, StringType()) for c in ("key", "html", "url", "registry", "kind", "shard")])
#: Suffixes of detail and list pages, and of the files that write_files makes.
DETAIL, LISTED, WRITTEN = ".html.gz", ".list.html.gz", ".txt.gz"


def write_files(html: DataFrame, folder: str) -> None:
    """Add one gzipped file for each page (the one column) to a folder, under names of their own: the page and a line feed.

    Spark's text writer makes such files too, and does so for any store. To a local folder the tasks write them themselves, as Hadoop
    starts two processes (chmod) for every file that it creates there, which takes it a hundred times as long as the file.
    """
    fs, path = path_of(html.sparkSession, folder)
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(path)
        html.mapInArrow(_files_of(path.toUri().getPath(), uuid.uuid4().hex), "files long").write.format("noop").mode("overwrite").save()
    else:  # each task puts its files in place, where else the driver renames them one by one
        html.write.mode("append").options(**{"mapreduce.fileoutputcommitter.algorithm.version": 2}, compression="gzip", maxRecordsPerFile=1).text(folder)


def _files_of(folder: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a file for each row. Names come from a partition's number and contents, so a task that is tried again makes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, copies = TaskContext.get(), Counter()
        for batch in batches:
            for value in batch.column(0):
                content = ((value.as_py() or "") + "\n").encode()
                digest = sha256(content).digest()
                copies[digest] += 1
                name = f"{run}-{task.partitionId():05d}-{digest.hex()}-{copies[digest]}{WRITTEN}"
                hidden = f"{folder}/.{name}.{task.taskAttemptId()}"  # until it is whole
                with open(hidden, "wb") as f:
                    f.write(gzip.compress(content, 6, mtime=0))
                os.replace(hidden, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    return write


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that tasks can list and open themselves; null for one in another store, or that is not there."""
    fs, path = path_of(spark, folder)
    if fs.getUri().getScheme() != "file" or not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        return None
    return path.toUri().getPath()


#: Names that Spark's listing leaves out; files that a task names, and pages that it holds, at a time.
_HIDDEN = re.compile(r"_[^=]*|\..*|.*\._COPYING_", re.S)
NAMED, HELD = 10_000, 64
_FILE = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])


def _url(path: str) -> str:
    """A path as Spark's _metadata.file_path has it: percent signs for what is no part of a URI, letters of all scripts as they are."""
    return "file:" + re.sub(r"[\x00-\x7f\x80-\x9f\s]+", lambda m: quote(m[0], safe="/:@!$&'()*+,;=-._~"), path)


def _entries(at: str, suffix: str) -> Iterator[tuple[str, bool]]:
    """Paths in a folder, and whether each is a folder too."""
    with os.scandir(at) as found:
        for e in found:
            if not _HIDDEN.fullmatch(e.name) and (e.is_dir() or e.name.endswith(suffix)):
                yield e.path, e.is_dir()


def _named(suffix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The entries of folders, some thousands at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                entries = _entries(at, suffix)
                while some := list(islice(entries, NAMED)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([d for _, d in some], pa.bool_())], ["at", "folder"])

    return run


def _looked_at(suffix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """path, length and modified (milliseconds) of files, and of those below folders; a file that went meanwhile is left out."""

    def files(at: str, folder: bool) -> Iterator[tuple[str, int, int]]:
        waiting = [(at, folder)]
        while waiting:
            path, is_folder = waiting.pop()
            try:
                if is_folder:
                    for p, d in _entries(path, suffix):
                        if d:
                            waiting.append((p, d))
                        else:
                            yield from files(p, d)
                else:
                    held = os.stat(path)
                    yield _url(path), held.st_size, held.st_mtime_ns // 1_000_000
            except FileNotFoundError:
                continue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (f for at, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in files(at, folder))
            while some := list(islice(found, NAMED)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _FILE.types, strict=True)], schema=_FILE)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path -> path, length, modified and html of files, as they are when they are read."""
    for batch in batches:
        paths = iter(batch.column(0).to_pylist())
        while some := list(islice(paths, HELD)):
            rows = []
            for path in some:
                with open(unquote(path.removeprefix("file:")), "rb") as f:
                    held, content = os.fstat(f.fileno()), f.read()
                rows.append((path, held.st_size, held.st_mtime_ns // 1_000_000, gzip.decompress(content) if path.endswith(".gz") else content))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_FILE.types, pa.binary()], strict=True)], names=[*_FILE.names, "html"])


def files_below(spark: SparkSession, at: str, suffix: str) -> DataFrame:
    """path, length and modified of each file below a local folder, listed by tasks: Spark's own listing holds a status for every file, about
    1 KB, on the driver. One task names what stands in the folder; all look at the files, and walk the folders below."""
    tasks = spark.sparkContext.defaultParallelism
    top = spark.createDataFrame([(at,)], "at string").coalesce(1).mapInArrow(_named(suffix), "at string, folder boolean")
    found = top.repartition(tasks).mapInArrow(_looked_at(suffix), "path string, length long, modified long")
    return found.withColumn("modified", F.timestamp_millis("modified"))


def read_files(paths: DataFrame, suffix: str) -> DataFrame:
    """path, length, modified, key and html of local files, from their paths (the one column)."""
    dealt = paths.repartition(paths.sparkSession.sparkContext.defaultParallelism)
    read = dealt.mapInArrow(_opened, "path string, length long, modified long, html binary")
    return read.select("path", "length", F.timestamp_millis("modified").alias("modified"), file_key(F.col("path"), suffix).alias("key"), F.col("html").cast("string").alias("html"))


def scan_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, key and html of the pages below a folder."""
    if at := local_path(spark, folder):
        return read_files(files_below(spark, at, suffix).select("path"), suffix).select("path", "key", "html")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), file_key(F.col("_metadata.file_path"), suffix).alias("key"), F.col("value").alias("html"))


def _scan(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return scan_files(spark, folder, suffix).select("key", "html")


def file_key(path: Column, suffix: str) -> Column:
    """The key in a file's name, which Spark gives percent-encoded."""
    name = F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    return F.substring(name, F.lit(1), F.length(name) - len(suffix))


def scan_detail_pages(spark: SparkSession, folder: str, suffix: str = DETAIL) -> DataFrame:
    """key and html of every detail page below a folder; list folders (_list) are hidden from Spark's listing."""
    return _scan(spark, folder, suffix)


def scan_list_pages(spark: SparkSession, *folders: str, suffix: str = LISTED) -> DataFrame:
    """The same for list folders, which are named themselves."""
    found = [_scan(spark, f, suffix) for f in folders]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


#: The landed table; its key.
TABLE, KEY = "pages", ("registry", "kind", "key")


def landed(spark: SparkSession, root: str) -> DataFrame:
    """The landed pages, empty if there are none."""
    return Tables(spark, root).read(TABLE, LANDED, KEY)


def landed_page(spark: SparkSession, root: str, registry: str, kind: str, key: str) -> DataFrame:
    """One page, from its bucket's files and the latest loads alone."""
    safe = spark.range(1).select(safe_key(F.lit(key))).first()[0]
    return Tables(spark, root).read(TABLE, LANDED, KEY, values=(registry, kind, safe))


def to_land(pages: DataFrame) -> DataFrame:
    """pages (registry, kind, key, html, url) with a safe key and its shard."""
    return pages.select(safe_key("key").alias("key"), "html", "url", "registry", "kind", shard_key(safe_key("key")).alias("shard"))


def land_pages(pages: DataFrame, root: str) -> int:
    """Put pages (registry, kind, key, html, url) into a landed table; they replace those of the same registry, kind and key.

    Only the given pages are written. Of several pages of one key the one with the greatest text stays.
    """
    best = to_land(pages).groupBy(*KEY, "shard").agg(F.max(F.struct("html", "url")).alias("p"))
    new = best.select("key", F.col("p.html").alias("html"), F.col("p.url").alias("url"), "registry", "kind", "shard")
    tables = Tables(pages.sparkSession, root)
    rows = tables.write(new, TABLE)
    keys = tables.write_keys(pages.sparkSession.read.schema(LANDED).parquet(f"{tables.root}/{rows['folder']}").select(*KEY), TABLE)
    version = tables.commit(lambda state: _put(tables, state, rows, keys))
    tables.tend(TABLE, LANDED, KEY)
    return version


def _put(tables: Tables, state: dict, rows: dict | None, keys: dict) -> None:
    counts.keep_up(tables, state, TABLE, LANDED, KEY, rows, keys)
    tables.add(state, TABLE, rows, keys)


def count_pages(spark: SparkSession, root: str) -> int:
    """Count the landed pages of each registry and kind; from now on landing and removing keep the counts up."""
    tables = Tables(spark, root)
    return tables.commit(lambda state: False if "counts" in state["notes"] else counts.start(tables, state, TABLE, LANDED, KEY, "concat_ws('/', registry, kind)"))


def page_counts(spark: SparkSession, root: str) -> DataFrame:
    """label (registry/kind) and n of the landed pages, as the newest version notes them."""
    return counts.noted(Tables(spark, root)).where("n > 0").select(F.col("value").alias("label"), "n")


def remove_pages(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Take the pages with the given (registry, kind, key) out of a landed table; returns those of them that were there.

    Their keys are written as a run without rows; the pages themselves go at the next merge.
    """
    tables = Tables(spark, root)
    wanted = kept(keys.select("registry", "kind", safe_key("key").alias("key")).distinct(), "unwanted")
    there = kept(wanted.join(landed(spark, root).select(*KEY), list(KEY), "left_semi"), "removed")
    named = tables.write_keys(wanted.select(*KEY), TABLE)
    tables.commit(lambda state: _put(tables, state, None, named))
    tables.tend(TABLE, LANDED, KEY)
    return there


def merge_pages(spark: SparkSession, root: str) -> int:
    """Merge the latest loads and removals into the landed table's base."""
    return Tables(spark, root).merge(TABLE, LANDED, KEY)


def _shared_key(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in KEY if c in a.columns and c in b.columns]


def has_page(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of (registry, kind, key), those that are landed; where neither side names a registry, (kind, key) decides."""
    on = _shared_key(keys, manifest)
    return keys.join(manifest.select(*on), on, "left_semi")


def drop_pages(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A frame of pages without the given keys, and those of them that were there."""
    return table.join(keys, _shared_key(table, keys), "left_anti"), has_page(keys, table)


def landing_size(spark: SparkSession, folder: str) -> DataFrame:
    """files and bytes below a folder, 0 and 0 if it is missing."""
    if not exists(spark, folder):
        return spark.range(1).select(F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
