"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import path_of, scratch

#: A word is a maximal run without blanks; the six blanks are the ASCII ones.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut() that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/regmill-" in folder:
            fs, path = path_of(df.sparkSession, folder)
            fs.delete(path, True)


def unit_interval(*cols: Column) -> Column:
    """A repeatable number in (0, 1) drawn from the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def numbered(df: DataFrame, order: list[Column], into: str, name: str, weight: Column | None = None) -> DataFrame:
    """df with the 0-based place of each row in a total order (or the sum of the weights before it), without one task seeing all rows.

    Rows are range-partitioned and written; only one sum for each partition meets the driver.
    """
    spark = df.sparkSession
    part, step, start = fresh([*df.columns, into], "part", "step", "start")
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged = cut(ranged.withColumn(step, (F.lit(1) if weight is None else weight).cast("long")), name)
    starts, total = [], 0
    for k, n in sorted((r[0], r[1]) for r in ranged.groupBy(part).agg(F.sum(step)).collect()):
        starts.append((k, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], f"`{part}` int, `{start}` long")
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn(into, F.sum(step).over(within) - F.col(step)).join(offsets, part)
    return placed.withColumn(into, F.col(into) + F.col(start)).drop(part, start, step)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # the driver serves the file as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}-package", "zip", root.parent, root.name))
        _shipped.add(app)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names behind as many underscores as it takes for no column to be called so, letter case aside."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever characters are in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two more columns and their names: the file a row is read from and its place there, the same at every reading.

    A frame that is not a plain reading of files is written to the shared folder first. The names clash with no column.
    """
    names = fresh(df.columns, "file", "row")

    def read(files: DataFrame) -> DataFrame:
        meta = files.metadataColumn("_metadata")
        return files.select("*", F.xxhash64(meta["file_path"]).alias(names[0]), meta["row_index"].alias(names[1]))

    try:
        return read(df), names
    except AnalysisException:
        return read(cut(df, "keyed")), names
