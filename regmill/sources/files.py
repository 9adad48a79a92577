"""Typed CSV and the JSON-lines error log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .storage import exists

_CSV = {"header": "true", "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: Texts of backslashes only: the field of a text that is empty or such a one has one backslash more, as an empty field is null.
_BACKSLASHES = r"\A\\+\z"


def _each_text(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    col = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    return df.select(*[change(col(f)).alias(f.name) if isinstance(f.dataType, StringType) else col(f) for f in df.schema])


def read_typed_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and doubled quotes; line breaks may stand in quotes, empty fields are null, and a backslash alone is an empty text."""
    found = spark.read.schema(schema).options(**_CSV, multiLine="true").csv(path)
    return _each_text(found, lambda c: F.when(c.rlike(_BACKSLASHES), F.substring(c, F.lit(2), F.length(c))).otherwise(c))


def write_typed_csv(df: DataFrame, path: str) -> None:
    """Dates as ISO 8601, booleans as true and false, null as an empty field, an empty text as a backslash. Line breaks are quoted; \\r and
    white space at the ends are kept by quoting all text."""
    marked = _each_text(df, lambda c: F.when((c == "") | c.rlike(_BACKSLASHES), F.concat(F.lit("\\"), c)).otherwise(c))
    marked.write.options(**_CSV, emptyValue="", quoteAll="true", nullValue="").csv(path)


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """The distinct numbers in a log of JSON lines, ascending; other lines are skipped, a missing log is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "number int")
    number = F.from_json("value", "number string")["number"].try_cast("int")
    return spark.read.text(path).select(number.alias("number")).where("number IS NOT NULL").distinct().orderBy("number")


def error_lines(outcomes: DataFrame) -> DataFrame:
    """One JSON object for each failed attempt: number, error, time."""
    at = F.date_format("attempted_at", "yyyy-MM-dd'T'HH:mm:ss")
    return outcomes.where("kind = 'error'").select(F.to_json(F.struct("number", "error", at.alias("at"))).alias("value"))


def append_error_log(outcomes: DataFrame, path: str) -> None:
    error_lines(outcomes).write.mode("append").text(path)
