"""Tables in the catalog that are joined where they lie: bucketed by the key that they have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .schemas import CHILDREN


def save_bucketed(df: DataFrame, table: str, by: str, buckets: int, then: tuple[str, ...] = (), where: str | None = None) -> DataFrame:
    """df as a catalog table in buckets of a column, each one file, sorted by it and then by others."""
    writer = df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by, *then)
    (writer.option("path", where) if where else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def save_companies(companies: DataFrame, children: dict[str, DataFrame], prefix: str, buckets: int, root: str | None = None) -> dict[str, DataFrame]:
    """Companies and their children in the same buckets: their joins by the number need no shuffle, however often they are run."""
    at = lambda name: f"{root}/{name}" if root else None
    out = {"companies": save_bucketed(companies, f"{prefix}_companies", "number", buckets, where=at("companies"))}
    for child in CHILDREN:
        out[child.name] = save_bucketed(children[child.name], f"{prefix}_{child.name}", child.parent, buckets, ("seq",), at(child.name))
    return out
