"""A trigram index over searched columns: which records may hold a pattern, without a scan of their table.

For each searched column of a record the distinct trigrams of its lower-cased text are kept as rows (gram, key), in buckets by
gram. A pattern's literal pieces, between its wildcards, must stand in a matching text, so all their trigrams must; the index reads
the postings of the RAREST of them, and records with all of those come back for the exact comparison. Numbers of postings
only choose which trigrams are read, so they may be out of date. A pattern without a piece of three characters has no trigram:
the table is scanned for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.schemas import TABLES
from ..sources.storage import Tables

#: Table -> the columns in which its searches look for a pattern.
SEARCHED = {"companies": ("name",), "lobbyist_registrations": ("contact_name", "firm_name")}
#: Postings lists that a search reads; records that are fetched by their buckets, and not by a scan for their keys.
RAREST, FEW = 3, 200

POSTINGS = StructType([StructField("key", StringType()), StructField("column", StringType()), StructField("gram", StringType())])
COUNTS = StructType([StructField("gram", StringType()), StructField("n", LongType())])


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text."""
    letters = F.split(F.lower(text), "")
    three = lambda s, i: F.concat(F.get(s, i), F.get(s, i + 1), F.get(s, i + 2))
    made = F.transform(F.array(letters), lambda s: F.when(F.size(s) > 2, F.transform(F.sequence(F.lit(0), F.size(s) - 3), lambda i: three(s, i))))
    return F.array_distinct(F.get(made, F.lit(0)))


def postings(rows: DataFrame, name: str) -> DataFrame:
    """The trigrams of a table's rows: key, column, gram."""
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in SEARCHED[name]])).alias("t")
    each = rows.select(F.col(TABLES[name].key[0]).alias("key"), texts).where("t.text IS NOT NULL")
    return each.select("key", "t.column", F.explode(grams(F.col("t.text"))).alias("gram"))


def counts(made: DataFrame) -> DataFrame:
    return made.groupBy("gram").agg(F.count("*").alias("n"))


def pattern_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams that a text must hold to match '%query%', % and _ in it being wildcards."""
    lowered = spark.range(1).select(F.lower(F.lit(f"%{query}%"))).first()[0]
    return sorted({piece[i : i + 3] for piece in re.split("[%_]", lowered) for i in range(len(piece) - 2)})


def index_name(name: str) -> str:
    return f"{name}-grams"


def counts_name(name: str) -> str:
    return f"{name}-gram-counts"


def candidates(tables: Tables, name: str, query: str, state: dict) -> DataFrame | None:
    """The keys of records of which a searched column may match '%query%'; null if the index can't tell."""
    spark, wanted = tables.spark, pattern_grams(tables.spark, query)
    if not wanted:
        return None
    known = tables.read(counts_name(name), COUNTS, state=state).where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n"))
    often = {r["gram"]: r["n"] for r in known.collect()}  # a row for each trigram of the pattern
    rarest = sorted(wanted, key=lambda g: (often.get(g, 0), g))[:RAREST]
    held = state["tables"].get(index_name(name), {}).get("base")
    buckets = None
    if held:
        at = spark.createDataFrame([(g,) for g in rarest], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(held["buckets"])))
        buckets = sorted({r[0] for r in at.collect()})
    found = tables.read(index_name(name), POSTINGS, ("key",), state, buckets=buckets).where(F.col("gram").isin(rarest))
    return found.groupBy("key", "column").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key").distinct()
