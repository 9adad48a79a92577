"""Counts of tables, by a value of few kinds, that changes keep up.

A version notes how many rows each counted table has for each value of an expression. A change adds the rows that are new and takes off
those that its keys replace, as they stand in the very version that it goes on top of; so the counts hold after repeated keys, lists that
shrink, removals, replays, and loads at one time. Reading them opens no file of a table. Merging, folding and packing do not touch them.

A change of few keys looks for earlier rows in their buckets only; one of more keys joins the keys and the counted columns of the table with its own.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .storage import Tables

#: Values that a table may be counted by, as all counts are in the version's file; keys that are looked for in their buckets.
VALUES, FEW = 1000, 200
COUNTS = "table string, value string, n long"


def _counted(rows: DataFrame, by: str) -> Counter:
    found = rows.groupBy(F.expr(by).cast("string").alias("value")).agg(F.count("*").alias("n")).limit(VALUES + 1).collect()
    return Counter({r["value"]: r["n"] for r in found})


def _note(state: dict, name: str, by: str, counts: Counter) -> None:
    left = [[v, n] for v, n in sorted(counts.items(), key=lambda e: (e[0] is not None, e[0])) if n]
    if len(left) > VALUES:
        raise ValueError(f"{name} has more than {VALUES} values of {by}")
    state["notes"].setdefault("counts", {})[name] = {"by": by, "n": left}


def start(tables: Tables, state: dict, name: str, schema: StructType, key: tuple[str, ...], by: str) -> None:
    """Count a table of the state by an expression; from now on `keep_up` changes what is noted."""
    _note(state, name, by, _counted(tables.read(name, schema, key, state), by))


def _replaced(tables: Tables, state: dict, name: str, schema: StructType, key: tuple[str, ...], keys: dict) -> DataFrame:
    """The rows of the state's table that a run's keys take the place of."""
    held = StructType([StructField(f"_k{i}", schema[c].dataType) for i, c in enumerate(key)])
    named = tables.rows_in(keys, held).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)])
    few = [r[0] for r in named.select(key[-1]).limit(FEW + 1).collect()]
    if len(few) > FEW:
        return tables.read(name, schema, key, state).join(named, list(key), "left_semi")
    base = state["tables"][name]["base"]
    at = named.select(F.pmod(F.xxhash64(*key), F.lit(base["buckets"]))).distinct().collect() if base else []
    there = tables.read(name, schema, key, state, buckets=sorted(r[0] for r in at)).where(F.col(key[-1]).isin(few))
    return there.join(named, list(key), "left_semi")


def keep_up(tables: Tables, state: dict, name: str, schema: StructType, key: tuple[str, ...], rows: dict | None, keys: dict | None) -> None:
    """Note what a run (rows, or None; keys, or None for rows that are appended) changes, before it is put on top of the state's table."""
    held = state["notes"].get("counts", {}).get(name)
    if held is None:
        return
    counts = Counter({v: n for v, n in held["n"]})
    if rows:
        counts.update(_counted(tables.rows_in(rows, schema), held["by"]))
    if keys and name in state["tables"]:
        counts.subtract(_counted(_replaced(tables, state, name, schema, key, keys), held["by"]))
    _note(state, name, held["by"], counts)


def noted(tables: Tables, state: dict | None = None) -> DataFrame:
    """table, value, n of a version, the newest if none is given; a counted table without rows has one row, with 0."""
    held = (tables.state() if state is None else state)["notes"].get("counts")
    if held is None:
        raise ValueError("these tables are not counted")
    return tables.spark.createDataFrame([(name, v, n) for name, c in held.items() for v, n in c["n"] or [[None, 0]]], COUNTS)
