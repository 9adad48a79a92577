"""A uniform shuffle into shards of exact sizes, in DataFrame operations.

Rows are dealt to even partitions by a hash of their stored row number. A hypergeometric communication matrix
says how many rows each partition sends to each shard: it is drawn on the driver from the partition counts
alone (at most `MAX_PARTITIONS` integers), so shard sizes are exact. Each partition permutes its rows, sends
consecutive stretches to the shards, and each shard permutes what it got. Shard sizes differ by one at most.
No column takes part in the draw: nulls, equal keys, very long texts and repeated rows are rows like any other; an
empty table gives an empty result. All columns stay, whatever their names, but for a `shard` or `slot`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, quoted

MAX_PARTITIONS = 1 << 16
ROWS_PER_PARTITION = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` of good + bad."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    # numpy stops at 1e9: invert the distribution function around the mode, by ratios of neighbouring terms
    mode = int((drawn + 1) * (good + 1) // (good + bad + 2))
    spread = int(12 * math.sqrt(drawn * (good / (good + bad)) * (bad / (good + bad))) + 20)
    k = np.arange(max(0, drawn - bad, mode - spread), min(good, drawn, mode + spread) + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k[:-1]) * (drawn - k[:-1])) - np.log((k[:-1] + 1) * (bad - drawn + k[:-1] + 1)))])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def communication_matrix(counts: list[int], shards: int, seed: int) -> tuple[list[list[int]], list[int]]:
    """Rows that each partition sends to each shard, and the shards' sizes: a uniform draw given both margins."""
    rng, total = np.random.default_rng(seed), sum(counts)
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    room, matrix = list(sizes), []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for i in range(shards):
            rest -= room[i]
            row.append(hypergeometric(rng, room[i], rest, left))
            left -= row[-1]
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix, sizes


def shard(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """rows with `shard` (0 to shards-1) and `slot` (0 to the shard's size - 1); columns of these names are replaced."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    rid, part, edge, place, block, start = fresh([*names, "shard", "slot", "count"], "rid", "part", "edges", "place", "block", "start")
    stored = cut(rows.select(*quoted(names), F.monotonically_increasing_id().alias(rid)), "rows")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(MAX_PARTITIONS, max(2 * width, math.ceil(stored.count() / ROWS_PER_PARTITION)))
    draw = lambda i: F.xxhash64(F.lit(seed * 4 + i), rid)
    dealt = stored.withColumn(part, F.pmod(draw(0), F.lit(partitions)))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.count("*")).collect())
    matrix, _ = communication_matrix([n for _, n in counts], shards, seed)
    edges = spark.createDataFrame(
        [(p, np.cumsum(row)[:-1].tolist()) for (p, _), row in zip(counts, matrix, strict=True)] or [(0, [])],
        f"`{part}` bigint, `{edge}` array<bigint>",
    )
    local = Window.partitionBy(part).orderBy(draw(1), rid)
    sent = cut(
        dealt.withColumn(place, F.row_number().over(local) - 1)
        .join(edges, part)
        .withColumn("shard", F.size(F.filter(edge, lambda e: e <= F.col(place))))
        # the second permutation is a random order too; its leading part splits a shard among tasks
        .withColumn(block, F.pmod(draw(2), F.lit(max(1, partitions // shards))))
        .drop(edge, place, part),
        "sent",
    )
    drop_cut(stored)
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sent.groupBy("shard", block).agg(F.count("*").alias(place))
    starts = sizes.select("shard", block, (F.sum(place).over(before) - F.col(place)).alias(start))
    inside = Window.partitionBy("shard", block).orderBy(draw(3), rid)
    slotted = sent.withColumn("slot", F.row_number().over(inside) - 1).join(starts, ["shard", block])
    return slotted.select(*quoted(names), "shard", (F.col("slot") + F.col(start)).cast("long").alias("slot"))
