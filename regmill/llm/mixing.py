"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight. Within a source documents stand in key
order; complete epochs come first, and the rest of the source's token budget is filled by the documents whose
midpoint in the running sum of sizes lies within it, so a source misses its target by half a document at most.

Sources are ordered by code point, null last, and take their weights from a repeating list. Targets are
weight-proportional shares of the budget, held to `cap` times the source's size. The running sums come from range
partitions of all rows by source and key: whatever the weights, a source is spread over as many tasks as it needs.

Cases. Null or negative sizes count as 0; documents of size 0 are taken 0 times; a null weight is 1, weights below
1e-9 are 1e-9. The draw depends on id, size and content, so reruns agree; rows that agree in all three (null ids
too) draw one by one, by their place in the files, and which of such equal rows is taken means nothing. An empty
table gives an empty result. Columns other than those named are not looked at; carried ones may have any names but
those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, numbered, quoted, unit_interval

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """`source`, `source_size` -> also `_rank`, `_start` (the sizes of earlier sources) and `target`; every step is a sum over the table, no source list meets the driver."""
    ordered = [F.asc_nulls_last("source")]
    ranked = numbered(sources, ordered, "_rank", "source-order")
    ranked = cut(numbered(ranked, ordered, "_start", "source-starts", F.col("source_size")), "ranked")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    limit = cap * F.col("source_size")
    total, weight_sum = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    level, budget = (share * total / weight_sum if weight_sum else 0.0), share * total
    while True:  # each round caps at least one more source, and few rounds cap all that are above
        full = limit <= weight * F.lit(level)
        held, free = ranked.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0))).first()
        raised = (budget - held) / free if free else level
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(limit.cast("double"), weight * F.lit(level)))


def mix(
    docs: DataFrame, doc_id: str, size: Column, source: Column, weight: Column, weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, cap: int = CAP, seed: int = 0, content: Column | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies, and the carried columns."""
    row_size = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    ident = quoted([doc_id])[0]
    base = docs.select(
        ident.alias("doc_id"), row_size.alias("size"), source.cast("string").alias("source"), F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1e-9)).alias("w"),
        F.xxhash64(F.lit(seed), ident, row_size, F.lit(0) if content is None else content).alias("h"), F.struct(F.lit(0).alias("none"), *quoted(list(carry))).alias("carried"),
    )
    base, place = keyed(cut(base, "mix"))
    aims = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    repeated = cut(base.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("again")), "repeated")
    known = aims.withColumnRenamed("source", "_source")
    rows = base.join(repeated, "h", "left").join(known, F.col("source").eqNullSafe(F.col("_source")))
    alone, among = unit_interval(F.col("h")), unit_interval(F.col("h"), *place)
    drawn = rows.withColumn("key", -F.log(F.when(F.col("again"), among).otherwise(alone)) / F.col("w")).drop("_source", "source", "w", "again")
    placed = numbered(drawn, [F.asc("_rank"), F.asc("key"), F.asc("h"), *place], "at", "key-order", F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("at") - F.col("_start") + F.col("size") / 2 <= rest).cast("long")
    copies = F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(F.lit(0)).cast("long")
    taken = placed.withColumn("epochs", epochs).withColumn("copies", copies)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[F.col("carried")[c].alias(c) for c in carry])
