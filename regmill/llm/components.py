"""Connected components of an edge table, without a vertex or edge list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """`a`, `b` (longs) -> `nid`, `label`: each vertex with the smallest vertex that it reaches.

    Every round takes the smallest label among the neighbours, then follows the label of the label, so long chains
    shorten fast. Each round is written to the shared folder. An empty table gives an empty one.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("nid")).agg(F.min("b").alias("m")).select("nid", F.least("nid", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("a") == F.col("nid")).groupBy(F.col("b").alias("_n")).agg(F.min("label").alias("_m"))
        hop = cut(labels.join(seen, F.col("nid") == F.col("_n")).select("nid", "label", F.least("label", "_m").alias("_to")), "hop")
        up = hop.select(F.col("nid").alias("_n"), F.col("_to").alias("_up"))
        after = cut(hop.join(up, F.col("_to") == F.col("_n")).select("nid", F.col("label").alias("_old"), F.col("_up").alias("label")), "labels")
        changed = not after.where("label <> _old").isEmpty()
        drop_cut(hop)
        drop_cut(labels)
        labels = after.select("nid", "label")
        if not changed:
            return labels
