"""Running counters of crawl outcomes, kept as the state of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.planning import outcome_stats
from ..sources.storage import exists

OUTCOMES = "kind string, ids_saved array<string>"


def count_outcomes(spark: SparkSession, folder: str, where: str, checkpoint: str, files_per_batch: int = 1_000) -> None:
    """Take up the outcomes (Parquet with kind and ids_saved) that arrived in a folder, and write the counters over all so far to `where`.

    The state is one row of counters, whatever was counted. Each batch writes the folder of its own number, so a replay writes the same again.
    """
    stream = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = (
        outcome_stats(stream).writeStream.outputMode("complete")
        .foreachBatch(lambda counters, n: counters.coalesce(1).write.mode("overwrite").parquet(f"{where}/batch={n}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def outcomes_so_far(spark: SparkSession, where: str) -> DataFrame:
    """The counters after the last batch; all zero if there was none."""
    if not exists(spark, where):
        return outcome_stats(spark.createDataFrame([], OUTCOMES))
    counters = spark.read.parquet(where)
    return counters.orderBy(F.desc("batch")).limit(1).drop("batch")
