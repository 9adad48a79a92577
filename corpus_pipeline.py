"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of their input. `run` applies them to the whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regmill.llm import bpe, linededup, mixing, neardup, quality
from regmill.llm.common import WORD, fresh, keyed, quoted, ship
from regmill.llm.queries import RANKS, quality_weight, sized, table, with_quality
from regmill.sources.storage import scratch


#: A short document may be a clean one, so the first stage asks for a word only; what it rejects, it rejects for repetition.
MIN_WORDS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    ship(spark)
    return quality.keep(docs, min_words=MIN_WORDS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; a document of which no word is left goes. n_chars follows the text."""
    ship(spark)
    (runs,) = fresh(docs.columns, "runs")
    left = linededup.dedup(docs, into=runs)
    changed = F.col(runs).isNotNull()
    left = left.where(~changed | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id: five words, similarity 0.8."""
    ship(spark)
    rows, keys = keyed(docs)
    found = neardup.near_duplicates(rows.select("doc_id", "text", *keys), size=5, percent=80, keys=keys)
    gone = found.where(~F.col("first")).select(*[F.col(own).alias(k) for own, k in zip(neardup.KEY, keys, strict=True)])
    return rows.join(gone.hint("merge"), keys, "left_anti").select(*quoted(docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a document that is taken n times gives n rows."""
    ship(spark)
    rows, keys = keyed(docs)
    copies, copy = fresh(rows.columns, "copies", "copy")
    rated = with_quality(rows.select("doc_id", "source", *sized("text"), *keys), spark, sf_dir)
    taken = mixing.mix(rated, "doc_id", F.col("_words"), F.col("source"), quality_weight(), content=F.col("_content"), carry=tuple(keys)).where("copies > 0")
    taken = taken.select(*keys, F.col("copies").alias(copies))
    return rows.join(taken.hint("merge"), keys).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*quoted(docs.columns))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, packed, and proof that they decode to the text."""
    ship(spark)
    both = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return both.select("doc_id", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("bpe", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, exponential keys and token merges have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL = None
