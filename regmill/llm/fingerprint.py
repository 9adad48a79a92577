"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame operations.

A sketch is the sorted array of the K smallest distinct 64-bit hashes of a text's shingles (five words; a shorter
text is one shingle; a text without words has an empty sketch). Sketches of parts merge into the sketch of
the whole, and estimate resemblance, containment and the number of distinct shingles.

Cases. Null texts count as empty. Equal texts have equal sketches. In the order of documents null ids come last, and
rows that share an id, null or not, stand in an order of their places in the files, whatever their number; the next
of a lone document is itself. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, numbered

K = 128
SHINGLE = 5
#: Rows of a block, and how many blocks the driver lists at most; beyond 500 million rows blocks grow.
ROWS_PER_BLOCK = 4096
MAX_BLOCKS = 1 << 17


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once, as lambdas do not share subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text. Every word is hashed once, and a shingle is the hash of its words' hashes."""

    def of(h: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(h) - shingle)
        shingles = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(shingles)), 1, k))

    return _bind(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact where both sketches hold all shingles. Two empty ones are alike."""
    union = F.array_sort(F.array_union(a, b))
    seen = F.when((F.size(a) < k) & (F.size(b) < k), union).otherwise(F.slice(union, 1, k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), seen)) / F.size(seen))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_string(a: Column) -> Column:
    """The hashes as big-endian bytes, in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _bounds(rows: DataFrame, place: list[str]) -> list[dict]:
    """The first row of every block of the order: blocks of equal size, MAX_BLOCKS of them at most.

    Rows are numbered by id and place alone, so no text moves, and rows that share an id are cut like any others.
    """
    each = max(ROWS_PER_BLOCK, -(-rows.count() // MAX_BLOCKS))
    keys = rows.select(_order_key(place).alias("key"))
    placed = numbered(keys, [F.asc("key")], "at", "order")
    return [r.key.asDict() for r in placed.where(F.col("at") % each == 0).orderBy("at").select("key").collect()]


def _order_key(place: list[str]) -> Column:
    """Descending ids, null last, and rows of one id by a hash of their place, as one ascending value."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(0)).alias("id"), F.xxhash64(*place).alias("tie"))


def _block(key: Column, known: Column, n: int) -> Column:
    """The block of a row: how many of the n sorted bounds after the first are not above its key, by bisection."""
    ends = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_ = a["lo"] < a["hi"]
        right = open_ & (F.get(known, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), ends, halve)["lo"] - 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row (doc_id, text): its sketch, its edited text's, the next document's, and the edited text's hash and the length.

    The order is cut into blocks of rows, each one group of a window. The first row of each block is known by its key;
    its text and sketch go to the last row of the block before it, and the first row of all follows the last.
    """
    rows, place = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    bounds = _bounds(rows, place)
    n = max(1, len(bounds))
    known = F.from_json(F.lit(json.dumps(bounds)), "array<struct<none:boolean,id:bigint,tie:bigint>>")
    rows = rows.withColumn("key", _order_key(place)).withColumn("block", _block(F.col("key"), known, len(bounds)))
    heads = rows.where(F.col("key") == F.get(known, F.col("block")))
    heads = heads.groupBy(F.pmod(F.col("block") - 1, F.lit(n)).alias("block")).agg(F.min("text").alias("head")).withColumn("head_sketch", sketch(F.col("head")))
    order = Window.partitionBy("block").orderBy("key", *place)
    paired = rows.withColumn("is_last", F.lead(F.lit(1)).over(order).isNull()).withColumn("next", F.lead("text").over(order)).join(heads, "block", "left")
    length = F.length("text")
    moved = F.floor(length / 3).cast("int")
    following = F.when(F.col("is_last"), F.col("head")).otherwise(F.col("next"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - moved), F.substring(following, F.lit(1), moved))
    sketched = paired.select(
        "block", "key", *place, "doc_id", "is_last", "head_sketch",
        length.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), sketch(F.col("text")).alias("sketch"), sketch(edited).alias("edited_sketch"),
    )
    following = F.when(F.col("is_last"), F.col("head_sketch")).otherwise(F.lead("sketch").over(order))
    return sketched.withColumn("next_sketch", following).select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")
