"""Blocked Bloom filters: every key sets its bits in one cache line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 64-bit words in a block: one cache line
PROBES = 8
BITS_PER_ENTRY = 16
MAX_FILTER_BYTES = 8 << 20


def _probe(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bit mask (WORDS words) of each hash."""
    h = hashes.astype(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    masks, low = np.zeros((len(h), WORDS), np.uint64), h & np.uint64(0xFFFFFFFF)
    step = (low * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for i in range(PROBES):
        bit = (low + step * np.uint64(i + 1)) >> np.uint64(55)  # 512 bits in a block
        np.bitwise_or.at(masks, (np.arange(len(h)), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return block.astype(np.int64), masks


class BlockedBloom:
    def __init__(self, entries: int):
        self.table = np.zeros((size_of(entries), WORDS), np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        block, masks = _probe(hashes, len(self.table))
        np.bitwise_or.at(self.table, block, masks)

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = _probe(hashes, len(self.table))
        return ((self.table[block] & masks) == masks).all(axis=1)


def size_of(entries: int) -> int:
    """Blocks of the filter of so many entries."""
    return max(1, entries * BITS_PER_ENTRY // (WORDS * 64))


def blocks(hashes: DataFrame, entries: int) -> DataFrame:
    """The filter for a column of hashes, as a table of its blocks that have bits: block, words."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, masks = _probe(b.column(0).to_numpy().astype(np.int64).view(np.uint64), size_of(entries))
            yield pa.record_batch({"block": pa.array(block)} | {f"w{i}": pa.array(masks[:, i].view(np.int64)) for i in range(WORDS)})

    names = [f"w{i}" for i in range(WORDS)]
    rows = hashes.mapInArrow(bits, "block long, " + ", ".join(f"{w} long" for w in names))
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]).select("block", F.array(*names).alias("words"))


def built(hashes: DataFrame, entries: int) -> np.ndarray:
    """The filter's table on the driver; it has MAX_FILTER_BYTES at most."""
    rows = blocks(hashes, entries).toPandas()
    bloom = BlockedBloom(entries)
    if len(rows):
        bloom.table[rows["block"].to_numpy(np.int64)] = np.stack(rows["words"].to_numpy()).astype(np.int64).view(np.uint64)
    return bloom.table


def block_of(h: Column, entries: int) -> Column:
    """The block of a hash, as _probe has it."""
    return F.shiftrightunsigned(h, 32) % F.lit(size_of(entries))


def in_block(h: Column, words: Column) -> Column:
    """Whether a block's words hold the bits of a hash."""

    @F.arrow_udf("boolean")
    def held(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hashes, rows in batches:
            masks = _probe(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 1)[1]
            there = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, WORDS)
            yield pa.array(((there & masks) == masks).all(axis=1))

    return held(h, words)


def fits(entries: int) -> bool:
    """Whether the filter of so many entries may be sent to every executor."""
    return entries * BITS_PER_ENTRY // 8 <= MAX_FILTER_BYTES


def possible(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df without most of the rows whose `on` columns are not among the keys; all of df if the keys are too many for a filter.

    It goes before a join that would move wide rows; the join still decides.
    """
    entries = keys.count()
    if not fits(entries):
        return df
    table = df.sparkSession.sparkContext.broadcast(built(keys.select(F.xxhash64(*on).alias("h")), max(1, entries)))

    @F.arrow_udf("boolean")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bloom = BlockedBloom(1)
        bloom.table = table.value
        for b in batches:
            yield pa.array(bloom.might_hold(b.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return df.where(held(F.xxhash64(*on)))
