"""Byte-level BPE encoding and decoding by a local rank file.

Ids travel as packed little-endian unsigned 32-bit integers (`binary`), four bytes a token; `unpacked`
gives them as `array<long>`. Null texts count as empty and give no ids; empty texts give no ids; decoding
null ids gives no bytes; unknown ids raise. Equal texts get equal ids, repeated rows are rows like any other, an empty
table gives an empty result. Other columns stay, whatever their names, but for those that the result adds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted

#: White space as the pattern's \s knows it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Between a character that is no white space and a blank a match always ends, and what follows is matched as if it stood
#: alone; so it is between letters of scripts that are written without blanks and their stops.
_SAFE = re.compile("[^\\s](?=[ \\n])|[\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3](?=[\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b])")
#: Runs of white space too long for a backtracking matcher.
_LONG_RUN = re.compile(f"[{_SPACE}]{{20000,}}")
WINDOW = 1 << 16


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_parts(text: str, window: int = WINDOW) -> Iterator[tuple[str, bool]]:
    """The text in parts that are encoded alone; True marks one that is a single match of the pattern."""
    at = 0
    while at < len(text):
        found = _SAFE.search(text, at + window) if len(text) - at > window else None
        end = found.end() if found else len(text)
        run = _LONG_RUN.search(text, at, end)
        if run:
            if run.start() > at:
                yield text[at : run.start()], False
            # the last blank of a run belongs to what follows, unless the text ends there
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
        else:
            yield text[at:end], False
            at = end


def encode_text(enc: tiktoken.Encoding, text: str | None) -> bytes:
    out = []
    for part, whole in safe_parts(text or ""):
        ids = enc._core_bpe.encode_single_piece(part.encode()) if whole else enc.encode_to_numpy(part, disallowed_special=())
        out.append(np.asarray(ids, "<u4").tobytes())
    return b"".join(out)


def decode_ids(enc: tiktoken.Encoding, ids: bytes | None) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist())


def _joined(parts: list[bytes]) -> pa.Array:
    """The parts as one binary array: their bytes are copied once."""
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])
    return array.cast(pa.binary())


def _udf(spark: SparkSession, rank_path: str, pattern: str, one):
    with open(rank_path, "rb") as f:  # a vocabulary file, of fixed size
        ranks = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoding(ranks.value, pattern)
        for batch in batches:
            yield _joined([one(enc, x.as_py()) for x in batch])

    return run


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the packed ids of its whole texts."""
    return df.withColumn(into, _udf(df.sparkSession, rank_path, pattern, encode_text)(F.col(text)))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the raw bytes that the packed ids stand for; they need not be valid UTF-8."""
    return df.withColumn(into, _udf(df.sparkSession, rank_path, pattern, decode_ids)(F.col(ids)))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with `ids` and with `decoded`, the bytes decoded from those ids: both steps in one worker, which keeps one vocabulary."""
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("ids binary, decoded binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoding(ranks.value, pattern)
        for batch in batches:
            ids = _joined([encode_text(enc, x.as_py()) for x in batch])
            decoded = _joined([decode_ids(enc, x.as_py()) for x in ids])
            yield pa.StructArray.from_arrays([ids, decoded], names=["ids", "decoded"])

    names = [c for c in df.columns if c.lower() not in ("ids", "decoded")]
    (both,) = fresh(names, "both")
    coded = df.withColumn(both, run(quoted([text])[0].cast("string")))
    return coded.select(*quoted(names), F.col(f"{both}.ids"), F.col(f"{both}.decoded"))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers, in Spark alone."""
    digits = F.hex(ids)
    at = lambda i, k: F.substring(digits, i * 8 + (7 - 2 * k), 2)
    one = lambda i: F.conv(F.concat(*[at(i, k) for k in range(4)]), 16, 10).cast("long")
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), one)
    )
