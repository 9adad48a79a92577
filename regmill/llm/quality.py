"""Quality rules: repetition inside a document, found with a suffix array over its words.

Longest-common-prefix intervals give the maximal repeated word runs; their spans are united, and a document
fails if the union covers too much of it or the longest repeat is too long. Null texts have no words. A
document with fewer than `min_words` fails the base rules. Equal texts get equal rows. A very
long text is a batch of its own. An empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, quoted
from .suffix import Suffixes

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which the base rules reject.
MAX_TRIGRAM_PERCENT = 50
#: Shortest repeat that counts, in words; percent of words that repeats may cover; longest repeat, in words.
MIN_REPEAT = 10
MAX_COVERED_PERCENT = 30
MAX_REPEAT = 200

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
#: Words that are sorted together; a longer document is a batch of its own.
BATCH_WORDS = 400_000


def _line_copies(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    n = len(texts)
    out = {f.split()[0]: np.zeros(n, np.int64) for f in SCHEMA.split(", ")}
    known: dict[bytes, int] = {}
    ids: list[int] = []
    lengths: list[int] = []
    first = 0

    def flush(upto: int) -> None:
        nonlocal ids, lengths, first
        if ids:
            seq = np.repeat(np.arange(len(lengths)), lengths)
            s = Suffixes(np.array(ids, np.int64), seq)
            out["n_repeat_words"][first:upto] = np.bincount(seq, s.covered(s.grams(s.live[min(1, len(s.live) - 1)]), 3), len(lengths))
            at, most = s.longest(MIN_REPEAT)
            out["covered_words"][first:upto] = np.bincount(seq, s.covered(at, most), len(lengths))
            longest = np.zeros(len(lengths), np.int64)
            np.maximum.at(longest, seq[at], most)
            out["longest_repeat"][first:upto] = longest
        known.clear()
        ids, lengths, first = [], [], upto

    for i, text in enumerate(texts):
        text = text or ""
        words = text.encode().split()  # bytes split at the six ASCII blanks
        if ids and len(ids) + len(words) > BATCH_WORDS:
            flush(i)
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        out["n_dup_lines"][i] = _line_copies(text)
        ids += [known.setdefault(w, len(known)) for w in words]
        lengths.append(len(words))
    flush(n)
    return out


def _in_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = measure(batch.to_pylist())
        yield pa.StructArray.from_arrays([pa.array(x) for x in found.values()], names=list(found))


def _measured(text: Column) -> Column:
    return F.arrow_udf(_in_batches, SCHEMA)(text)


def _judged(df: DataFrame, text: str, min_words: int) -> tuple[DataFrame, str, Column, Column]:
    """df with a column of its measures, that column's name, and two verdicts on it: base rules failed, kept."""
    (name,) = fresh(df.columns, "measures")
    m = lambda x: F.col(f"{name}.{x}")
    words = m("n_words")
    failed = (words < min_words) | (100 * m("n_repeat_words") > MAX_TRIGRAM_PERCENT * words)
    repeats = (100 * m("covered_words") > MAX_COVERED_PERCENT * words) | (m("longest_repeat") > MAX_REPEAT)
    return df.withColumn(name, _measured(quoted([text])[0].cast("string"))), name, failed, ~failed & ~repeats


def judge(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with the measures of SCHEMA, base_failed and kept; columns of these names are replaced."""
    judged, name, failed, kept = _judged(df, text, min_words)
    measures = [f.split()[0] for f in SCHEMA.split(", ")]
    made = {*measures, "base_failed", "kept"}
    own = quoted([c for c in df.columns if c.lower() not in made])
    return judged.select(*own, *[F.col(f"{name}.{c}").alias(c) for c in measures], failed.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that the rules keep, columns unchanged."""
    judged, name, _, kept = _judged(docs, text, min_words)
    return judged.where(kept).drop(name)
