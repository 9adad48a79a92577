"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text gets FEATURES, numbers about letters, words, lines and repetition, of the whole text and of nothing else. Trees are fitted
on a sample of labelled documents of SAMPLE rows at most, the smallest hashes of their ids, so that it is the same at every run:
statistics are put into BINS bins at quantiles, and each level of a tree takes, from sums of gradients over bins, the split of every node
with the largest gain in logistic loss. Fitted trees are flattened into arrays, node i's children at 2i + 1 and 2i + 2, and all
trees of all rows of a batch are walked level by level in numpy.

Cases. A null text counts as empty; an empty one has statistics 0 and a score like any other. Equal texts get equal scores. A document
with several labels counts with the largest; labels other than 0 and 1 do not count. Several rows with one id count once in the
sample. Without labels of both kinds there are no trees, and the score is the share of label 1, or 0.5. An empty table gives an empty
result. Other columns stay, whatever their names, but for the one that the result adds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

#: Labelled documents that are fitted on, at most.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 150, 4, 64, 0.1, 1.0, 10

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "blanks": b" \t\n\x0b\x0c\r",
    "stops": b".!?", "commas": b",;:", "symbols": b"#*$%&|<>@=^~_+\\/", "brackets": b"()[]{}\"'`-", "beyond_ascii": bytes(range(128, 256)),
}
_SHARES = np.zeros((256, len(_KINDS)))
for _i, _members in enumerate(_KINDS.values()):
    _SHARES[list(_members), _i] = 1
_BLANK, _UPPER, _LOWER, _MARK, _SIGN = (np.isin(np.arange(256), list(x)) for x in (_KINDS["blanks"], _KINDS["upper"], _KINDS["lower"], b".,;:!?", b"#*$%&|<>!"))
FEATURES = (
    *_KINDS, "bytes", "words", "lines", "entropy", "squeezed", "word_bytes", "longest_word", "short_words", "distinct_words", "commonest_word", "same_as_before",
    "repeated_pairs", "repeated_triples", "capital_words", "loud_words", "marked_words", "symbol_words", "line_words", "repeated_lines", "stopped_lines",
)


def statistics(text: str | None) -> np.ndarray:
    """FEATURES of a text; of an empty one, zeros."""
    raw = (text or "").encode()
    out = np.zeros(len(FEATURES))
    words = raw.split()
    if not words:
        out[len(_KINDS)] = np.log1p(len(raw))
        return out
    n, letters = len(words), np.frombuffer(raw, np.uint8)
    counts = np.bincount(letters, minlength=256)
    share = counts[counts > 0] / len(raw)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    repeated = lambda keys: 1 - len(np.unique(keys)) / len(keys) if len(keys) else 0.0
    pairs = ids[:-1] * len(known) + ids[1:]
    numbered = np.unique(pairs, return_inverse=True)[1] if len(pairs) else pairs
    sizes = np.fromiter(map(len, words), np.int64, n)
    joined = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum(sizes)
    last, upper, lower = joined[end - 1], *(np.logical_or.reduceat(kind[joined], end - sizes) for kind in (_UPPER, _LOWER))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[: len(_KINDS)] = counts @ _SHARES / len(raw)
    out[len(_KINDS) :] = (
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), -(share * np.log2(share)).sum(), len(zlib.compress(raw, 1)) / len(raw), sizes.mean(), np.log1p(sizes.max()),
        (sizes <= 3).mean(), len(known) / n, np.bincount(ids).max() / n, (ids[1:] == ids[:-1]).sum() / n,
        repeated(pairs), repeated(numbered[:-1] * len(known) + ids[2:]) if n > 2 else 0.0, (upper & lower).mean(), (upper & ~lower).mean(),
        _MARK[last].mean(), _SIGN[last].mean(), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in b".!?" for x in lines) / len(lines),
    )
    return out


@dataclass
class Trees:
    """Flat trees: a row of nodes for each; feature -1 marks a leaf. Their values add up to the log odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH if len(self.feature) else 0):
            f = self.feature[tree, node]
            down = 2 * node + 1 + (x[row, np.maximum(f, 0)] > self.threshold[tree, node])
            node = np.where(f < 0, node, down)
        odds = self.base + (self.value[tree, node].sum(axis=1) if len(self.feature) else np.zeros(len(x)))
        return 1 / (1 + np.exp(-odds))


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Where the bins of each statistic end: between distinct values, at quantiles."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="lower"))
        cuts.append((values[1:] + values[:-1]) / 2)
    return cuts


def best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the statistic, the last bin on the left, and the gain of its best split (0 if none helps)."""
    best = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    for f in range(binned.shape[1]):
        key = node * BINS + binned[:, f]
        g, h, n = (np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (gradient, curvature, None))
        loss = lambda g, h: g * g / (h + RIDGE)
        right_g, right_h, right_n = g[:, -1:] - g, h[:, -1:] - h, n[:, -1:] - n
        gain = np.where((n >= LEAST_ROWS) & (right_n >= LEAST_ROWS), loss(g, h) + loss(right_g, right_h) - loss(g[:, -1:], h[:, -1:]), 0)
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > best[0] + 1e-9
        for into, new in zip(best, (top, f, at), strict=True):
            into[better] = new if np.isscalar(new) else new[better]
    return best[1], best[2], best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for rows of statistics and their labels, 0 or 1."""
    nodes = 2 ** (DEPTH + 1) - 1
    share = y.mean() if len(y) else 0.5
    empty = np.zeros((0, nodes))
    if share in (0, 1) or not len(y):
        clipped = np.clip(share, 1e-6, 1 - 1e-6)
        return Trees(float(np.log(clipped / (1 - clipped))), empty.astype(np.int64), empty, empty)
    base = float(np.log(share / (1 - share)))
    edges, odds = edges_of(x), np.full(len(y), base)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    feature, threshold, value = np.full((ROUNDS, nodes), -1), np.zeros((ROUNDS, nodes)), np.zeros((ROUNDS, nodes))
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-odds))
        gradient, curvature, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            inside = node >= first
            chosen, last, gain = best_splits(binned[inside], node[inside] - first, width, gradient[inside], curvature[inside])
            split = np.flatnonzero(gain > 0)
            feature[t, first + split] = chosen[split]
            threshold[t, first + split] = [edges[chosen[i]][last[i]] for i in split]
            moved = inside & (feature[t, node] >= 0)
            node[moved] = 2 * node[moved] + 1 + (x[moved, feature[t, node[moved]]] > threshold[t, node[moved]])
        g, h = np.bincount(node, gradient, nodes), np.bincount(node, curvature, nodes)
        value[t] = -RATE * g / (h + RIDGE)
        odds += value[t, node]
    return Trees(base, feature, threshold, value)


def _statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([statistics(x.as_py()) for x in batch], pa.list_(pa.float64()))

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are kept for judging: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees fitted on the labels (doc_id, label) of documents that are not held out, `sample` of them at most."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_label"))
    rows = docs.select(quoted([doc_id])[0].alias("_id"), quoted([text])[0].cast("string").alias("_text"))
    # labels of documents that are not there do not count against the sample
    there = rows.select("_id").distinct().join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    taken = rows.join(F.broadcast(there), "_id")  # `sample` rows
    found = taken.select("_id", "_label", _statistics(F.col("_text")).alias("_x")).groupBy("_id", "_label").agg(F.min("_x").alias("_x")).orderBy("_id").collect()
    return fit(np.array([r["_x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["_label"] for r in found], float))


def score(df: DataFrame, trees: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """df with the score of every whole text, 0 to 1."""
    model = df.sparkSession.sparkContext.broadcast(trees)  # ROUNDS trees of 2 ** (DEPTH + 1) - 1 nodes

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [np.stack([statistics(x.as_py()) for x in batch.slice(at, 1024)]) for at in range(0, len(batch), 1024)]
            yield pa.array(np.concatenate([model.value.score(x) for x in parts]) if parts else [], pa.float64())

    (made,) = fresh([*df.columns, into], "made")
    names = [c for c in df.columns if c.lower() != into.lower()]
    return df.withColumn(made, run(quoted([text])[0].cast("string"))).select(*quoted(names), F.col(made).alias(into))
