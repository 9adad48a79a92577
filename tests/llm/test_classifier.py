"""Quality classifier: trees against plain walks and plain searches, statistics by hand, held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmill.llm import classifier as C
from regmill.llm import queries


def _plain_walk(trees, row):
    odds = trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while f[node] >= 0:
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        odds += v[node]
    return 1 / (1 + np.exp(-odds))


@pytest.fixture(scope="module")
def drawn():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(700, 5)), 1)
    return x, ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)


def test_flat_trees_equal_plain_walks(drawn):
    trees = C.fit(*drawn)
    assert np.allclose(trees.score(drawn[0]), [_plain_walk(trees, row) for row in drawn[0]])
    assert ((trees.score(drawn[0]) > 0.5) == drawn[1]).mean() > 0.97


def test_the_best_split_of_bins_is_the_best_of_all(drawn):
    x, y = drawn
    edges = C.edges_of(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    g, h = 0.4 - y, np.full(len(y), 0.24)
    (f,), (at,), (gain,) = C.best_splits(binned, np.zeros(len(y), np.int64), 1, g, h)
    loss = lambda m: g[m].sum() ** 2 / (h[m].sum() + C.RIDGE)
    every = np.ones(len(y), bool)
    plain = [loss(c <= e) + loss(c > e) - loss(every) for c, es in zip(x.T, edges, strict=True) for e in es if min((c <= e).sum(), (c > e).sum()) >= C.LEAST_ROWS]
    assert np.isclose(gain, max(plain)) and np.isclose(gain, loss(x[:, f] <= edges[f][at]) + loss(x[:, f] > edges[f][at]) - loss(every))


def test_statistics():
    named = lambda t: dict(zip(C.FEATURES, C.statistics(t), strict=True))
    assert not C.statistics(None).any() and not C.statistics("").any() and named(" \n")["words"] == 0
    s = named("Ab cd, ab cd ab\nXY 12 é\nXY 12 é.")
    assert np.isclose(s["words"], np.log1p(11)) and np.isclose(s["lines"], np.log1p(3)) and s["repeated_lines"] == 0
    assert np.isclose(s["distinct_words"], 8 / 11) and np.isclose(s["commonest_word"], 2 / 11) and np.isclose(s["loud_words"], 2 / 11)
    assert np.isclose(s["capital_words"], 1 / 11) and np.isclose(s["marked_words"], 2 / 11) and np.isclose(s["stopped_lines"], 1 / 3)
    assert named("a a a a")["same_as_before"] == 0.75 and named("x|")["symbol_words"] == 1
    assert len(C.statistics("long " * 300_000)) == len(C.FEATURES)


def test_samples_and_labels(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40 + 1) if i % 2 else "&& " * (i % 40 + 1), "x") for i in range(400)] * 2 + [(None, "a", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 0), (None, 1), (3, 7), (10**9, 1)], "doc_id long, quality int")
    trees = C.train(docs, labels)
    out = C.score(docs, trees)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 801
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) and 0 <= r.score <= 1 for r in out.where("doc_id IS NOT NULL").collect())
    again = C.train(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(trees.value, again.value)
    assert len(C.train(docs, labels, sample=5).feature) in (0, C.ROUNDS)  # so few that nothing splits, or one kind only
    alone = C.train(docs, labels.limit(0))
    assert C.score(docs, alone).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    assert C.score(docs.limit(0), trees).count() == 0


def test_held_out_rows_do_not_teach(spark):
    docs = spark.createDataFrame([(i, "same text of all") for i in range(200)], "doc_id long, text string")
    out = {r.doc_id: r[1] for r in docs.select("doc_id", C.held_out(F.col("doc_id"))).collect()}
    assert out == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    labels = spark.createDataFrame([(i, int(out[i])) for i in range(200)], "doc_id long, quality int")
    assert C.score(docs, C.train(docs, labels)).agg(F.max("score")).first()[0] < 0.01


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op13_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 60 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
