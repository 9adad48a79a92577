import zlib
from collections import Counter

import numpy as np

from regmill.llm import queries, sharding


def test_matrix_has_both_margins():
    matrix, sizes = sharding.communication_matrix([5, 0, 17, 8], 4, seed=1)
    assert [sum(r) for r in matrix] == [5, 0, 17, 8]
    assert [sum(c) for c in zip(*matrix, strict=True)] == sizes == [8, 8, 7, 7]


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10_000) for _ in range(300)]
    assert abs(np.mean(draws) - 3000) < 15 and 35 < np.std(draws) < 57


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len(v) + 16, zlib.crc32(v)) for k, v in docs.items()}
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(docs) and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shuffle_is_even(spark):
    """Where a row ends does not depend on where it began."""
    rows = sharding.shard(spark.range(0, 8000, 1, 5), 4, seed=3).collect()
    early = Counter(r.shard for r in rows if r.id < 2000)
    assert all(abs(n - 500) < 90 for n in early.values())
    slots = np.array([(r.id, r.slot) for r in rows if r.shard == 0])
    assert abs(np.corrcoef(slots.T)[0, 1]) < 0.08


def test_edges(spark):
    same = spark.createDataFrame([(None, "x")] * 7 + [(1, "x")] * 5, "doc_id long, slot string")
    got = sharding.shard(same, 5).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [2, 2, 2, 3, 3]
    assert sharding.shard(spark.createDataFrame([], "doc_id long"), 5).count() == 0
    assert sharding.shard(spark.range(3), 5).count() == 3
