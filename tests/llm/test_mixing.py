import math
import re

from pyspark.sql import functions as F

from regmill.llm import mixing, queries


def shares(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by reshared excess, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, total = budget - sum(fixed.values()), sum(weight[s] for s in free)
        aims = {s: left * weight[s] / total for s in free}
        over = [s for s in free if aims[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | aims
        fixed |= {s: cap * sizes[s] for s in over}


def check(got, sources):
    sizes, taken = {}, {}
    for r in got:
        s = sources[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    aims = shares(sizes)
    for r in got:
        assert r.source_size == sizes[sources[r.doc_id]] and abs(r.target - aims[sources[r.doc_id]]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= max(r.size for r in got if sources[r.doc_id] == s) / 2 + 1e-6


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op4_mixing(spark, sf).collect()
    assert {r.doc_id: r.size for r in got} == {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    check(got, {d.doc_id: d.source for d in docs})
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op4_mixing(spark, sf).collect()))


def test_hot_and_odd_sources(spark):
    rows = [(i, "hot" if i % 3 else None, i % 11) for i in range(150)] + [(200, "é", 5), (201, "tiny", 1), (202, "", None), (203, "\U0001f600", 40), (204, "zero", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, "doc_id", F.col("size"), F.col("source"), F.lit(None).cast("double")).collect()
    assert len(got) == len(rows)
    check(got, {r[0]: r[1] for r in rows})


def test_weights_favour_good_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    got = mixing.mix(df, "doc_id", F.lit(10), F.col("source"), F.col("w"), weights=(1, 3), share=0.5).collect()
    a = [r for r in got if r.doc_id < 1500 and r.taken]
    assert abs(len(a) - 375) <= 1 and sum(r.doc_id % 2 == 0 for r in a) > 0.7 * len(a)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(df, "doc_id", F.col("size"), F.col("source"), F.lit(1.0)).count() == 0


def test_repeated_rows_and_null_ids_draw_one_by_one(spark):
    """A third of the rows alike: the mix takes some of them and leaves the others, as near to the target as it can."""
    rows = [(None, "a", "same text") for _ in range(300)] + [(7, "a", "same text")] * 50 + [(i, "a", f"t{i}") for i in range(1000, 1650)] + [(i, "b", "x") for i in range(5000, 6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, "doc_id", F.lit(10), F.col("source"), F.lit(1.0), weights=(1, 3), share=0.5, content=F.xxhash64("text")).collect()
    taken = [r for r in got if r.doc_id is None and r.taken]
    assert len(got) == len(rows) and 40 < len(taken) < 115
    assert abs(sum(r.taken for r in got if r.doc_id is None or r.doc_id < 5000) - 2500) <= 5


def test_the_keys_are_those_of_the_method(spark):
    """Which documents are taken: those with the smallest exponential keys, by the same draw in plain Python."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 17 + 1).alias("size"), F.when(F.col("id") % 5 == 0, 1e6).otherwise(1.0).alias("w"))
    keyed = df.withColumn("u", mixing.unit_interval(F.xxhash64(F.lit(0), F.col("doc_id"), F.col("size"), F.lit(0)))).collect()
    order = sorted(keyed, key=lambda r: -math.log(r.u) / r.w)
    want, before, rest = {}, 0, 0.5 * sum(r["size"] for r in keyed)
    for r in order:
        want[r.doc_id] = r["size"] if before + r["size"] / 2 <= rest else 0
        before += r["size"]
    got = mixing.mix(df, "doc_id", F.col("size"), F.lit("only"), F.col("w"), share=0.5).collect()
    assert {r.doc_id: r.taken for r in got} == want
