import random
import re

import pytest

from regmill.llm import linededup, queries


def brute(docs, least):
    """Every pair of places is compared; a place's longest earlier copy is deleted if it is long enough."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    places = []
    for i in order:
        lines = (docs[i][1] or "").split("\n")
        worded = [n for n, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        places += [(i, s, worded, lines) for s in range(len(worded))]
    gone = {i: set() for i in order}
    for b, (i, s, w, ls) in enumerate(places):
        best = 0
        for j, t, v, ms in places[:b]:
            n = 0
            while s + n < len(w) and t + n < len(v) and ls[w[s + n]] == ms[v[t + n]]:
                n += 1
            # a copy in the same text ends before the later one begins
            best = max(best, min(n, s - t) if i == j else n)
        if sum(len(ls[w[s + k]]) for k in range(best)) >= least:
            gone[i] |= {s + k for k in range(best)}
    out = []
    for i, (_, text) in enumerate(docs):
        if not gone[i]:
            out.append(text)
            continue
        lines = text.split("\n")
        worded = [n for n, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        drop = set()
        for s in gone[i]:
            drop.add(worded[s])
            if s + 1 in gone[i]:
                drop |= set(range(worded[s], worded[s + 1]))
        out.append("\n".join(x for n, x in enumerate(lines) if n not in drop))
    return out


def check(spark, docs, least):
    df = spark.createDataFrame([(*d, n) for n, d in enumerate(docs)], "doc_id long, text string, h1 int").coalesce(1)
    got = {r.h1: r.text for r in linededup.dedup(df, least=least).collect()}
    want = brute(docs, least)
    assert len(got) == len(docs)
    assert [got[n] for n in range(len(docs))] == want


@pytest.mark.parametrize("seed", range(3))
def test_random_runs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "bb " * 3, "c" * 9, "long line " * 3, "x", "", " "]
    docs = [(rng.choice([n, n, n // 2]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for n in range(12)]
    check(spark, docs, rng.choice([5, 12, 30]))


def test_edges(spark):
    passage = "one line of a passage that repeats\nand the next one of it, also repeated"
    docs = [
        (1, None), (2, ""), (3, "\n \n"), (5, passage), (4, "own words\n" + passage + "\nmore own words"), (None, passage), (6, passage + "\n\n" + passage),
        (6, "short"), (7, "short"),
    ]
    check(spark, docs, linededup.MIN_CHARS)


def test_runs_longer_than_any_window_and_runs_that_overlap_themselves(spark):
    many = "\n".join(f"line {i} of a long run" for i in range(130))
    ones = "\n".join("abcdefghij"[i % 10] for i in range(120))
    three = "\n".join(["a line of twenty-five char"] * 3)
    docs = [(1, many), (2, "own\n" + many + "\nmore"), (3, many[200:]), (4, ones), (5, ones[:-1] + "end"), (6, three), (7, "\n".join(["x" * 30, "y" * 30] * 5)), (8, "x" * 60 + "\n" + "x" * 60)]
    check(spark, docs, 50)
    kept = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame([(1, three)], "doc_id long, text string")).collect()}
    assert kept == {1: three}


def test_query(spark, sf):
    """The whole table; line numbers of the deleted runs agree with the text that is left."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, brute(list(docs.items()), linededup.MIN_CHARS), strict=True))
    got = {r.doc_id: r for r in queries.op7_lines(spark, sf).collect()}
    assert {k: r.text for k, r in got.items()} == want
    for k, r in got.items():
        lines = (docs[k] or "").split("\n")
        gone = {i for x in r.deleted_runs or [] for i in range(x["first"], x["last"] + 1)}
        assert r.deleted_runs is None or "\n".join(x for i, x in enumerate(lines) if i not in gone) == r.text
        assert r.n_deleted_lines == sum(bool(re.search(r"[^\x20\x09-\x0D]", lines[i])) for i in gone)


def test_very_long_text(spark):
    long = "\n".join(f"{i % 700} a line of a very long text" for i in range(6000))
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame([(1, long), (0, "x")], "doc_id long, text string")).collect()}
    assert got[1] == "\n".join(long.split("\n")[:700])


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_line_keeps_its_first_copy(spark):
    line = "a very common line of boilerplate text that many documents share"
    docs = [(n, f"{line}\nown text {n}") for n in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert got == {n: t if n == 0 else f"own text {n}" for n, t in docs}
