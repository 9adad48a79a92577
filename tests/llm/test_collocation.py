"""Phrase mining: chunks, counts and the query against plain Python and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from regmill.llm import collocation as M
from regmill.llm import queries


def _pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def _counts(rows):
    out = Counter()
    for lang, text in rows:
        for p in _pieces(text):
            out.update(("und" if lang is None else lang, k, " ".join(p[i : i + k])) for k in range(1, 5) for i in range(len(p) - k + 1))
    return out


def plain(rows, least, covered=80):
    f = {(g, p): n for (g, _, p), n in _counts(rows).items() if n >= least}
    total = Counter()
    for (g, k, _), n in _counts(rows).items():
        total[g] += n if k == 1 else 0
    found = {}
    for (g, p), a in f.items():
        w = p.split(" ")
        if len(w) > 1:
            cuts = [(2_000_000 * a // (f[g, " ".join(w[:c])] + f[g, " ".join(w[c:])]), c) for c in range(1, len(w))]
            score, c = min(cuts)
            found[g, p] = (c, a, f[g, " ".join(w[:c])], f[g, " ".join(w[c:])], total[g], score)
    inside = lambda p, q: len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q)))
    gone = {(g, p) for g, p in found for h, q in found if g == h and inside(p.split(" "), q.split(" ")) and 100 * f[h, q] >= covered * f[g, p]}
    return {k: v for k, v in found.items() if k not in gone}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["a", "bé", "Cc", "dd", "e-e", "f\x00", "漢", "g", "h"]
    texts = [r.choice(["", "\t", " "]).join(r.choice(words) + r.choice([" ", " ", " ", ", ", "\n", ". ", "  "]) for _ in range(r.randrange(120))) for _ in range(60)]
    texts += [texts[3]] * 40 + [None, "", " \t", "...", "the end " * 3000, "x y z w " * 50, "Ünder x\x1cy"]
    return [(r.choice(["en", "en", None, ""]), t) for t in texts]


def test_chunks_cover_each_phrase_once(rows):
    lengths = []
    for _, text in rows:
        counted = Counter()
        for c in M.chunks_of(text, {}):
            words = c.split(b" ")
            lengths.append(len(words))
            for k in range(1, M.LONGEST + 1):
                counted.update(tuple(words[i : i + k]) for i in range(len(words) - M.OVERLAP) if M.STOP not in words[i : i + k])
        want = Counter(tuple(w.encode() for w in p[i : i + k]) for p in _pieces(text) for k in range(1, 5) for i in range(len(p) - k + 1))
        assert counted == want
    assert len(lengths) > len(rows)


def test_no_chunk_is_the_beginning_of_another(rows):
    chunks = {tuple(c.split(b" ")) for _, t in rows for c in M.chunks_of(t, {})}
    for c in chunks:
        assert not any(c[:n] in chunks for n in range(1, len(c)))


@pytest.mark.parametrize("least", [30, 4])
def test_against_plain_python(spark, rows, least):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    found = M.mine(docs, least=least).collect()
    assert {(r.lang, r.phrase): (r.cut, r.a, r.l, r.r, r.n, r.score) for r in found} == plain(rows, least)
    assert len(found) == len({(r.lang, r.phrase) for r in found}) and len(found) > 5


def test_the_table_of_bits_loses_no_phrase(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    frequent = M.phrase_counts(docs, least=4)[0]
    table = M._table_of(frequent)
    assert 0 < np.bitwise_count(table).sum() <= frequent.count()
    chunks = [c for lang, t in rows if lang == "en" for c in M.chunks_of(t, {})]
    grams, full = M._Grams("en", chunks, np.ones(len(chunks), np.int64)), np.full(M.BITS // 64, (1 << 64) - 1, np.uint64)
    for k in (2, 3, 4):
        every = dict(zip(*grams.counted(k, full), strict=True))
        assert every == {p.encode(): c for (_, n, p), c in _counts([r for r in rows if r[0] == "en"]).items() if n == k}
        some = dict(zip(*grams.counted(k, table), strict=True))
        assert some.items() <= every.items() and {p for p, c in every.items() if c >= 4} <= some.keys()


def test_ranks_and_ties(spark):
    mined = spark.createDataFrame([("en", p, s, a) for p, s, a in [("b a", 5, 40), ("a é", 5, 40), ("a z", 5, 40), ("a", 9, 30), ("c", 5, 41)]], "lang string, phrase string, score long, a long")
    assert [r.phrase for r in M.best(mined, 4).orderBy("rank").collect()] == ["a", "c", "a z", "a é"]
    assert M.best(mined.limit(0)).count() == 0


def test_large_products_are_exact(spark):
    from pyspark.sql import functions as F

    big = 2**62 + 12345
    got = spark.createDataFrame([(big, big + 7, big + 9)], "a long, l long, r long").select(M._exact_score(*[F.col(c) for c in "alr"])).first()[0]
    assert got == 2_000_000 * big // (2 * big + 16)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP11_SQL)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in queries.op11_phrases(spark, sf).collect()) == sorted(want.fetchall())
