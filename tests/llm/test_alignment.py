"""Cross-tokenizer alignment against both libraries on whole texts, and counts against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from regmill.llm import alignment as A
from regmill.llm import queries

LONG = ["word " * 60_000 + "end", "語" * 50_000]
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "\n", "  x", "x  ", "x \n", "a\tb \t c", "a  b", "▁", "a ▁ b", "漢字かな 交じり\n文 ", "\x00 a\x00b", "é 𝒳 <s> <|endoftext|> </s>", "\r\n a\r\n\r\nb", "x" * 5000 + " y",
    " " * 300 + "z" + "\n" * 70, "don't  can't 'S 's", "a b　c ​d", "é ﻿", "😀😀 👩‍👩‍👧", "word " * 2000, "語" * 1500, "a b a b a b",
]


@pytest.fixture(scope="module")
def aligner():
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        return A.Aligner(f.read(), g.read())


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def plain(aligner, text):
    """Groups of a whole text: lists of A ids and of B ids."""
    whole = " " + (text or "")
    ids = aligner.a.model.encode(whole, add_special_tokens=False).ids, aligner.b.model.encode(text or "")
    if not text or any(b"".join(t.of[i] for i in x) != whole.encode() for t, x in zip((aligner.a, aligner.b), ids, strict=True)):
        return []
    ends = [np.cumsum([len(t.of[i]) for i in x]).tolist() for t, x in zip((aligner.a, aligner.b), ids, strict=True)]
    groups, at = [], [0, 0]
    for e in sorted(set(ends[0]) & set(ends[1])):
        upto = [x.index(e) + 1 for x in ends]
        groups.append([x[i:j] for x, i, j in zip(ids, at, upto, strict=True)])
        at = upto
    return groups


def written(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def links(groups):
    return [(a, b) for x, y in groups for a in x for b in y]


def test_texts_from_segments_equal_whole_texts(aligner, texts):
    for batch in (ODD, texts, ODD + texts):
        numbers, groups, places, pairs = aligner.align(batch)
        for i, text in enumerate(batch):
            want = plain(aligner, text)
            assert groups[i] == written(want), text
            found = links(want)
            assert numbers[i].tolist() == [sum(len(g[0]) for g in want), sum(len(g[1]) for g in want), len(want), len(found)]
            assert Counter(pairs[places == i].tolist()) == Counter(a * aligner.width + b for a, b in found)


def test_very_long_texts(aligner):
    numbers, groups, _, _ = aligner.align(LONG)
    for i, text in enumerate(LONG):
        ids = aligner.a.model.encode(" " + text, add_special_tokens=False).ids, aligner.b.model.encode(text)
        assert numbers[i, :2].tolist() == list(map(len, ids))
        parts = [g.split("|") for g in groups[i].split(";")]
        assert len(parts) == numbers[i, 2] and all([int(x) for p in parts for x in p[side].split(",")] == ids[side] for side in (0, 1))


def test_forgetting_changes_nothing(aligner, texts, monkeypatch):
    want = aligner.align(texts)
    monkeypatch.setattr(A, "KNOWN_SEGMENTS", 300)
    for _ in range(3):
        for i in range(0, len(texts), 20):
            got = aligner.align(texts[i : i + 20])
            assert np.array_equal(got[0], want[0][i : i + 20]) and got[1] == want[1][i : i + 20]
    assert len(aligner.index) < 20_000


def test_bitmaps_round_trip():
    r = np.random.default_rng(1)
    sets = [np.sort(r.choice(A.PLACES, n, replace=False)) for n in (1, 2, 255, 256, 257, 4096, 0, 90)]
    sizes = np.array([len(s) for s in sets])
    bits = A.bitmaps(np.concatenate(sets).astype("<u2"), sizes)
    assert max(map(len, bits.to_pylist())) == A.BITMAP_BYTES
    for part in (bits, bits.slice(2, 4), pa.array(bits.to_pylist())):
        first = 2 if len(part) == 4 else 0
        owner, places = A.places_of(part)
        assert all(np.array_equal(np.sort(places[owner == i]), sets[first + i]) for i in range(len(part)))


def test_popcount(spark):
    sets = [list(range(0, 4000, 7)), [5], [1, 4095], list(range(300))]
    bits = A.bitmaps(np.concatenate(sets).astype("<u2"), np.array(list(map(len, sets))))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bits.to_pylist())], "i int, bits binary")
    assert [r[1] for r in df.select("i", A.popcount(F.col("bits"))).orderBy("i").collect()] == list(map(len, sets))


@pytest.mark.parametrize("partitions", [1, 5])
def test_counts_against_plain_python(spark, aligner, texts, partitions):
    batch = texts[:60] + texts[:20] + ODD
    docs = spark.createDataFrame([(i % 70, t, "x", i) for i, t in enumerate(batch)], "doc_id long, text string, block string, n_a long").repartition(partitions)
    every = [Counter(links(plain(aligner, t))) for t in batch]
    held, total = Counter(p for c in every for p in c), Counter()
    for c in every:
        total.update(c)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    found = A.align(docs, *PATHS, keep_groups=True)
    assert {(r.a, r.b): (r.documents, r.links, r.best) for r in found.pairs.collect()} == {p: (n, total[p], n == most[p[0]]) for p, n in held.items()}
    assert found.documents.columns == ["doc_id", "block", *A.COUNTS, "n_best", "count_sum", "groups_sha256", "groups"]
    got = sorted(tuple(r) for r in found.documents.select("doc_id", "groups", "groups_sha256", "n_links", "n_best", "count_sum").collect())
    want = []
    for i, (t, c) in enumerate(zip(batch, every, strict=True)):
        g = written(plain(aligner, t))
        best = sum(n for p, n in c.items() if held[p] == most[p[0]])
        want.append((i % 70, g, hashlib.sha256(g.encode()).hexdigest() if g else "", sum(c.values()), best, sum(n * held[p] for p, n in c.items())))
    assert got == sorted(want)


def test_query_gives_every_document_a_row(spark, sf):
    rows = queries.op12_alignment(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.count_sum >= r.n_links >= r.n_best for r in rows)
