import random
import re
from collections import Counter

from regmill.llm import quality, queries


def plain(text, min_words=50):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        counts, mark = Counter(grams), [0] * len(w)
        for i, g in enumerate(grams):
            if counts[g] > 1:
                mark[i : i + n] = [1] * n
        return sum(mark)

    repeats = lambda n: n == 0 or (n <= len(w) and max(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values(), default=0) > 1)
    longest, over = 0, len(w) + 1
    while over - longest > 1:
        middle = (longest + over) // 2
        longest, over = (middle, over) if repeats(middle) else (longest, middle)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered(3))
    failed = len(w) < min_words or 100 * base[4] > 50 * len(w)
    long = longest if longest >= quality.MIN_REPEAT else 0
    kept = not failed and 100 * covered(10) <= quality.MAX_COVERED_PERCENT * len(w) and long <= quality.MAX_REPEAT
    return (*base, failed, kept, covered(10), long)


def test_query(spark, sf):
    """Every text, the longest too."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_quality(spark, sf).collect()}
    assert got.keys() == docs.keys() and max(map(len, docs.values())) > 8000
    assert all(got[k] == plain(v) for k, v in docs.items())


def test_long_texts_with_long_repeats():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(800)}"
    passage = [word() for _ in range(260)]
    texts = [" ".join([word() for _ in range(9000)]), " ".join([word() for _ in range(3000)] + passage + [word() for _ in range(3000)] + passage), " ".join(passage[:150] * 40)]
    found = quality.measure(texts)
    for i, t in enumerate(texts):
        p = plain(t)
        assert tuple(int(x[i]) for x in found.values()) == (*p[:5], *p[7:])
    assert found["longest_repeat"][1] >= 260


def test_random_texts_and_batches(monkeypatch):
    monkeypatch.setattr(quality, "BATCH_WORDS", 300)
    rng = random.Random(2)
    texts = [None, "", " \n\n", "x", "a " * 500, "a b c\n" * 60, "\u3000\x1c\xa0 é"]
    texts += [" ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randrange(120))) + "\n" * (i % 3) for i in range(40)]
    found = quality.measure(texts)
    for i, t in enumerate(texts):
        p = plain(t)
        assert tuple(int(x[i]) for x in found.values()) == (*p[:5], *p[7:])


def test_edges(spark):
    good = " ".join(f"w{i}" for i in range(60))
    passage = " ".join(f"p{i}" for i in range(210))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good + " " + good), (5, " ".join(f"u{i}" for i in range(1000)) + " " + passage + " z " + passage)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality.judge(df).collect())
    assert got == [(1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, True, False), (5, False, False)]
    assert sorted(r.doc_id for r in quality.keep(df).collect()) == [3, 3]
    assert quality.judge(df.limit(0)).count() == 0
