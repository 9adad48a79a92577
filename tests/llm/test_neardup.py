import random
import re

import numpy as np
import pytest

from regmill.llm import neardup, queries


def shingles(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs, n, percent):
    """doc index -> smallest id in its component, by comparing all pairs of different sets."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_set = {}
    for i, s in enumerate(sets):
        if s:
            parent[find(i)] = find(by_set.setdefault(s, i))
    distinct = sorted(by_set.items(), key=lambda x: len(x[0]))
    for i, (s, a) in enumerate(distinct):
        for t, b in distinct[i + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(len(sets[i]), least.get(find(i), None) if sets[i] else docs[i][0]) for i in range(len(docs))]


def check(spark, docs, n=3, percent=85):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, n, percent).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        (d is None, d or 0, k, -1 if c is None else c or -1) for (d, _), (k, c) in zip(docs, brute(docs, n, percent), strict=True)
    )
    if len({d for d, _ in docs}) < len(docs):
        return  # components of different texts may have the same smallest id
    groups = {}
    for r in got:
        if r.n_shingles:
            groups.setdefault(r.component_id, []).append(r.first)
    assert all(sum(x) == 1 for g, x in groups.items() if g is not None)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, c, d == c) for (d, _), (n, c) in zip(docs, brute(docs, 3, 85), strict=True)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_neardup(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed,short", [(0, 16), (1, 2)])
def test_large_groups_that_share_a_passage(spark, monkeypatch, seed, short):
    """Variants of one text that hang together through the original only, and unlike texts with one long passage in common."""
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 8 * neardup.LEAST_BYTES)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base, docs = [word() for _ in range(120)], []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            text[rng.randrange(120)] = word()
        docs.append((1000 - i, " ".join(text)))
    passage = [word() for _ in range(60)]
    for i in range(40):
        docs.append((i, " ".join(passage + [word() for _ in range(rng.choice([4, 10, 30]))])))
    check(spark, docs)


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(50))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, long), (7, long.upper()), (7, long), (7, "other words here now"), (8, long + " end"), (0, "x")]
    check(spark, docs)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_short_text_and_the_same_with_one_word_more(spark, n, percent):
    docs = []
    for i in range(30):
        text = [f"d{i}w{j}" for j in range(8)]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, "more"]))]
    assert [c for _, c in brute(docs, n, percent)] == [2 * (i // 2) for i in range(60)]
    check(spark, docs, n, percent)


def test_four_of_five_values_without_a_common_run(spark):
    """The extra value lies between two and two of the shared ones, so that no run of three is shared."""
    docs, i = [], 0
    while len(docs) < 12:
        text = [f"s{i}w{j}" for j in range(9)]
        small, large = (set(neardup.shingle_set(" ".join(x), 5, {}).tolist()) for x in (text[:8], text))
        if sorted(large).index((large - small).pop()) == 2:
            docs += [(2 * i, " ".join(text[:8])), (2 * i + 1, " ".join(text))]
        i += 1
    # many texts with the same four shingles and another fifth one are linked by the text that has the four only
    docs += [(5000 + j, f"you must log in to view this page {j}") for j in range(40)] + [(4000, "you must log in to view this page")]
    docs += [(7000 + j, f"texts that lack the one with four shingles {j}") for j in range(40)]
    check(spark, docs, 5, 80)


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_short_texts_in_long_lists(spark, n, percent):
    """Chains of truncated texts, whose links share no run of six values, in lists longer than SHORT_LIST."""
    rng = random.Random(percent)
    docs = []
    for i in range(40):
        common = [f"c{i}w{j}" for j in range(25)]
        # chains by cuts at the end, from texts of 8 to 25 words, and texts that share a part only
        for j in range(8, 26):
            docs.append((len(docs), " ".join(common[:j])))
        for j in range(20):
            cut = rng.randrange(8, 20)
            docs.append((len(docs), " ".join([*common[cut - 8 : cut], *(f"o{i}x{j}y{m}" for m in range(rng.choice([1, 2, 6])))])))
    rng.shuffle(docs)
    check(spark, docs, n, percent)


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_short_texts_that_share_a_passage(spark, n, percent):
    """Passages of 14 words in 17 to 200 documents of 8 to 60 shingles, whose own words stand before, behind and between."""
    rng = random.Random(n)
    docs = []
    for g, members in enumerate((17, 33, 70, 200)):
        passage = [f"p{g}w{i}" for i in range(14)]
        for i in range(members):
            own = [f"g{g}d{i}x{j}" for j in range(rng.choice([0, 1, 1, 2, 2, 3, 8, 46]))]
            before = rng.randrange(len(own) + 1)
            text = own[:before] + passage + own[before:]
            if rng.random() < 0.2:
                text = text[:7] + [f"mid{i}"] + text[7:]
            docs.append((len(docs), " ".join(text)))
    rng.shuffle(docs)
    check(spark, docs, n, percent)


def test_planted_pairs_inside_long_lists(spark):
    """Pairs at the threshold among texts that share half their words: none of them is lost."""
    rng = random.Random(5)
    passage, docs = [f"p{i}" for i in range(300)], []
    for i in range(120):
        own = [f"d{i}w{j}" for j in range(300)]
        near = list(own)
        for at in rng.sample(range(300), 11):
            near[at] = f"e{i}w{at}"
        docs += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + near))]
    want = brute(docs, 3, 85)
    assert sum(c == d for (d, _), (_, c) in zip(docs, want, strict=True)) < 240
    check(spark, docs)


def _family(members):
    passage = [f"p{i}" for i in range(60)]
    return [(i, " ".join([*passage, *(f"d{i}w{j}" for j in range(14))])) for i in range(members)]


def test_texts_that_share_a_passage_and_are_not_linked_make_no_lists(spark):
    """72 shingles, 58 of them common: the rarest values of the whole sets, as many as decide, are each text's own."""
    docs = spark.createDataFrame(_family(400), "doc_id long, text string").repartition(3)
    rows, keys = neardup.keyed(docs)
    job = neardup._Job(rows.select("doc_id", "text", *[neardup.F.col(k).alias(own) for k, own in zip(keys, neardup.KEY, strict=True)]), 3, 85)
    assert job.nodes.count() == 400 and job.lists().count() == 0
    check(spark, _family(60))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_pairs_at_the_threshold_of_every_size(spark, n, percent):
    """Two sets of as many values in common as the threshold asks for, or one fewer, around the size of a sketch, with a passage that all hold."""
    rng, docs, passage = random.Random(n), [], [f"p{i}" for i in range(20)]
    for size in range(30, 150, 2):
        own = [f"s{size}w{i}" for i in range(size)]
        for extra in (-1, 0):
            # words behind add as many values to the larger set
            whole = len(passage) + size - n + 1
            more = max(0, 100 * whole // percent - whole + extra + 1)
            text = passage + [f"{w}e{extra}" for w in own]
            docs += [(len(docs), " ".join(text)), (len(docs) + 1, " ".join([*text, *(f"m{size}e{extra}x{j}" for j in range(more))]))]
    want = brute(docs, n, percent)
    assert 0 < sum(c != d for (d, _), (_, c) in zip(docs, want, strict=True)) < len(docs) // 2
    rng.shuffle(docs)
    check(spark, docs, n, percent)


def test_counts_of_common_values():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(15)]
    both = neardup.common_counts(sets[:6], sets[6:])
    assert both.tolist() == [[len(np.intersect1d(a, b)) for b in sets[6:]] for a in sets[:6]]
    assert neardup.fewest(64, 85) == 39 and neardup.fewest(10, 100) == 10


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 9000}x{i % 7}" for i in range(40_000))
    check(spark, [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "x" * 300_000), (5, "x" * 300_000)])
