import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from regmill.llm import license, queries

FILLER = "the quick brown fox jumps over a lazy dog and with it the license of a version under that "


KNOWN = tuple(license.templates().items())


def names(text):
    return [x["license"] for x in license.find(text, KNOWN)]


def test_each_template_is_found_in_other_text():
    for name, text in KNOWN:
        assert names(FILLER * 3 + text + " " + FILLER * 2) == [name]


def test_licenses_that_share_most_of_their_words_are_told_apart():
    two, three = (dict(KNOWN)[f"BSD-{n}-Clause"] for n in (2, 3))
    assert names(two) == ["BSD-2-Clause"] and names(three) == ["BSD-3-Clause"]
    assert names(two + FILLER + three) == ["BSD-2-Clause", "BSD-3-Clause"]


def test_changed_and_repeated_texts():
    text = dict(KNOWN)["MIT"].replace("free of charge", "gratis").upper()
    found = license.find(FILLER + text + "\n" + FILLER + text, KNOWN)
    assert [x["license"] for x in found] == ["MIT", "MIT"] and all(0.8 <= x["coverage"] < 1 for x in found)
    assert found[0]["start"] == len(FILLER) and found[0]["end"] < found[1]["start"]


def test_notices_of_five_words_without_one():
    for name in ("MIT (notice)", "CC-BY-NC-4.0 (notice)"):
        words = dict(KNOWN)[name].split()
        for gone in words:
            text = FILLER + " ".join("Distributed" if w == gone else w for w in words)
            assert len(words) == 5 and name in names(text), gone


def test_scattered_words_are_no_license():
    assert names("released " + "x " * 30 + "under " + "y " * 30 + "the MIT " + "z " * 30 + "license") == []


def most(a, b):
    """Words in the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0 (file notice)", "GPL-3.0-or-later (notice)"])
def test_coverage_of_edited_texts_against_the_longest_common_subsequence(name):
    """Words are lost, changed and put in at growing rates; coverage is close to the best there is, and never above it."""
    rng, template = random.Random(name), license.tokens(dict(KNOWN)[name])
    only = ((name, dict(KNOWN)[name]),)
    for rate in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5):
        for _ in range(6):
            words = []
            for w in template:
                dice = rng.random() / rate
                words += [] if dice < 0.4 else ["other"] if dice < 0.8 else [w, "more"] if dice < 1 else [w]
            found = license.find("zz " * 50 + " ".join(words) + " zz" * 50, only)
            best = most(words, template) / len(template)
            assert len(found) <= 1
            if found:
                assert license.COVERAGE <= found[0]["coverage"] <= best + 1e-9
            else:
                assert best < license.COVERAGE + 0.05, (rate, best)


def test_very_long_text():
    body = dict(KNOWN)["GPL-3.0"]
    text = FILLER * 500 + body + FILLER * 500 + dict(KNOWN)["MPL-2.0"]
    assert names(text) == ["GPL-3.0", "MPL-2.0"]
    assert names("license " * 50_000) == []


@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdef"), max_size=14))
def test_alignment_is_increasing_and_equal(a, b):
    pairs = license.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    lines = {v: k for k, v in license.NOTICES.items()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: [x["license"] for x in r.licenses] for r in queries.op6_licenses(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        assert sorted(got[doc_id]) == sorted(n for line, n in lines.items() for _ in range(text.count(line)))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "no notice here"), (4, "Released under the MIT License."), (4, "Released under the MIT License.")]
    got = license.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")).collect()
    assert sorted((r.doc_id, len(r.licenses)) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
