import base64
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from regmill.llm import fingerprint, queries


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(after))


def bottom(text, k=fingerprint.K):
    """The plain bottom-k sketch: chained hashes of the hashes of each shingle's words, as signed numbers."""
    found = set()
    for shingle in shingles(text):
        h = 42
        for w in shingle:
            h = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), h)
        found.add(h - 2**64 if h >= 2**63 else h)
    return sorted(found)[:k]


def near(a, b, k=fingerprint.K):
    """Resemblance of two sketches."""
    union = sorted(set(a) | set(b))
    union = union if len(a) < k and len(b) < k else union[:k]
    return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0


def test_query_equals_brute_force(spark, sf, monkeypatch):
    """Sketches are those of a plain bottom-k, likenesses follow from them, and lie within four deviations of the true ones."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_BLOCK", 17)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    order, errors = sorted(docs, reverse=True), []
    for (doc_id, n, sha, edited, following), (_, text), (_, after) in zip(expected(docs), order, order[1:] + order[:1], strict=True):
        r, m = got[doc_id], len(text) // 3
        mine, its = bottom(text), bottom(text[: len(text) - m] + after[:m])
        packed = lambda sketch: base64.b64encode(b"".join(h.to_bytes(8, "big", signed=True) for h in sketch)).decode()
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.fingerprint.replace("\r\n", ""), r.edited_fingerprint.replace("\r\n", "")) == (packed(mine), packed(its))
        assert r.near_edited == near(mine, its) and r.near_next == near(mine, bottom(after))
        errors += [abs(r.near_edited - edited), abs(r.near_next - following)]
    assert max(errors) < 0.18 and sum(errors) / len(errors) < 0.05
    by_text = {}
    for doc_id, text in docs:
        by_text.setdefault(text, set()).add(got[doc_id].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_a_third_of_the_ids_alike_or_null(spark, monkeypatch):
    """Rows that share an id are cut into blocks like others; each is edited by exactly one row, and edits one."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_BLOCK", 8)
    rows = [(None, f"none {i} " * 5) for i in range(60)] + [(7, f"same {i} " * 5) for i in range(60)] + [(i, f"own {i} " * 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed, place = fingerprint.keyed(docs)
    assert len(fingerprint._bounds(keyed, place)) == 23
    got = [r.edited_sha256 for r in fingerprint.fingerprints(docs).collect()]
    tails = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest(): (t, u) for _, t in rows for _, u in rows}
    pairs = [tails[x] for x in got]
    assert sorted(t for t, _ in pairs) == sorted(t for _, t in rows)
    ids = {t: d for d, t in rows}
    steps = [(ids[t], ids[u]) for t, u in pairs]
    assert sum(a is None and b is not None for a, b in steps) == sum(a is not None and b is None for a, b in steps) == 1
    assert all(b in (a, a - 1) or b is None for a, b in steps if a is not None)


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    r = spark.createDataFrame([(1, text), (0, "short")], "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprint.fingerprints(r).collect()}
    assert got[1].sketch == bottom(text) and got[1].next_sketch == bottom("short") and got[0].next_sketch == bottom(text)


def test_edges(spark):
    rows = [(3, "a b"), (2, None), (2, ""), (None, "one two three four five six"), (9, "ünï 𝒳 " * 4), (1, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _block int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprint.fingerprints(df).collect())
    assert got == sorted((d is None, d or 0, n, sha) for d, n, sha, _, _ in expected([(d, t or "") for d, t in rows]))
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1500, 4500))
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    sa, sb = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    r = row.select(
        fingerprint.resemblance(sa, sb).alias("j"), fingerprint.containment(sa, sb).alias("c"), fingerprint.distinct_count(sa).alias("n"),
        (fingerprint.resemblance(fingerprint.merged(sa, sb), fingerprint.sketch(F.col("c")))).alias("m"),
    ).first()
    assert abs(r.j - 1 / 3) < 0.13 and abs(r.c - 0.5) < 0.2 and abs(r.n - 2996) < 900 and r.m > 0.95
