import re
from collections import Counter

import corpus_pipeline as pipeline
from regmill.llm import mixing
from tests.llm.test_linededup import brute as line_brute
from tests.llm.test_mixing import shares
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_quality import plain


def test_stages_against_plain_python(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, lines, unlike, mixed, encoded = ([r.asDict() for r in f.collect()] for f in frames)
    assert all(f.columns == columns for f in frames[:-1])

    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in raw if plain(r["text"], pipeline.MIN_WORDS)[6]}

    short = [r for r in raw if 1 <= len((r["text"] or "").split()) < 20]
    assert short and sum(r["doc_id"] in {g["doc_id"] for g in good} for r in short) > 0.9 * len(short)

    want = {r["doc_id"]: t for r, t in zip(good, line_brute([(r["doc_id"], r["text"]) for r in good], 50), strict=True) if t == r["text"] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines if r["text"] != next(g["text"] for g in good if g["doc_id"] == r["doc_id"]))

    found = near_brute([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    assert {r["doc_id"] for r in unlike} == {r["doc_id"] for r, (n, c) in zip(lines, found, strict=True) if n == 0 or c == r["doc_id"]}

    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in unlike}
    sizes, taken = Counter(), Counter()
    for r in unlike:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in mixed:
        taken[r["source"]] += size[r["doc_id"]]
    aims = shares(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.CAP)
    assert all(abs(taken[s] - aims[s]) <= max(size.values()) / 2 + 1 for s in sizes)

    assert len(encoded) == len(mixed) and all(r["round_trip"] for r in encoded)
    again = pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in again.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in encoded)
