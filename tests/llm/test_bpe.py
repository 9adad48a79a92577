import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from regmill.llm import bpe, queries

RANKS, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def enc():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


TEXTS = ["", "a", "don't stop  \n\n now 123abc", "<|endoftext|>", "ünï 漢字 𝒳\u2003x\x85\x1c ", " \n" * 50 + "x", "it's " * 400 + "\t\n end", "x" * 3000, "!?" * 900, "a\n\nb \n c's'll 'S"]


TEXTS += ["漢字かな、カナ。한국어，" * 60 + "'s ok！", "é\u0301 ñ! \n?漢 字。' d\u2003\x1c \x1d\n", "١٢٣ ٤٥ \n٦。"]


def test_long_texts_of_any_script_are_cut(enc):
    """No text needs ASCII letters for its cuts."""
    for text in ("漢字が続く文、" * 30_000, "Ünïçödé — \n" * 30_000, "??? !!!\n" * 40_000):
        parts = list(bpe.safe_parts(text))
        assert max(len(p) for p, _ in parts) < bpe.WINDOW + 20 and "".join(p for p, _ in parts) == text
        assert np.frombuffer(bpe.encode_text(enc, text), "<u4").tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("window", [1, 7, 64, 10**6])
def test_parts_give_the_ids_of_the_whole(enc, window):
    for text in TEXTS:
        ids = [i for part, _ in bpe.safe_parts(text, window) for i in enc.encode_ordinary(part)]
        assert ids == enc.encode_ordinary(text)
        assert bpe.decode_ids(enc, bpe.encode_text(enc, text)) == text.encode()


def test_long_runs_of_blanks(enc, monkeypatch):
    for text in [" " * 50_000, "a" + " " * 50_000 + "b c", "a\n" * 3 + "\n" * 30_000 + "b", " " * 25_000 + "\u3000" * 25_000 + " x"]:
        assert np.frombuffer(bpe.encode_text(enc, text), "<u4").tolist() == enc.encode_ordinary(text)
    huge = "a" + " " * 1_500_000 + "b"
    assert bpe.decode_ids(enc, bpe.encode_text(enc, huge)) == huge.encode()


def test_query(spark, sf, enc):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edges(spark, enc):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0)], "doc_id long, text string, decoded int")
    rows = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).withColumn("plain", bpe.unpacked(F.col("ids"))).collect()
    assert sorted((r.doc_id, r.plain, bytes(r.decoded)) for r in rows) == [(1, [], b""), (2, [], b"")] + [(3, enc.encode_ordinary("hello world"), b"hello world")] * 2
    part_of_a_letter = spark.createDataFrame([(bytearray(np.array([enc.encode_ordinary("漢")[0]], "<u4").tobytes()),)], "ids binary")
    assert "漢".encode().startswith(bytes(bpe.decode(part_of_a_letter, RANKS, PATTERN).first().decoded))
    assert bpe.encode(spark.createDataFrame([], "text string"), RANKS, PATTERN).count() == 0
