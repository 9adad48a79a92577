"""Every operator and pipeline stage on a table that holds the operators' own column names, and on odd rows."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import public_tokenizers
from regmill.llm import alignment, bpe, classifier, collocation, fingerprint, license, linededup, mixing, neardup, quality, queries, sharding, urlfilter, warc
from regmill.llm.common import fresh, keyed

#: Names that some operator gives a column on its way.
TAKEN = (
    "_file _row _FILE __file _runs _both _measures _m _rid _part _edges _place _block _start _step _copies _copy copies copy first ids decoded shard slot nid label key block at h w again carried "
    "pairs one keys hits count r seq no s m ra rb p v c n sig sketch size taken target source_size hub tie none id _words _content quality score _own _id _label _x _text kind plane a b bits groups n_a n_best base_failed kept n_words licenses _metadata"
).split()
TEXTS = ["a line of words that stands in several documents, long enough to count\nown words here", None, "", " \n\t", "short", "x " * 3000, "é 𝒳 \x00 odd", "line\n" * 400]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(None if i % 5 == 0 else i % 7, TEXTS[i % len(TEXTS)], None if i % 3 == 0 else f"s{i % 2}", None if i % 4 else "en", len(TEXTS[i % len(TEXTS)] or "")) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    names = list(dict.fromkeys(n for n in TAKEN if n.lower() not in {x.lower() for x in TAKEN[: TAKEN.index(n)]}))
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(n) for n in names]).write.parquet(path)
    return spark.read.parquet(path)


def _mixed(df):
    return mixing.mix(df, "doc_id", F.col("n_chars"), F.col("source"), F.lit(1.0), content=F.xxhash64("text"))


def _merged(df):
    named = df.withColumnRenamed("doc_id", "page_id").withColumn("url", F.col("source")).withColumn("html", F.col("text"))
    return warc.archive_and_index(named)


def _filtered(df):
    listed = df.sparkSession.createDataFrame(queries.RULES, "host string, path string, verdict string")
    return urlfilter.match(df.withColumn("url", F.lit("http://a.com/en/1")), listed, ["doc_id", "keys", "at", "pairs"])


RANKS = public_tokenizers.path(queries.RANKS)
OPERATORS = {
    "bpe": (lambda df: bpe.round_trip(df, RANKS, public_tokenizers.PATTERN), {"ids", "decoded"}),
    "warc": (_merged, None),
    "sharding": (lambda df: sharding.shard(df, 5), {"shard", "slot"}),
    "mixing": (_mixed, None),
    "urlfilter": (_filtered, None),
    "license": (license.scan, {"licenses"}),
    "linededup": (linededup.dedup, {"_runs", "text"}),
    "fingerprint": (fingerprint.fingerprints, None),
    "quality": (quality.judge, {"n_words", "base_failed", "kept", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"}),
    "neardup": (neardup.near_duplicates, None),
    "alignment": (lambda df: alignment.align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents, {*alignment.RESULT}),
    "classifier": (lambda df: classifier.score(df, classifier.train(df, df.selectExpr("doc_id", "doc_id % 2 AS quality"))), {"score"}),
}


DROPPED = {"alignment": ("text",)}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_with_the_operators_own_names(spark, docs, name):
    operator, made = OPERATORS[name]
    out = operator(docs)
    assert out.count() == docs.count()
    if made is not None:
        kept = [c for c in docs.columns if c not in made and c not in DROPPED.get(name, ())]
        assert set(kept) | made == set(out.columns)
        of = lambda df: sorted(str(r) for r in df.select(*[f"`{c}`" for c in kept]).collect())
        assert of(out) == of(docs)
    assert operator(docs.limit(0)).count() == 0


def test_results_do_not_depend_on_other_columns(spark, docs):
    plain = docs.select("doc_id", "text")
    of = lambda df: sorted(str(tuple(r)) for r in df.collect())
    wide, narrow = neardup.near_duplicates(docs), neardup.near_duplicates(plain)
    columns = ["doc_id", "n_shingles", "component_id"]
    assert of(wide.select(*columns)) == of(narrow.select(*columns))
    assert wide.where("first").count() == narrow.where("first").count()
    assert sorted(map(tuple, collocation.mine(docs, least=3).collect())) == sorted(map(tuple, collocation.mine(docs.select("text", "lang"), least=3).collect()))
    assert collocation.mine(docs.limit(0)).count() == 0
    assert of(fingerprint.fingerprints(docs).select("doc_id", "sketch")) == of(fingerprint.fingerprints(plain).select("doc_id", "sketch"))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf, docs, name):
    """Stages keep the columns and their values; those that drop rows keep whole ones."""
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    if name == "bpe":
        rows = out.collect()
        assert len(rows) == docs.count() and all(r.round_trip for r in rows)
        return
    assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
    same = [c for c in docs.columns if c not in ("text", "n_chars")] if name == "line dedup" else docs.columns
    of = lambda df: {hashlib.sha256(str(r).encode()).hexdigest() for r in df.select(*[f"`{c}`" for c in same]).collect()}
    assert of(out) <= of(docs)
    if name == "near dedup":
        assert out.where("text IS NULL OR trim(text) = ''").count() == docs.where("text IS NULL OR trim(text) = ''").count()


def test_fresh_names_and_keys(spark, docs):
    assert fresh(["_A", "__a", "b"], "a", "b") == ["___a", "___b"]
    rows, keys = keyed(docs)
    assert len(rows.columns) == len(docs.columns) + 2 and rows.select(*keys).distinct().count() == docs.count()
    assert not {k.lower() for k in keys} & {c.lower() for c in docs.columns}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from regmill.sources import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    assert os.path.exists(storage.shared_dir(spark))
