"""The queries of the corpus operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, classifier, collocation, fingerprint, license, linededup, mixing, neardup, quality, sharding, urlfilter, warc
from .common import WORD, ship

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shard(rows, 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_weight() -> Column:
    return F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)


def sized(text: str) -> list[Column]:
    """Words of a text, and a hash that tells texts apart."""
    return [F.regexp_count(text, F.lit(WORD)).alias("_words"), F.xxhash64(text).alias("_content")]


def with_quality(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs with the label `quality`, null where there is none; of several labels of an id the largest counts."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("quality"))
    return docs.drop("quality").join(labels, F.col("doc_id") == F.col("_labelled"), "left").drop("_labelled")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_quality(table(spark, sf_dir, "documents").select("doc_id", "source", *sized("text")), spark, sf_dir)
    return mixing.mix(docs, "doc_id", F.col("_words"), F.col("source"), quality_weight(), content=F.col("_content")).drop("copies")


#: Host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.match(table(spark, sf_dir, "pages"), listed, ["page_id"])


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(h, t, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), j AS (
  SELECT page_id, host, path,
    (SELECT h || t FROM r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, t) ORDER BY length(h || t) DESC LIMIT 1) AS rule
  FROM p
)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM r WHERE h || t = rule), 'allow') AS verdict FROM j
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "covered_words", "longest_repeat")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.coalesce(F.aggregate("_runs", F.lit(0), lambda n, r: n + r["lines"]), F.lit(0))
    return kept.select("doc_id", gone.cast("long").alias("n_deleted_lines"), F.col("_runs").alias("deleted_runs"), "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    print_, edited, following = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_string(print_).alias("fingerprint"), fingerprint.as_string(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(print_, edited).alias("near_edited"), fingerprint.resemblance(print_, following).alias("near_next"),
        fingerprint.distinct_count(print_).alias("n_shingles"),
    )


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_index(table(spark, sf_dir, "pages"))
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*first, "url_key", "captured_at", "archive", "offset", "length", "part", "place")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), "licenses")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocation.best(collocation.mine(table(spark, sf_dir, "documents").select("lang", "text")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), started AS (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, range(1, 5) t(k)
), f AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM started GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS c FROM cand
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, p.f AS l, q.f AS r, ((2000000::HUGEINT * a) // (p.f::HUGEINT + q.f))::BIGINT AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = array_to_string(ws[1 : c], ' ') AND p.k = c
    JOIN f q ON q.lang = cuts.lang AND q.phrase = array_to_string(ws[c + 1 : cuts.k], ' ') AND q.k = cuts.k - c
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), sizes AS (
  SELECT lang, ws, a, k, unnest(range(2, k)) AS s FROM cand WHERE k > 2
), starts AS (
  SELECT lang, ws, a, s, unnest(range(1, k - s + 2)) AS i FROM sizes
), around AS (
  SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS most FROM starts GROUP BY 1, 2
), open AS (
  SELECT lang, phrase, a, l, r, n, score FROM lowest LEFT JOIN around USING (lang, phrase) JOIN total USING (lang) WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM open QUALIFY rank <= 2000
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.documents.select("doc_id", *alignment.RESULT)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_urls": op5_urls,
    "op6_licenses": op6_licenses,
    "op7_lines": op7_lines,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_neardup": op10_neardup,
    "op11_phrases": op11_phrases,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}
ORACLES: dict[str, str] = {"op5_urls": OP5_SQL, "op11_phrases": OP11_SQL}
