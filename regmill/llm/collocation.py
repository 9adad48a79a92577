"""Phrase collocation mining over a prefix-free parsing of the corpus.

Texts are lower-cased (A-Z), split at stops and line ends into pieces, and those at blanks and tabs into words. All counts are
for each language (null: `und`). f of a phrase is the number of its occurrences inside pieces, overlapping ones included.

1. Parsing. A text is a sequence of words, with a mark between pieces and OVERLAP marks at its end. Where the hash of OVERLAP
   neighbours is 0 modulo SPACING a chunk ends with them, and the next begins with them, so equal passages give equal chunks wherever
   they stand, and no chunk is the beginning of another. The distinct chunks with their frequencies are the dictionary.
2. Counting. A phrase of up to OVERLAP + 1 words that begins before a chunk's last OVERLAP words ends inside the chunk; what begins
   in those belongs to the next chunk. So each occurrence is counted once, in each distinct chunk, times the chunk's frequency.
   A phrase that is frequent enough consists of such phrases: words come first, then pairs of frequent words, then phrases all of whose
   pairs are frequent. Tasks look those up in a table of BITS bits that is the same size for any corpus; its collisions let
   rare phrases through, which the exact counts then drop.
3. Scores. Each cut of a candidate into two phrases gives floor(2000000 * a / (l + r)); the lowest counts. A candidate that
   stands inside a longer one which is nearly as frequent goes.

Cases. Null, empty and blank texts have no words. Rows may repeat and share ids; each counts. A text in which no window ends a chunk,
however long, is one chunk. Equal scores are ordered by frequency, then by the phrase's bytes. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, quoted

LONGEST, LEAST, COVERED, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
OVERLAP = LONGEST - 1
#: A chunk has about so many words of its own.
SPACING = 32
#: A stop, as it stands among the words: no word holds one.
STOP = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + STOP * 9 + b" ")
#: Bits of the table of frequent phrases.
BITS = 1 << 26
#: Bytes of chunks that a task holds at once, words that it remembers, rows in a batch that it returns.
AT_ONCE, KNOWN_WORDS, ROWS = 1 << 24, 200_000, 1 << 14


def words_and_stops(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).replace(STOP, b" . ").split()


def _chained(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in their order."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(29))


def chunks_of(text: str | None, known: dict[bytes, int]) -> list[bytes]:
    """The chunks of a text, words parted by blanks; `known` caches hashes of words."""
    words = words_and_stops(text or "")
    if len(words) == words.count(STOP):
        return []
    words += [STOP] * OVERLAP
    if len(known) > KNOWN_WORDS:
        known.clear()
    get = known.get
    h = np.array([get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w) | 1) for w in words], np.uint64)
    last = len(words) - OVERLAP
    windows = _chained([h[i : last + 1 + i] for i in range(OVERLAP)])
    ends = np.flatnonzero(windows % np.uint64(SPACING) == 0)
    ends = [*ends[(ends > 0) & (ends < last)].tolist(), last]
    return [b" ".join(words[s : e + OVERLAP]) for s, e in zip([0, *ends], ends, strict=False)]


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.string())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of texts, counted as far as a task holds them."""
    known: dict[bytes, int] = {}
    counts: dict[str, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counted in counts.items():
            chunks, n = list(counted), list(counted.values())
            for at in range(0, len(chunks), ROWS):
                part = chunks[at : at + ROWS]
                yield pa.record_batch({"lang": pa.array([lang] * len(part)), "chunk": _strings(part), "n": pa.array(n[at : at + ROWS], pa.int64())})
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            found = chunks_of(text.as_py(), known)
            counts.setdefault(lang, Counter()).update(found)
            held += sum(map(len, found))
            if held > AT_ONCE:
                yield from flush()
                held = 0
    yield from flush()


class _Grams:
    """The phrases of chunks of one language: ids of words in their order, and where a phrase may begin."""

    def __init__(self, lang: str, chunks: list[bytes], n: np.ndarray):
        words, seed = [c.split(b" ") for c in chunks], xxhash.xxh3_64_intdigest(lang)
        index = {STOP: 0}
        number = index.setdefault
        self.ids = np.array([number(w, len(index)) for c in words for w in c], np.int64)
        self.words = np.array(list(index), object)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in index], np.uint64)
        lengths = np.array([len(c) for c in words])
        self.weight = np.repeat(n, lengths)
        self.own = np.arange(len(self.ids)) < np.repeat(np.cumsum(lengths) - OVERLAP, lengths)

    def _at(self, values: np.ndarray, i: int) -> np.ndarray:
        """The values i places on; at the end, where nothing begins, the last ones again."""
        return values[np.minimum(np.arange(len(values)) + i, len(values) - 1)]

    def starts(self, k: int, frequent: np.ndarray | None) -> np.ndarray:
        """Where phrases of k words begin whose parts of one word (of two, for k over 2) are in the table."""
        if not len(self.ids):
            return np.zeros(0, np.int64)
        may = self.own.copy()
        if k == 1:
            return np.flatnonzero(may & (self.ids != 0))
        if k == 2:
            held = in_table(frequent, _chained([self.hashes])) & (np.arange(len(self.words)) != 0)
            return np.flatnonzero(may & held[self.ids] & self._at(held[self.ids], 1))
        real, h = self.ids != 0, self.hashes[self.ids]
        at = np.flatnonzero(real & self._at(real, 1))
        held = np.zeros(len(self.ids), bool)
        held[at] = in_table(frequent, _chained([h[at], self._at(h, 1)[at]]))
        for i in range(k - 1):
            may &= self._at(held, i)
        return np.flatnonzero(may)

    def counted(self, k: int, frequent: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
        """The phrases of k words, each once, and their weights summed."""
        starts = self.starts(k, frequent)
        if not len(starts):
            return [], np.zeros(0, np.int64)
        key = self.ids[starts]
        for i in range(1, k):
            if i > 1:  # numbers of the distinct beginnings, so that keys stay below 2**63
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.words) + self.ids[starts + i]
        order = np.argsort(key)
        first = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1])
        sums, at = np.add.reduceat(self.weight[starts[order]], first), starts[order[first]]
        parts = [self.words[self.ids[at + i]].tolist() for i in range(k)]
        return parts[0] if k == 1 else list(map(b" ".join, zip(*parts, strict=True))), sums


def _counting(sizes: tuple[int, ...], frequent):
    """Phrases of these sizes in chunks (lang, chunk, n), counted as far as a task holds them; `frequent` is a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value if frequent else None
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (chunks, n) in held.items():
                grams = _Grams(lang, chunks, np.array(n, np.int64))
                for k in sizes:
                    phrases, f = grams.counted(k, table)
                    for at in range(0, len(phrases), ROWS):
                        part = phrases[at : at + ROWS]
                        yield pa.record_batch({"lang": pa.array([lang] * len(part)), "k": pa.array(np.full(len(part), k, np.int32)), "phrase": _strings(part), "f": pa.array(f[at : at + ROWS])})
            held.clear()

        for b in batches:
            for lang, chunk, n in zip(b.column("lang").to_pylist(), b.column("chunk").cast(pa.binary()).to_pylist(), b.column("n").to_pylist(), strict=True):
                chunks, times = held.setdefault(lang, ([], []))
                chunks.append(chunk)
                times.append(n)
                size += len(chunk)
                if size > AT_ONCE:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(BITS)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _table_of(grams: DataFrame) -> np.ndarray:
    """The bits of phrases (lang, phrase), united before they come to the driver: BITS / 8 bytes, whatever the number of phrases."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = np.zeros(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column("lang").to_pylist(), b.column("phrase").cast(pa.binary()).to_pylist(), strict=True)):
                seed = xxhash.xxh3_64_intdigest(lang)
                hashes[i] = _chained([np.array([xxhash.xxh3_64_intdigest(w, seed)], np.uint64) for w in phrase.split(b" ")])[0]
            bit = hashes % np.uint64(BITS)
            yield pa.record_batch({"word": pa.array((bit >> np.uint64(6)).astype(np.int64)), "bits": pa.array(np.left_shift(np.uint64(1), bit & np.uint64(63)).view(np.int64))})

    rows = grams.select("lang", "phrase").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of LONGEST words at most that occur `least` times, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(quoted([lang])[0].cast("string"), F.lit("und")).alias("lang"), quoted([text])[0].cast("string").alias("text"))
    parsed = rows.where("text IS NOT NULL").mapInArrow(_parsed, "lang string, chunk string, n long")
    dictionary = cut(parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "chunks")

    def counted(sizes: tuple[int, ...], frequent, name: str) -> DataFrame:
        found = dictionary.mapInArrow(_counting(sizes, frequent), "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
        return cut(found if sizes == (1,) else found.where(F.col("f") >= least), name)

    words = counted((1,), None, "words")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    pairs = counted((2,), spark.sparkContext.broadcast(_table_of(frequent)), "pairs")
    longer = counted(tuple(range(3, LONGEST + 1)), spark.sparkContext.broadcast(_table_of(pairs)), "longer")
    drop_cut(dictionary)
    return frequent.unionByName(pairs).unionByName(longer), n


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _exact_score(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a / (l + r)), in decimals, as the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide(a), wide(l) + wide(r))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """Scored candidates that no longer one covers: lang, phrase, k, cut (words of the first part), a, l, r, n, score."""
    grams, n = phrase_counts(docs, text, lang, least)
    words = F.split("phrase", " ")
    candidates = grams.where("k > 1")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "f", "cut", _part(words, F.lit(1), F.col("cut")).alias("first"), _part(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    side = lambda part, into: grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(into))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    lowest = F.min(F.struct(_exact_score(F.col("f"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("m")
    scored = both.groupBy("lang", "phrase", "k", F.col("f").alias("a")).agg(lowest).select("lang", "phrase", "k", "a", "m.*")
    # the phrases inside a longer candidate, with its count
    inside = candidates.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = inside.groupBy("lang", _part(words, F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("around"))
    open_ = scored.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    return open_.drop("around").join(n, "lang").select("lang", "phrase", "k", "cut", "a", "l", "r", "n", "score")


def best(mined: DataFrame, top: int = TOP) -> DataFrame:
    """The first candidates of each language with their rank: first in parts of a language, then among those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = mined.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
