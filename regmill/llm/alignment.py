"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a piece model stand for the same bytes, counted in inverted pair bitmaps.

Both encode a blank and the text: A adds none, B adds its own. Where tokens of both end at one byte, a group ends; each A
token of a group is linked with each B token of it. A null or empty text, and one whose tokens do not give its bytes back
(B writes a blank as U+2581, so a text with that letter), has no tokens.

1. Segments. Between a letter that is no white space and a blank or line feed, both tokenizers end a token, and what follows is
   encoded as if it stood alone: A's pattern ends a match there and looks behind no match, and no piece of B holds a blank behind
   another letter, or a line feed (`_Pieces` checks the model for that). So a text is cut there, each distinct segment is encoded
   and aligned once for as long as a task remembers it, and texts are put together from segments.
2. Inverted pair bitmaps. The documents of a task are numbered in blocks. For each pair of ids a block has a compressed bitmap of
   the documents that hold the pair linked (sorted places while they take less room than bits), and planes: plane j has the
   documents whose number of further links of the pair has bit j set. A batch's bitmaps are OR-merged into its block's.
3. Counts. A pair's documents are the set bits of all its blocks, its links those and 2**j for each set bit of plane j. Only
   counts meet; no task sees all blocks of a pair. From these come each A id's highest count and each pair's score.
4. Postings return the scores: a block's bitmaps, with the scores of their pairs, are added up over the documents at the set bits.

Cases. Equal texts get equal rows; rows may repeat and share ids, each counts as a document. A very long text is a batch and a
block of its own; it may be one segment. An empty table gives an empty result. Other columns stay, whatever their names, but for
those that the result adds, and the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ..sources.storage import scratch
from .common import cut, quoted

#: Ends before a blank or line feed that follows a letter; white space of other kinds does not end a match of A's pattern for sure.
SEGMENT = re.compile(r"[ \n]+[^ \n]*(?:(?<=\s)[ \n]+[^ \n]*)*")
#: Places in a block; a bitmap has as many bits.
PLACES = 4096
BITMAP_BYTES = PLACES // 8
#: Characters of text in a batch and in a block, one text at least.
BATCH_CHARS, BLOCK_CHARS = 1 << 21, 1 << 23
#: Segments that a task remembers between batches, and their characters, at most.
KNOWN_SEGMENTS, KNOWN_CHARS = 250_000, 1 << 23

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = (*COUNTS, "n_best", "count_sum", "groups_sha256")


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _Bytes:
    """Tokenizer A: ids of a text, and the bytes of an id."""

    def __init__(self, spec: str):
        self.model = Tokenizer.from_str(spec)
        self.model.encode_special_tokens = True
        letters = _byte_letters()
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.of: list[bytes] = [b"\xff"] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.of[i] = bytes(letters[c] for c in entry)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class _Pieces:
    """Tokenizer B. It puts a blank before what it encodes; a line feed, which joins nothing, keeps that away from a segment."""

    def __init__(self, proto: bytes):
        self.model = SentencePieceProcessor(model_proto=proto)
        self.of: list[bytes] = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.of.append(bytes([int(piece[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.of.append(b"\xff")
            elif "\n" in piece or "▁" in piece.lstrip("▁"):
                raise ValueError(f"a piece of this model goes on over a blank or line feed: {piece!r}")
            else:
                self.of.append(piece.replace("▁", " ").encode())
        self.lead = len(self.model.encode("\n", num_threads=1))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode("\n" + text, num_threads=1)[self.lead :], np.int64)


def _names(n: int, more: str, last: str) -> np.ndarray:
    """How ids are written inside a group (0..n-1) and at its end (n..2n-1)."""
    return np.array([f"{i}{more}" for i in range(n)] + [f"{i}{last}" for i in range(n)], object)


class Aligner:
    """Segments and what they align to, remembered; `a`, `b` are the tokenizers' files."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = _Bytes(a), _Pieces(b)
        self.width = len(self.b.of)  # a pair is a * width + b
        self.len_a, self.len_b = (np.array([len(x) for x in t.of], np.int64) for t in (self.a, self.b))
        self.names_a, self.names_b = _names(len(self.a.of), ",", "|"), _names(len(self.b.of), ",", ";")
        self.index: dict[str, int] = {}
        self.groups: list[str] = []  # of each segment, a semicolon behind each group
        self.numbers = np.zeros((0, len(COUNTS)), np.int64)
        self.whole = np.zeros(0, bool)
        self.starts, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)  # batches that held the segment
        self.chars = 0

    def forget(self) -> None:
        """Keep what several batches held, as far as half of what may be kept."""
        least = 2
        while (kept := self.seen >= least).sum() > KNOWN_SEGMENTS // 2:
            least *= 2
        kept &= np.fromiter(map(len, self.index), np.int64) <= KNOWN_CHARS // KNOWN_SEGMENTS
        names = [s for s, k in zip(self.index, kept, strict=True) if k]
        at = np.flatnonzero(kept)
        times = self.numbers[at, 3]
        shift = np.cumsum(times) - times
        self.pairs = self.pairs[np.repeat(self.starts[at] - shift, times) + np.arange(times.sum())]
        self.starts, self.numbers, self.whole, self.seen = shift, self.numbers[at], self.whole[at], np.ones(len(at), np.int64)
        self.groups = [self.groups[i] for i in at]
        self.index, self.chars = dict(zip(names, range(len(names)), strict=True)), sum(map(len, names))

    def learn(self, segments: list[str]) -> None:
        """Remember new segments: those that another may follow are encoded in one go."""
        closed = [s for s in segments if not s[-1].isspace()]
        self._learn(closed)
        for s in segments:
            if s[-1].isspace():  # the end of a text
                self._learn([s])

    def _learn(self, segments: list[str]) -> None:
        if not segments:
            return
        text = "".join(segments)
        raw, ids = text.encode(), (self.a.encode(text), self.b.encode(text))
        if any(b"".join(map(t.of.__getitem__, x.tolist())) != raw for t, x in zip((self.a, self.b), ids, strict=True)):
            if len(segments) > 1:  # bytes got lost: in which?
                half = len(segments) // 2
                self._learn(segments[:half])
                self._learn(segments[half:])
            else:
                self._add(segments, [""], np.zeros((1, len(COUNTS)), np.int64), np.zeros(1, bool), np.zeros(0, np.int64))
            return
        ends = tuple(np.cumsum(n[x]) for n, x in zip((self.len_a, self.len_b), ids, strict=True))
        is_end = np.zeros(len(raw) + 1, bool)
        is_end[ends[1]] = True
        common = ends[0][is_end[ends[0]]]
        limits = np.cumsum([len(s.encode()) for s in segments])
        group = tuple(np.searchsorted(common, e) for e in ends)
        size = tuple(np.bincount(g, minlength=len(common)) for g in group)
        upto = tuple(np.cumsum(n) for n in size)
        # every A token of a group with every B token of it
        times = size[1][group[0]]
        shift = np.cumsum(times) - times
        pairs = np.repeat(ids[0] * self.width, times) + ids[1][np.repeat((upto[1] - size[1])[group[0]] - shift, times) + np.arange(times.sum())]
        home = np.searchsorted(limits, common)
        numbers = np.stack([np.bincount(home, x, len(segments)) for x in (*size, np.ones(len(common)), size[0] * size[1])], 1).astype(np.int64)
        # names of the tokens, those of B behind those of A in each group
        words = np.empty(len(ids[0]) + len(ids[1]), object)
        words[np.arange(len(ids[0])) + (upto[1] - size[1])[group[0]]] = self.names_a[ids[0] + len(self.a.of) * is_end[ends[0]]]
        is_end[:] = False
        is_end[common] = True
        words[np.arange(len(ids[1])) + upto[0][group[1]]] = self.names_b[ids[1] + len(self.b.of) * is_end[ends[1]]]
        words, to = words.tolist(), np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
        self._add(segments, ["".join(words[p:q]) for p, q in zip([0, *to], to, strict=False)], numbers, np.ones(len(segments), bool), pairs)

    def _add(self, segments: list[str], groups: list[str], numbers: np.ndarray, whole: np.ndarray, pairs: np.ndarray) -> None:
        self.index.update(zip(segments, range(len(self.index), len(self.index) + len(segments)), strict=True))
        self.chars += sum(map(len, segments))
        self.groups += groups
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(numbers[:, 3]) - numbers[:, 3]])
        self.numbers, self.whole, self.pairs = (np.concatenate(x) for x in ((self.numbers, numbers), (self.whole, whole), (self.pairs, pairs)))
        self.seen = np.concatenate([self.seen, np.zeros(len(segments), np.int64)])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """COUNTS of each text, its groups as a string, and its links: the text's place and the pair of each."""
        if len(self.index) > KNOWN_SEGMENTS or self.chars > KNOWN_CHARS:
            self.forget()
        parts = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        self.learn(list(set(chain.from_iterable(parts)).difference(self.index)))
        at = [list(map(self.index.__getitem__, p)) for p in parts]
        at = [x if all(self.whole[x]) else [] for x in at]
        self.seen[list(set(chain.from_iterable(at)))] += 1
        flat, owner = np.fromiter(chain.from_iterable(at), np.int64), np.repeat(np.arange(len(at)), [len(x) for x in at])
        numbers = np.stack([np.bincount(owner, self.numbers[flat, i], len(texts)) for i in range(len(COUNTS))], 1).astype(np.int64)
        times = self.numbers[flat, 3]
        shift = np.cumsum(times) - times
        pairs = self.pairs[np.repeat(self.starts[flat] - shift, times) + np.arange(times.sum())]
        return numbers, ["".join(map(self.groups.__getitem__, x))[:-1] for x in at], np.repeat(owner, times), pairs


def bitmaps(places: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Compressed bitmaps of places (ascending, `sizes` of them each): the places as 16-bit numbers while bits would take more room."""
    dense = 2 * sizes >= BITMAP_BYTES
    rooms = np.where(dense, BITMAP_BYTES, 2 * sizes)
    ends = np.concatenate([[0], np.cumsum(rooms)])
    out = np.zeros(ends[-1] // 2, "<u2")
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(places)) - np.repeat(starts, sizes)
    sparse = np.repeat(~dense, sizes)
    out[(np.repeat(ends[:-1] // 2, sizes) + within)[sparse]] = places[sparse]
    for i in np.flatnonzero(dense):
        bits = np.zeros(PLACES, bool)
        bits[places[starts[i] : starts[i] + sizes[i]]] = True
        out[ends[i] // 2 : ends[i + 1] // 2] = np.packbits(bits, bitorder="little").view("<u2")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def places_of(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of compressed bitmaps: the bitmap's number and the place, for every set bit."""
    ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    data = np.frombuffer(bits.buffers()[2], "<u2") if bits.buffers()[2] else np.zeros(0, "<u2")
    rooms = np.diff(ends)
    sparse = np.repeat(rooms < BITMAP_BYTES, rooms // 2)
    owner, held = np.repeat(np.arange(len(bits)), rooms // 2)[sparse], data[ends[0] // 2 : ends[-1] // 2][sparse]
    owners, places = [owner], [held.astype(np.int64)]
    for i in np.flatnonzero(rooms == BITMAP_BYTES):
        found = np.flatnonzero(np.unpackbits(data[ends[i] // 2 : ends[i + 1] // 2].view(np.uint8), bitorder="little"))
        owners.append(np.full(len(found), i))
        places.append(found)
    return np.concatenate(owners), np.concatenate(places)


def popcount(bits: Column) -> Column:
    """Set bits of a compressed bitmap."""
    return F.when(F.octet_length(bits) == BITMAP_BYTES, F.bitmap_count(bits)).otherwise((F.octet_length(bits) / 2).cast("long"))


class _Block:
    """The links of up to PLACES documents: the bitmaps of its batches, united by pair."""

    def __init__(self, number: int):
        self.number, self.size, self.chars = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def unite(self, places: np.ndarray, pairs: np.ndarray) -> None:
        keys, times = np.unique(pairs * PLACES + places, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def postings(self, width: int) -> Iterator[dict[str, pa.Array]]:
        """Rows (block, plane, a, b, bits): plane -1 has the documents, plane j those whose further links have bit j set."""
        if not self.keys:
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, further, plane = keys[order], times[order] - 1, -1
        while len(keys):
            own = keys if plane < 0 else keys[(further >> plane) & 1 == 1]
            pairs, sizes = np.unique(own // PLACES, return_counts=True)
            yield {
                "block": pa.array(np.full(len(pairs), self.number)), "plane": pa.array(np.full(len(pairs), plane, np.int32)),
                "a": pa.array((pairs // width).astype(np.int32)), "b": pa.array((pairs % width).astype(np.int32)), "bits": bitmaps((own % PLACES).astype("<u2"), sizes),
            }
            plane += 1
            left = further >> plane > 0
            keys, further = keys[left], further[left]


_DOC = "block long, place int, groups_sha256 string, groups string, " + ", ".join(f"{c} long" for c in COUNTS)
_POSTING = "plane int, a int, b int, bits binary"
_TYPES = {"long": (LongType(), pa.int64()), "int": (IntegerType(), pa.int32()), "string": (StringType(), pa.string()), "binary": (BinaryType(), pa.binary())}


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text, one row at least."""
    text = batch.column("text")
    sizes, first, held = compute.fill_null(compute.binary_length(text), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > first and (held + n > BATCH_CHARS or i - first >= PLACES):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def _aligned(a: str, b: bytes, keep_groups: bool, schema: pa.Schema):
    def made(rows: int, columns: dict) -> pa.RecordBatch:
        return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(a, b), _Block(TaskContext.get().partitionId() << 32)

        def postings(done: _Block) -> Iterator[pa.RecordBatch]:
            for p in done.postings(aligner.width):
                yield made(len(p["a"]), p | {"kind": pa.array(["posting"] * len(p["a"]))})

        for batch in chain.from_iterable(map(_batches, batches)):
            texts = batch.column("text").to_pylist()
            chars = sum(map(len, filter(None, texts)))
            if block.size and (block.size + len(texts) > PLACES or block.chars + chars > BLOCK_CHARS):
                yield from postings(block)
                block = _Block(block.number + 1)
            numbers, groups, places, pairs = aligner.align(texts)
            block.unite(places + block.size, pairs)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            columns = {"kind": pa.array(["document"] * len(texts)), "_own": batch.column("_own"), "block": pa.array(np.full(len(texts), block.number)), "place": pa.array(np.arange(len(texts), dtype=np.int32) + block.size), "groups_sha256": pa.array(digests)}
            columns |= {c: pa.array(numbers[:, i]) for i, c in enumerate(COUNTS)} | ({"groups": pa.array(groups)} if keep_groups else {})
            yield made(len(texts), columns)
            block.size, block.chars = block.size + len(texts), block.chars + chars
        yield from postings(block)

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with scores, sorted by block: what each document of a block gets."""
    at, sums = None, np.zeros((2, PLACES), np.int64)

    def result() -> pa.RecordBatch:
        places = np.flatnonzero(sums[1])
        return pa.record_batch({"block": pa.array(np.full(len(places), at, np.int64)), "place": pa.array(places.astype(np.int32)), "n_best": pa.array(sums[0][places]), "count_sum": pa.array(sums[1][places])})

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        limits = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
        for lo, hi in zip(limits, limits[1:], strict=False):
            if lo == hi:
                continue
            if at is not None and at != blocks[lo]:
                yield result()
                sums[:] = 0
            at, rows = int(blocks[lo]), batch.slice(lo, hi - lo)
            weight = np.left_shift(1, np.maximum(rows.column("plane").to_numpy(), 0).astype(np.int64))
            owner, places = places_of(rows.column("bits"))
            for into, gain in zip(sums, (weight * rows.column("best").to_numpy(zero_copy_only=False), weight * rows.column("documents").to_numpy()), strict=True):
                np.add.at(into, places, gain[owner])
    if at is not None:
        yield result()


@dataclass
class Aligned:
    """documents: the other columns of the table and RESULT (and `groups`, where kept); postings: block, plane, a, b, bits; pairs: a, b, documents, links, best."""

    documents: DataFrame
    postings: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, json_path: str, model_path: str, text: str = "text", keep_groups: bool = False) -> Aligned:
    """Align the tokens of every text; see the module's text."""
    spark = docs.sparkSession
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:  # vocabulary files, of fixed size
        a, b = f.read(), g.read()
    names = [c for c in docs.columns if c != text and c.lower() not in (RESULT + ("groups",) if keep_groups else RESULT)]
    own = F.struct(*quoted(names)) if names else F.struct(F.lit(None).cast("int").alias("none"))
    packed = docs.select(own.alias("_own"), quoted([text])[0].cast("string").alias("text"))
    more = [x.split() for x in f"kind string, {_DOC}, {_POSTING}".split(", ")]
    shape = StructType([StructField("_own", packed.schema["_own"].dataType), *[StructField(c, _TYPES[t][0]) for c, t in more]])
    # postings have no row of their own
    fields = [pa.field("_own", to_arrow_type(shape["_own"].dataType)), *[pa.field(c, _TYPES[t][1]) for c, t in more]]
    where = scratch(spark, "aligned")
    packed.mapInArrow(_aligned(a, b, keep_groups, pa.schema(fields)), shape).write.partitionBy("kind").parquet(where)
    made = spark.read.schema(shape).parquet(where)
    rows = made.where("kind = 'document'").select("_own", *[x.split()[0] for x in _DOC.split(", ")])
    postings = made.where("kind = 'posting'").select("block", *[x.split()[0] for x in _POSTING.split(", ")])
    ones = popcount(F.col("bits"))
    counted = postings.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") < 0, ones).otherwise(0)).alias("documents"), F.sum(ones * F.expr("shiftleft(1L, greatest(plane, 0))")).alias("links")
    )
    counts = cut(counted, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("documents").alias("_most"))
    pairs = cut(counts.join(highest, "a").select("a", "b", "documents", "links", (F.col("documents") == F.col("_most")).alias("best")), "pair-scores")
    scored = postings.join(pairs.select("a", "b", "documents", F.col("best").cast("long").alias("best")), ["a", "b"])
    ordered = scored.select("block", "plane", "bits", "documents", "best").repartition("block").sortWithinPartitions("block")
    gains = ordered.mapInArrow(_scored, "block long, place int, n_best long, count_sum long")
    joined = rows.join(gains, ["block", "place"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    kept = [F.col("_own")[c].alias(c) for c in names]
    return Aligned(joined.select(*kept, *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if keep_groups else [])), postings, pairs)
