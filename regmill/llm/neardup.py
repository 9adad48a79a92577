"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; a text with fewer words is one shingle; null,
empty and blank texts have empty sets and are linked with nothing. Equal sets collapse into one node first, so
copies cost one row each. A node's sketch is its K smallest hashes.

1. Inverted lists of retained values. Two sets at the threshold have at least `a` of their retained values in common: a set
   that may be linked with sets of K values at most, all of which are retained whole, the threshold's share of its own, exactly;
   of larger ones, all but a share of MISS of the pairs (a tail of the binomial). So in one order of all values, the first n - a + 1 of both hold a common one. That order is by the
   number of nodes that retain a value, rare ones first: values that no other node retains come first and are not
   listed, and common words, lines and passages are listed for those texts only that hold little else.
2. In each list the member with most company is the hub, and every member is paired with it: pairs grow with the
   postings, whatever the size of a group. The union of two sketches estimates similarity; pairs that can't reach the
   threshold but for a share of MISS go, the others are confirmed on full sets. Links give components.
3. Lists whose members lie in several components are looked at again, all their members: short lists pair all members of
   different components, and the pairs are confirmed as above. Members of long lists are packed into blocks of bounded
   bytes, neighbours in a list side by side; every two blocks with a list in common are compared by full sets inside a
   task, which returns the links that join components. No list is capped and no pair in a list is left out,
   unless its members are in one component already.

Cases. Documents may repeat and share ids; each row gets a row, and equal rows get equal components. Of several rows
with the component's smallest id, one is `first`. A null id is linked like any other; its component has the
smallest id that is not null, if there is one. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import possible
from .common import cut, drop_cut, keyed, numbered
from .components import components

K = 128
#: Share of the pairs at the threshold that chance may hide, at each of two places.
MISS = 1e-6
SHORT_LIST = 16
#: Words whose hashes a task keeps at most.
KNOWN_WORDS = 100_000
#: Bytes of the sets in a block, and how many a small set counts as.
BLOCK_BYTES, LEAST_BYTES = 1 << 20, 1 << 12
#: Columns of a table of members by values that a task holds at once.
VALUES_AT_ONCE = 1 << 13
#: Rows whose sets a task makes before it passes them on.
ROWS_AT_ONCE = 512
#: Names of the columns that tell rows apart, in this module.
KEY = ["_file", "_row"]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    out = _mix(parts[0] + np.uint64(len(parts)))
    for p in parts[1:]:
        out = _mix(out * np.uint64(3) + p)
    return out


def shingle_set(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, ASCII letters lower-cased; `known` caches the words' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    get = known.get
    w = np.array([get(x) or known.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in words], np.uint64)
    n = min(size, len(w))
    return np.unique(_chained([w[i : len(w) - n + 1 + i] for i in range(n)]))


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little of what is made from them is held at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def _nodes_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in _in_parts(batches):
            rows = []
            for x in b.column("text"):  # one text and one set at a time
                s = shingle_set(x.as_py(), size, known)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:K].tobytes()))
            n, sigs, sketches = zip(*rows, strict=True) if rows else ((), (), ())
            made = {"n": pa.array(n, pa.int64()), "sig": pa.array(sigs, pa.binary()), "sketch": pa.array(sketches, pa.binary())}
            yield pa.record_batch({c: b.column(c) for c in (*KEY, "doc_id")} | made)

    return run


def _sets_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in _in_parts(batches):
            sets = pa.array((shingle_set(x.as_py(), size, known).tobytes() for x in b.column("text")), pa.binary())
            yield pa.record_batch({"nid": b.column("nid"), "set": sets})

    return run


def fewest(k: int, percent: int) -> int:
    """So many of the k smallest values of a union are in both of two sets at the threshold, but for a share of MISS."""
    t, below = percent / 100, 0.0
    for x in range(k + 1):
        below += math.comb(k, x) * t**x * (1 - t) ** (k - x)
        if below > MISS:
            return x
    return k


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity by the union's sketch: its K smallest values, and how many of them both hold."""
    union = np.union1d(a, b)
    if len(a) >= K or len(b) >= K:
        union = union[:K]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.count_nonzero(both <= union[-1]) / len(union) if len(union) else 0.0


def _numbers(x: pa.BinaryScalar) -> np.ndarray:
    """A packed set, where it lies."""
    return np.frombuffer(x.as_buffer(), np.uint64)


def _estimated(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([estimate(_numbers(x), _numbers(y)) for x, y in zip(a, b, strict=True)], pa.float64())


def _overlap(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([len(np.intersect1d(_numbers(x), _numbers(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], pa.int64())


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each value of each sketch."""
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column("sketch").to_pylist()]
        ids = np.repeat(b.column("nid").to_numpy(), [len(x) for x in sets])
        yield pa.record_batch({"v": pa.array(np.concatenate(sets) if sets else [], pa.int64()), "nid": pa.array(ids, pa.int64())})


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each set of xs has in common with each of ys."""
    every = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (xs, ys)]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (xs, ys)]
    shared = np.intersect1d(*every)
    both = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, len(shared), VALUES_AT_ONCE):
        part = shared[at : at + VALUES_AT_ONCE]
        tables = []
        for values, rows, n in zip(every, owner, (len(xs), len(ys)), strict=True):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            held = part[place] == values
            tables.append(np.zeros((n, len(part)), np.float32))
            tables[-1][rows[held], place[held]] = 1
        both += tables[0] @ tables[1].T
    return both.astype(np.int64)


def joining_links(xs: list[tuple], ys: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Of two lists of (id, label, set), links that join labels: one fewer than there are labels, at most."""
    root = {m[1]: m[1] for m in (*xs, *ys)}

    def top(label: int) -> int:
        while root[label] != label:
            root[label] = label = root[root[label]]
        return label

    sizes = np.array([len(m[2]) for m in xs])[:, None] + np.array([len(m[2]) for m in ys])[None, :]
    both = common_counts([m[2] for m in xs], [m[2] for m in ys])
    apart = np.array([m[1] for m in xs])[:, None] != np.array([m[1] for m in ys])[None, :]
    found = []
    for i, j in np.argwhere(apart & (100 * both >= percent * (sizes - both))):
        a, b = top(xs[i][1]), top(ys[j][1])
        if a != b:
            root[a] = b
            found.append((xs[i][0], ys[j][0]))
    return found


def _in_blocks(percent: int):
    def members(rows: list[dict]) -> list[tuple[int, int, np.ndarray]]:
        return [(m["nid"], m["label"], np.frombuffer(m["set"], np.uint64)) for m in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("xs"), b.column("ys"), strict=True):
                found = joining_links(members(x.as_py()), members(y.as_py()), percent)
                yield pa.record_batch({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


class _Job:
    """One run over rows (KEY, doc_id, text); percent is the similarity threshold."""

    def __init__(self, rows: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = rows.select(*KEY, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        schema = "_file long, _row long, doc_id long, n long, sig binary, sketch binary"
        self.rows = cut(self.docs.mapInArrow(_nodes_of(size), schema), "shingled")
        # equal sets: one node, with the row that stands for it
        place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), *KEY)
        grouped = self.rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(place).alias("at"))
        self.nodes = cut(grouped.select(F.monotonically_increasing_id().alias("nid"), "sig", "id", "n", "sketch", "at.*"), "nodes")

    def lists(self) -> DataFrame:
        """Inverted lists (v, nid, c) of the rarest retained values, c members long, two at least."""
        # a set has a different partner only if its values, one of them not counted in the larger set, are enough
        nodes = self.nodes.where((100 - self.percent) * F.col("n") >= self.percent)
        values = cut(nodes.select("nid", "sketch").mapInArrow(_values, "v long, nid long"), "values")
        common = cut(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "common")
        held = values.join(common, "v").groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
        retained = F.least("n", F.lit(K))
        # sets of up to percent * K values have no partner that is not retained whole
        agreed = F.when(100 * F.col("n") > self.percent * K, F.lit(fewest(K, self.percent))).otherwise(F.ceil(self.percent * F.col("n") / 100))
        # values of no other node come first in the order, and are not listed
        first = (retained - agreed + 1 - (retained - F.size("vs"))).cast("int")
        ranked = held.join(nodes.select("nid", "n"), "nid").withColumn("first", first).where("first > 0")
        postings = cut(ranked.select("nid", F.explode(F.slice("vs", F.lit(1), F.col("first"))).alias("x")).select("nid", "x.v"), "postings")
        drop_cut(values)
        sizes = cut(postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
        return cut(postings.join(sizes, "v"), "lists")

    def sets(self, needed: DataFrame) -> DataFrame:
        """The full sets of some nodes: small ones are their sketches, and only texts that may belong to others are moved."""
        held = cut(needed.join(self.nodes.select("nid", "n", "sketch", *KEY), "nid"), "held")
        small = held.where(F.col("n") <= K).select("nid", F.col("sketch").alias("set"))
        rows = cut(held.where(F.col("n") > K).select("nid", *KEY), "needed")
        texts = possible(self.docs.drop("doc_id"), rows, KEY).join(rows.hint("merge"), KEY).select("nid", "text")
        return cut(texts.mapInArrow(_sets_of(self.size), "nid long, set binary").unionByName(small), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), those whose estimate passes and whose full sets are similar enough."""
        side = lambda c: self.nodes.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        fits = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        passed = F.arrow_udf(_estimated, "double")("sa", "sb") >= fewest(K, self.percent) / K
        likely = cut(sized.where(fits).where(passed).select("a", "b", "na", "nb"), "likely")
        sets = self.sets(likely.select(F.col("a").alias("nid")).unionByName(likely.select(F.col("b").alias("nid"))).distinct())
        both = likely.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("xb")), "b")
        common = both.select("a", "b", (F.col("na") + F.col("nb")).alias("both"), F.arrow_udf(_overlap, "long")("xa", "xb").alias("i"))
        links = cut(common.where(100 * F.col("i") >= self.percent * (F.col("both") - F.col("i"))).select("a", "b"), "links")
        drop_cut(sets)
        return links

    def links(self) -> DataFrame:
        lists = self.lists()
        company = lists.groupBy("nid").agg(F.sum("c").alias("w"))
        hubs = cut(lists.join(company, "nid").groupBy("v").agg(F.max(F.struct("w", "nid")).alias("h")).select("v", F.col("h.nid").alias("hub")), "hubs")
        star = lists.join(hubs, "v").where("hub <> nid").select(F.least("hub", "nid").alias("a"), F.greatest("hub", "nid").alias("b")).distinct()
        star = cut(star, "star")
        first = self.confirmed(star)
        labelled = lists.join(components(first), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
        several = labelled.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
        open_ = cut(labelled.join(cut(several, "several"), "v"), "open")
        more = self.pairs(open_.where(F.col("c") <= SHORT_LIST)).join(star, ["a", "b"], "left_anti")
        return first.unionByName(self.confirmed(more)).unionByName(self.blocks(open_.where(F.col("c") > SHORT_LIST)))

    def pairs(self, short: DataFrame) -> DataFrame:
        """All pairs of different components in lists of SHORT_LIST members at most."""
        lists = short.groupBy("v").agg(F.collect_list(F.struct("nid", "label")).alias("ms"))
        x = lists.select(F.explode("ms").alias("x"), "ms").select("x", F.explode(F.filter("ms", lambda m: (m["nid"] > F.col("x.nid")) & (m["label"] != F.col("x.label")))).alias("y"))
        return x.select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b")).distinct()

    def blocks(self, members: DataFrame) -> DataFrame:
        """Links between components among the members (v, nid, c, label) of long lists."""
        # a member's home is its longest list; homes and labels stay together, so that few blocks meet
        homes = members.groupBy("nid").agg(F.first("label").alias("label"), F.max(F.struct("c", "v")).alias("home"))
        homes = homes.join(self.nodes.select("nid", "n"), "nid").select("nid", "label", F.col("home.c").alias("c"), F.col("home.v").alias("home"), F.greatest(8 * F.col("n"), F.lit(LEAST_BYTES)).alias("bytes"))
        placed = numbered(homes, [F.desc("c"), F.asc("home"), F.asc("label"), F.asc("nid")], "at", "homes", F.col("bytes"))
        placed = cut(placed.select("nid", "label", F.floor(F.col("at") / BLOCK_BYTES).alias("block")), "placed")
        sets = self.sets(placed.select("nid"))
        packed = placed.join(sets, "nid").groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.collect_list(F.struct("nid", "label", "set")).alias("ms"))
        packed = cut(packed, "blocks")
        # many lists meet the same blocks
        met = members.select("v", "nid").join(placed.select("nid", "block"), "nid").groupBy("v").agg(F.array_sort(F.collect_set("block")).alias("bs")).select("bs").distinct()
        twos = met.select(F.explode("bs").alias("x"), "bs").select("x", F.explode(F.filter("bs", lambda b: b >= F.col("x"))).alias("y")).distinct()
        side = lambda c: packed.select(F.col("block").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"), F.col("ms").alias(f"{c}s"))
        pairs = cut(twos.join(side("x"), "x").join(side("y"), "y").where("least(lo_x, lo_y) <> greatest(hi_x, hi_y)").select("xs", "ys"), "block-pairs")
        joined = cut(pairs.mapInArrow(_in_blocks(self.percent), "a long, b long"), "joined")
        for made in (sets, packed, pairs):
            drop_cut(made)
        return joined


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, keys: list[str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): _file, _row, doc_id, n_shingles, component_id, and first (the one row that stands for the component).

    `keys` names two columns that tell the rows apart, as `common.keyed` gives them; their values are returned as _file and _row.
    """
    if keys is None:
        docs, keys = keyed(docs.select("doc_id", "text"))
    job = _Job(docs.select("doc_id", "text", *[F.col(f"`{k}`").alias(into) for k, into in zip(keys, KEY, strict=True)]), size, percent)
    labels = components(job.links())
    nodes = job.nodes.select("nid", "sig", "id", F.struct("ord", *KEY).alias("at")).join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    nodes = cut(nodes, "labelled")
    least = cut(nodes.groupBy("label").agg(F.min("id").alias("component_id"), F.min("at").alias("best")), "least")
    known = cut(nodes.join(least, "label").select("sig", "component_id", F.struct(*[F.col(f"best.{c}") for c in KEY]).alias("_best")), "known")
    joined = job.rows.drop("sketch").withColumn("sig", F.when(F.col("n") > 0, F.col("sig"))).join(known, "sig", "left")
    alone = F.col("n") == 0
    return joined.select(
        *KEY, "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.struct(*KEY) == F.col("_best"))).alias("first"),
    )
