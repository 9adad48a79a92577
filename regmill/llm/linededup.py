"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, in DataFrame operations.

A text's lines are split at \\n; lines without a word take no part. A run of lines of `MIN_CHARS` characters or more
is a later copy if the same run stands at an earlier place (order: id, null last, then row, then line), in another
document or in the same one with its end before it. Later copies are deleted, with the blank lines inside them; the
first copy stays. Runs may repeat inside one text or across texts, and overlap.

Ranks. Lines that occur once break every run, so only the others are ranked. Doubling joins the rank of a
run of 2**k lines with the rank of the next 2**k; the distinct pairs, sorted by range, give the ranks of runs
twice as long. Rows whose pair stands alone leave. The rank of 2**k lines orders the suffixes to that depth.

Intervals. All suffixes that share their first m lines are one longest-common-prefix interval, named by the ranks
of the two stretches of 2**k <= m lines that cover the m lines. The intervals of the shortest sufficient windows
are enough, those that begin at a line and those that end at one: let a later copy hold the line p and end at e. If the
lines p to e have MIN_CHARS characters, the shortest window from p on lies inside the copy; if not, the shortest
window that ends at e does, and it holds p, as the whole copy is long enough. A part of a later copy is a later
copy, at the same distance from the earlier one. So the union of the windows that are later copies is the union of all
maximal later copies, whatever their length. No window has more than MIN_CHARS lines, as lines with a word have a
character each; that bounds the doubling. The first suffix of an interval is the copy that stays; if a later one
overlaps it, no other suffix of that document stands between them, so it is no later copy.

Cases. Null, empty and blank texts have no lines and stay as they are. Equal rows are copies of each other, the first
one stays. An empty table gives an empty result. Other columns stay, whatever their names; one that is called as
`into` is replaced. Ids are 128-bit hashes of whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop_cut, keyed, numbered, quoted

MIN_CHARS = 50
KEY = ["_file", "_row"]
_DOC = [*KEY, "_ord"]


def _line_table(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: its document, place among such lines, line number, id and length."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("no")))
    worded = F.filter(lines, lambda x: x["line"].rlike(WORD))
    rows = docs.select(*KEY, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_ord"), F.posexplode(worded).alias("seq", "x"))
    return rows.select(*_DOC, "seq", F.col("x.no").alias("no"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit("line"), "x.line").alias("h2"), F.length("x.line").alias("chars"))


def _windows(ranked: DataFrame, least: int) -> DataFrame:
    """The shortest windows of `least` characters that begin, or end, at a line: document, first place s, lines m."""
    doc = Window.partitionBy(*_DOC).orderBy("seq")
    stretch = ranked.withColumn("_g", F.col("seq") - F.row_number().over(doc))
    upto = Window.partitionBy(*_DOC, "_g").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = stretch.withColumn("_to", F.sum("chars").over(upto)).withColumn("_from", F.col("_to") - F.col("chars"))
    event = lambda kind, key, asks: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(asks).alias("asks"))
    events = [event(0, -F.col("_to"), 0), event(0, -(F.col("_from") + least), 1), event(1, F.col("_from"), 0), event(1, F.col("_to") - least, 1)]
    seen = Window.partitionBy(*_DOC, "_g", "kind").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (
        summed.select(*_DOC, "_g", "seq", F.explode(F.array(*events)).alias("e"))
        .select(*_DOC, "_g", "seq", "e.*")
        .withColumn("other", F.last(F.when(F.col("asks") == 0, F.col("seq")), ignorenulls=True).over(seen))
        .where((F.col("asks") == 1) & F.col("other").isNotNull())
    )
    ends = met.select(*_DOC, F.least("seq", "other").alias("s"), (F.abs(F.col("seq") - F.col("other")) + 1).alias("m"))
    return ends.distinct()


def deleted_runs(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """KEY and `_runs`, an ordered array of (first, last, lines): what to delete of the documents (KEY, doc_id, text) that lose lines."""
    lines = cut(_line_table(docs), "lines")
    repeated = lines.groupBy("h1", "h2").count().where("count > 1")
    named = cut(numbered(repeated, [F.col("h1"), F.col("h2")], "r", "line-ids", F.col("count")).drop("count"), "line-ranks")
    level = cut(lines.join(named, ["h1", "h2"]).drop("h1", "h2"), "level-0")
    drop_cut(lines)
    windows = cut(_windows(level, least), "windows")
    depth = windows.agg(F.max("m")).first()[0] or 0
    base, ranks, k = level, level.select(F.lit(0).alias("k"), *KEY, "seq", "r"), 0
    while 2 ** (k + 1) <= depth:
        ahead = Window.partitionBy(*_DOC).orderBy("seq").rangeBetween(2**k, 2**k)
        pairs = cut(level.select(*_DOC, "seq", "r", F.max("r").over(ahead).alias("r2")).where("r2 IS NOT NULL"), f"pairs-{k}")
        again = pairs.groupBy("r", "r2").count().where("count > 1")
        ordered = cut(numbered(again, [F.col("r"), F.col("r2")], "_new", f"order-{k}", F.col("count")).drop("count"), f"ranks-{k}")
        level = cut(pairs.join(ordered, ["r", "r2"]).drop("r", "r2").withColumnRenamed("_new", "r"), f"level-{k + 1}")
        drop_cut(pairs)
        k += 1
        if level.isEmpty():
            break
        ranks = ranks.unionByName(level.select(F.lit(k).alias("k"), *KEY, "seq", "r"))
    power = F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")
    asked = windows.withColumn("k", power).withColumn("seq", F.col("s"))
    first = asked.join(ranks.withColumnRenamed("r", "ra"), ["k", *KEY, "seq"])
    both = first.withColumn("seq", (F.col("s") + F.col("m") - F.expr("shiftleft(1, k)")).cast("int")).join(ranks.withColumnRenamed("r", "rb"), ["k", *KEY, "seq"])
    interval = cut(both.select(*_DOC, "s", "m", "ra", "rb"), "intervals")
    place = F.struct("_ord", "_file", "_row", "s")
    first = cut(interval.groupBy("m", "ra", "rb").agg(F.min(place).alias("p")), "first-copies")
    overlaps = (F.col("p._file") == F.col("_file")) & (F.col("p._row") == F.col("_row")) & (F.col("s") < F.col("p.s") + F.col("m"))
    later = interval.join(first, ["m", "ra", "rb"]).where(~overlaps)
    # a line goes if a later copy that began at it or before reaches it
    spans = later.select(*KEY, F.col("s").alias("seq"), (F.col("s") + F.col("m") - 1).alias("_to"), F.lit(None).cast("int").alias("no"))
    marks = spans.unionByName(base.select(*KEY, "seq", F.lit(-1).alias("_to"), "no"))
    reach = Window.partitionBy(*KEY).orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    gone = marks.withColumn("_to", F.max("_to").over(reach)).where("no IS NOT NULL AND _to >= seq")
    run = F.col("seq") - F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    runs = gone.withColumn("_run", run).groupBy(*KEY, "_run").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count("*").cast("int").alias("lines"))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last", "lines"))).alias("_runs"))


def _without(text: Column, runs: Column) -> Column:
    """The text's lines outside the runs, joined again."""
    lines = F.split(text, "\n")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["last"] + 1)
    end = lambda i: F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["first"])
    parts = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, start(i) + 1, F.greatest(F.lit(0), end(i) - start(i))))
    return F.array_join(F.flatten(parts), "\n")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS, into: str = "_runs") -> DataFrame:
    """docs, one row for each, with the text that stays and, under `into`, what was deleted (null where nothing was)."""
    names = [c for c in docs.columns if c.lower() != into.lower()]
    rows, keys = keyed(docs.select(*quoted(names)))
    as_key = [F.col(k).alias(own) for k, own in zip(keys, KEY, strict=True)]
    as_text = [c.alias(own) for c, own in zip(quoted([doc_id, text]), ("doc_id", "text"), strict=True)]
    runs = cut(deleted_runs(rows.select(*as_key, *as_text), least), "runs")
    # the same join at every size: the runs of a large table are no broadcast
    joined = rows.join(runs.withColumnsRenamed(dict(zip([*KEY, "_runs"], [*keys, into], strict=True))).hint("merge"), keys, "left")
    whole, gone = quoted([text, into])
    left = F.when(gone.isNull(), whole).otherwise(_without(whole, gone)).alias(text)
    return joined.select(*[left if n == text else c for n, c in zip(names, quoted(names), strict=True)], gone)
