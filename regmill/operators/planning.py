"""Crawl planning as data jobs: what is missing, what came of an attempt, what to do again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.storage import kept
from . import company, lobbyist

FIRST, STOP = 1, 105_000


def skip_cached(candidates: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (key), those to fetch and those already landed, as a detail or a list page."""
    known = manifest.select("key").distinct()
    return candidates.join(known, "key", "left_anti"), candidates.join(known, "key", "left_semi")


def crawl_frontier(spark: SparkSession, manifest: DataFrame, start: int = FIRST, stop: int = STOP, rescrape: bool = False) -> DataFrame:
    """The numbers of a range that are not landed, or all of them."""
    numbers = spark.range(start, stop).select(F.col("id").cast("string").alias("key"))
    return numbers if rescrape else skip_cached(numbers, manifest)[0]


#: Fixed value: numbers in a bucket of Spark's bitmap functions.
BITS = 8 * 4096


def number_bitmaps(keys: DataFrame) -> DataFrame:
    """bucket and bits of the keys (key) that are whole numbers in their plain form; other keys, like those with a suffix, name no number."""
    plain = keys.select(F.col("key").try_cast("long").alias("n"), "key").where(F.col("n").cast("string") == F.col("key"))
    return plain.groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def bitmap_frontier(spark: SparkSession, manifest: DataFrame, start: int = FIRST, stop: int = STOP) -> DataFrame:
    """The same numbers as crawl_frontier's, by bitmaps: of the landed keys one row for each bucket is shuffled, not one for each key.

    Buckets that are landed whole give nothing; of the others each number whose bit is not set. Bits at the range's ends are cut off.
    """
    if stop <= start:
        return spark.createDataFrame([], "key string")
    bucket = lambda n: 1 + (n - 1) // BITS if n > 0 else -(-n // BITS)
    wanted = spark.range(bucket(start), bucket(stop - 1) + 1).select(F.col("id").alias("bucket"))
    landed = number_bitmaps(manifest)
    both = wanted.join(landed, "bucket", "left").where(F.col("bits").isNull() | (F.bitmap_count("bits") < BITS))
    byte = lambda i: F.conv(F.hex(F.substring("bits", (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    free = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("bits").isNull() | (F.getbit(byte(i), i % 8) == 0))
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + F.col("bit") + 1).otherwise(F.col("bucket") * BITS - F.col("bit"))
    return both.select("bucket", F.explode(free).alias("bit")).select(number.alias("n")).where(F.col("n").between(start, stop - 1)).select(F.col("n").cast("string").alias("key"))


def classify_responses(responses: DataFrame) -> DataFrame:
    """Fetched pages (number, url, html) with their kind, and the id that a detail page is saved under."""
    classified = L.once(responses, "kind", company.classify_page("url", "html"))
    return classified.withColumn("saved_id", F.when(F.col("kind") == "details", F.coalesce(company.page_key("html"), F.col("number"))))


def drill_targets(pages: DataFrame) -> DataFrame:
    """One row for each hit of a list page (key, html): list key, row index, number. A number may stand twice on a list."""
    return company.explode_search_hits(pages).select(F.col("key").alias("list_key"), "row_index", "number")


def saved_ids(pages: DataFrame) -> DataFrame:
    """For each list page the ids that a drill saves: the list itself and its hits."""
    return pages.select("key", F.concat(F.array(F.concat("key", F.lit("[list]"))), F.transform(company.search_hits("html"), lambda h: h["number"])).alias("ids_saved"))


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes (kind, ids_saved); kinds that are not known count as errors."""
    kind = F.coalesce(F.col("kind"), F.lit("error"))
    known = ("detail", "hits", "empty", "cached")
    drilled = F.when(kind == "hits", F.greatest(F.lit(0), F.coalesce(F.size("ids_saved"), F.lit(0)) - 1)).otherwise(0)
    return outcomes.agg(
        F.count("*").alias("attempted"), F.count_if(kind == "detail").alias("details"), F.count_if(kind == "hits").alias("multi_hit_pages"),
        F.coalesce(F.sum(drilled), F.lit(0)).cast("long").alias("suffixed_drilled"), F.count_if(kind == "empty").alias("empty"), F.count_if(kind == "cached").alias("cached"),
        F.count_if(~kind.isin(*known)).alias("errors"),
    )


def lobbyist_outcome_stats(outcomes: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col("kind"), F.lit("error"))
    return outcomes.agg(F.count_if(kind == "detail").alias("details"), F.count_if(kind == "skipped").alias("skipped"), F.count_if(~kind.isin("detail", "skipped")).alias("errors"))


def retry_list(errors: DataFrame) -> DataFrame:
    """The numbers of an error log as keys to fetch again, whatever is landed."""
    return errors.select(F.col("number").cast("string").alias("key")).distinct()


def lobbyist_index(pages: DataFrame) -> DataFrame:
    """(registration_number, page_no, row_index) of all hits on list pages (page_no, html)."""
    return L.once(pages, "hits", lobbyist.search_hits("html")).select("page_no", F.explode("hits").alias("h")).select("h.registration_number", "page_no", "h.row_index")


def _index_pages(pages: DataFrame) -> DataFrame:
    """What each list page (page_no, html) says: its marks and its hits, from one pass over it."""
    marked = L.once(L.once(pages.select("page_no", "html"), "marks", lobbyist.page_marks("html")), "hits", lobbyist.search_hits("html"))
    return kept(marked.select(F.col("page_no").cast("long").alias("page_no"), "marks.total", "marks.more", F.transform("hits", lambda h: h["registration_number"]).alias("numbers")), "index-pages")


def _distinct_pages(found: DataFrame) -> DataFrame:
    """One row a page number, however often the page was fetched."""
    return found.groupBy("page_no").agg(F.count("*").alias("times"), F.min("total").alias("low"), F.max("total").alias("high"), F.max("more").alias("more"), F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("numbers"))


def _of_index(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """entries, total and whether the index is complete, from distinct pages and the number of distinct entries."""
    span = pages.agg(
        F.count("*").alias("pages"), F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.min("low").alias("low"), F.max("high").alias("total"),
        F.count_if(~F.col("more")).alias("ends"), F.max(F.when(~F.col("more"), F.col("page_no"))).alias("end"), F.lit(1).alias("_one"),
    )
    c = F.col
    whole = (c("entries") == c("total")) & (c("low") == c("total")) & (c("first") == 1) & (c("pages") == c("last")) & (c("ends") == 1) & (c("end") == c("last"))
    return span.join(totals.withColumn("_one", F.lit(1)), "_one").select("entries", "total", F.coalesce(whole, F.lit(False)).alias("complete"))


def index_complete(pages: DataFrame) -> DataFrame:
    """Whether a listing (page_no, html) is whole: distinct entries equal the total that every page names, and the pages run from 1
    to the only one without a next. Pages that were fetched twice count once; without pages the listing is not complete."""
    distinct = kept(_distinct_pages(_index_pages(pages)), "distinct-pages")
    return _of_index(distinct, distinct.select(F.explode("numbers").alias("number")).agg(F.count_distinct("number").alias("entries")))


def missing_ranges(numbers: DataFrame, column: str = "page_no", least: int = 1) -> DataFrame:
    """first and last of every gap between the numbers (longs), and before the smallest, from `least` on.

    The distinct numbers are put into ranges; each range looks back inside itself, and its smallest at the largest of those before
    it, so that no task sees all numbers and one row for each range is all that meets.
    """
    ranged = kept(numbers.select(F.col(column).cast("long").alias("n")).where(F.col("n") >= least).distinct().repartitionByRange("n").withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("_part").agg(F.max("n").alias("_most")).select("_part", F.max("_most").over(before).alias("_back"))  # a row for each partition
    back = F.coalesce(F.lag("n").over(Window.partitionBy("_part").orderBy("n")), F.col("_back"), F.lit(least - 1))
    gaps = ranged.join(heads, "_part").select("n", back.alias("back")).where("n > back + 1")
    return gaps.select((F.col("back") + 1).alias("first"), (F.col("n") - 1).alias("last"))


def index_gaps(pages: DataFrame) -> DataFrame:
    """What is wrong with a listing (page_no, html), a row for each fault: problem, first and last page, registration number, times.

    Problems: `missing` pages, a page `fetched again`, an entry `repeated` on several places of distinct pages, an `end` before the last page,
    and `no end`, where the last page has a next.
    """
    found = _index_pages(pages)
    distinct = kept(found.groupBy("page_no").agg(F.count("*").alias("times"), F.max("more").alias("more"), F.max("numbers").alias("numbers")), "distinct-pages")
    nothing = F.lit(None).cast("string")
    fault = lambda df, name, first, last, number=nothing, times=F.lit(1).cast("long"): df.select(F.lit(name).alias("problem"), first.alias("first"), last.alias("last"), number.alias("registration_number"), times.alias("times"))
    page, last = F.col("page_no"), distinct.agg(F.max("page_no").alias("last"), F.lit(1).alias("_one"))
    ends = distinct.select("page_no", "more", F.lit(1).alias("_one")).join(last, "_one")
    places = distinct.select("page_no", F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("times"), F.min("page_no").alias("low"), F.max("page_no").alias("high")).where("times > 1")
    return (
        fault(missing_ranges(distinct), "missing", F.col("first"), F.col("last"))
        .unionByName(fault(distinct.where("times > 1"), "fetched again", page, page, times=F.col("times")))
        .unionByName(fault(places, "repeated", F.col("low"), F.col("high"), F.col("number"), F.col("times")))
        .unionByName(fault(ends.where("NOT more AND page_no < last"), "end", page, page))
        .unionByName(fault(ends.where("more AND page_no = last"), "no end", page, page))
    )


def page_work_plan(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages with entries that are not landed, deepest first, with those entries in row order."""
    keyed = index.withColumn("key", F.col("registration_number"))
    todo = skip_cached(keyed, manifest)[0]
    return todo.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("row_index", "registration_number"))).alias("entries")).orderBy(F.desc("page_no"))
