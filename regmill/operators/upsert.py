"""Replace-by-key loads with an appended audit log, published as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import page_sha256
from ..sources import counts
from ..sources.bucketed import save_companies
from ..sources.schemas import CHILDREN, TABLES, conform
from ..sources.storage import BUCKET_BYTES, Tables, kept, scratch
from . import company, lobbyist, trigrams


def delete_matching(target: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """target without the rows whose column is among the keys."""
    return target.join(keys.select(F.col(key).alias(column)), column, "left_anti").select(*target.columns)


def upsert_parent(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """old with new rows put in the place of those with the same key."""
    key = TABLES[table].key[0]
    return delete_matching(old, new, key, key).unionByName(conform(new, table))


def replace_children(old: DataFrame, parents: DataFrame, parent_key: str, new: DataFrame, table: str) -> DataFrame:
    """old without the children of every parent in the batch, also of one that has none now, and the new ones."""
    return delete_matching(old, parents, TABLES[table].parent, parent_key).unionByName(conform(new, table))


def dedupe_batch(parsed: DataFrame, number: Column) -> DataFrame:
    """One good page for each number: the one whose key is the number, else the highest key. Failed pages stay."""
    best = Window.partitionBy("_number").orderBy(F.desc(F.col("key") == F.col("_number")), F.desc("key"), F.desc("html"))
    good = parsed.where("parse_error IS NULL").withColumn("_number", number).withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return good.drop("_number", "_rank")


def log_rows(parsed: DataFrame, kind: str) -> DataFrame:
    """What the log gets for every page: kind, key of the file, outcome, error, content hash."""
    ok = F.col("parse_error").isNull()
    return parsed.select(F.lit(kind).alias("kind"), F.col("key").alias("record_key"), ok.alias("parsed_ok"), F.col("parse_error").alias("error"), page_sha256("html").alias("source_html_sha256"))


def numbered_log(rows: DataFrame, last: int) -> tuple[DataFrame, int]:
    """The new rows of the log, numbered on from the last id in the order of kind and key, and the last id now.

    The numbers come from counts of range partitions, so no task sees all rows.
    """
    order = ["kind", "record_key", "source_html_sha256"]
    where = scratch(rows.sparkSession, "log")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(where)
    ranged = rows.sparkSession.read.parquet(where)
    total, starts = last, []
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect()):  # one row for each partition
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts or [(0, last)], "_part int, _start long")
    placed = ranged.withColumn("id", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return conform(placed.join(offsets, "_part").withColumn("id", F.col("id") + F.col("_start")), "ingest_log"), total


def ok_err_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if("parsed_ok").alias("ok"), F.count_if(~F.col("parsed_ok")).alias("err"))


def company_tables(parsed: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The numbers of the good pages, and their rows in each company table."""
    good = kept(dedupe_batch(parsed, F.col("company.number")), "good")
    rows = {"companies": conform(company.company_rows(good), "companies")}
    return good.select("company.number"), rows | {t.name: conform(company.child_rows(good, t.name), t.name) for t in CHILDREN}


def lobbyist_tables(parsed: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    good = kept(dedupe_batch(parsed, F.col("lobbyist.registration_number")), "good")
    return good.select("lobbyist.registration_number"), {"lobbyist_registrations": conform(lobbyist.lobbyist_rows(good), "lobbyist_registrations")}


#: Kind -> parser, and what the tables get.
KINDS = {"company": (company.parse_companies, company_tables), "lobbyist": (lobbyist.parse_lobbyists, lobbyist_tables)}
LOG = "ingest_log"
#: Table -> what its rows are counted by; all are closed sets.
COUNTED = {"companies": "corporation_type", "lobbyist_registrations": "lobbyist_type", LOG: "concat(kind, if(parsed_ok, ' ok', ' err'))"} | {t.name: "null" for t in CHILDREN}


def replaced_by(name: str) -> tuple[str, ...]:
    """The column whose values a load replaces: the key, or a child's parent; none for the log."""
    spec = TABLES[name]
    return () if name == LOG else (spec.parent or spec.key[0],)


class Store:
    """The tables under a root folder. A load adds a run to the tables of its kind; the log is appended to."""

    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.versions = spark, Tables(spark, root, bucket_bytes)

    def table(self, name: str) -> DataFrame:
        return self.versions.read(name, TABLES[name].schema, replaced_by(name))

    def rows_of(self, name: str, key: str) -> DataFrame:
        """The rows of one parent's key, from its bucket's files and the runs alone."""
        return self.versions.read(name, TABLES[name].schema, replaced_by(name), values=(key,))

    def ingest(self, pages: DataFrame, kind: str, log: bool = True, batch: tuple[str, int] | None = None, beside: dict[str, tuple] | None = None) -> int:
        """Load detail pages (key, html) and publish the next version, which is returned. A failed page leaves earlier rows as they are.

        What is written grows with the pages, not with the tables. If another load publishes meanwhile, this one goes on top of it.
        `batch` names a stream and the number of its batch: one that is published already is not loaded again, so a replay
        changes nothing. `beside` has runs (rows, keys) of further tables, which the same version lists.
        """
        if kind not in KINDS:
            raise ValueError(f"unknown ingest kind: {kind!r}")
        done = lambda state: bool(batch) and state["notes"].get(f"batch {batch[0]}", -1) >= batch[1]
        if done(state := self.versions.state()):
            return state["version"]
        parse, rows_for = KINDS[kind]
        parsed = kept(parse(pages.select("key", "html")), kind)
        keys, rows = rows_for(parsed)
        named = self.versions.write_keys(keys, kind)
        written = {name: self.versions.write(df, name) for name, df in rows.items()}
        grams: dict[str, dict] = {}

        def change(state: dict) -> bool | None:
            if done(state):
                return False
            for name, run in written.items():
                self._put(state, name, run, named)
                if name in trigrams.SEARCHED and state["notes"].get("search index"):
                    if name not in grams:  # of the rows as they were written
                        grams[name] = self._indexed(self.spark.read.schema(TABLES[name].schema).parquet(f"{self.versions.root}/{run['folder']}"), name)
                    self._add_index(state, name, named, grams[name])
            if log:
                made, state["notes"]["last log id"] = numbered_log(log_rows(parsed, kind), state["notes"].get("last log id", 0))
                self._put(state, LOG, self.versions.write(made, LOG), None)
            for name, (rows_, keys_) in (beside or {}).items():
                self._put(state, name, rows_, keys_)
            if batch:
                state["notes"][f"batch {batch[0]}"] = batch[1]

        version = self.versions.commit(change)
        for name in (*written, LOG):
            self.versions.tend(name, TABLES[name].schema, replaced_by(name))
        for name in grams:
            self.versions.tend(trigrams.index_name(name), trigrams.POSTINGS, ("key",), ("gram",))
            self.versions.tend(trigrams.counts_name(name), trigrams.COUNTS)
        return version

    def publish(self, runs: dict[str, tuple]) -> int:
        """A version with runs (rows, keys) on top of tables, and nothing else that is new."""

        def change(state: dict) -> None:
            for name, (rows, keys) in runs.items():
                self._put(state, name, rows, keys)

        return self.versions.commit(change)

    def _put(self, state: dict, name: str, rows: dict | None, keys: dict | None) -> None:
        """A run on top of a table, or rows behind an appended one, and the counts with it."""
        if name in TABLES:
            counts.keep_up(self.versions, state, name, TABLES[name].schema, replaced_by(name), rows, keys)
        if keys is None:
            self.versions.append(state, name, rows)
        else:
            self.versions.add(state, name, rows, keys)

    def create_counts(self) -> int:
        """Count all tables; from now on every load keeps the counts up."""

        def change(state: dict) -> bool | None:
            if "counts" in state["notes"]:
                return False
            for name, by in COUNTED.items():
                counts.start(self.versions, state, name, TABLES[name].schema, replaced_by(name), by)

        return self.versions.commit(change)

    def counts(self) -> DataFrame:
        """table, value, n as the newest version notes them: no file of a table is opened."""
        return counts.noted(self.versions)

    def save_for_joins(self, prefix: str, where: str | None = None) -> dict[str, DataFrame]:
        """The company tables of now as catalog tables in the same buckets, as many as the largest one's bytes ask for."""
        tables = {t: self.table(t) for t in ("companies", *[c.name for c in CHILDREN])}
        held = self.versions.state()["tables"]
        size = lambda t: sum(x["bytes"] for x in (held[t]["base"], *[r["rows"] for r in held[t]["runs"]]) if x)
        largest = max((size(t) for t in tables if t in held), default=0)
        buckets = 1 << max(1, (largest // self.versions.bucket_bytes).bit_length())
        return save_companies(tables["companies"], tables, prefix, buckets, where)

    def _indexed(self, rows: DataFrame, name: str) -> dict:
        made = self.versions.write(trigrams.postings(rows, name), trigrams.index_name(name))
        read = self.spark.read.schema(trigrams.POSTINGS).parquet(f"{self.versions.root}/{made['folder']}")
        return {"postings": made, "counts": self.versions.write(trigrams.counts(read), trigrams.counts_name(name))}

    def _add_index(self, state: dict, name: str, keys: dict, made: dict) -> None:
        self.versions.add(state, trigrams.index_name(name), made["postings"], keys)
        self.versions.append(state, trigrams.counts_name(name), made["counts"])

    def create_search_index(self) -> int:
        """Index the searched columns of all tables; from now on every load keeps the index up."""

        def change(state: dict) -> bool | None:
            if state["notes"].get("search index"):
                return False
            state["notes"]["search index"] = True
            for name in trigrams.SEARCHED:
                rows = self.versions.read(name, TABLES[name].schema, replaced_by(name), state)
                keys = self.versions.write_keys(rows.select(*replaced_by(name)), trigrams.index_name(name))
                self._add_index(state, name, keys, self._indexed(rows, name))

        self.versions.commit(change)
        for name in trigrams.SEARCHED:
            self.versions.merge(trigrams.index_name(name), trigrams.POSTINGS, ("key",), ("gram",))
        return self.versions.current()

    def may_match(self, name: str, query: str | None) -> DataFrame:
        """Rows among which are all that a search of a table for a pattern finds: the exact comparison is the search's.

        With an index, and a pattern that has three characters in a row, these come from the postings of a few trigrams: few rows are read from
        their buckets, many by a join with their keys. Else they are the whole table.
        """
        state, q, key = self.versions.state(), (query or "").strip(), TABLES[name].key[0]
        whole = self.versions.read(name, TABLES[name].schema, (key,), state)
        found = trigrams.candidates(self.versions, name, q, state) if q and state["notes"].get("search index") else None
        if found is None:
            return whole
        # the searches compare the key with the whole query too
        found = kept(found.unionByName(self.spark.createDataFrame([(q,)], "key string")).distinct(), "candidates")
        few = [r["key"] for r in found.limit(trigrams.FEW + 1).collect()]
        if len(few) > trigrams.FEW:
            return whole.join(found.withColumnRenamed("key", key), key, "left_semi")
        base = state["tables"].get(name, {}).get("base")
        at = found.select(F.pmod(F.xxhash64("key"), F.lit(base["buckets"])).alias("b")).distinct() if base else None
        buckets = [r["b"] for r in at.collect()] if base else None
        return self.versions.read(name, TABLES[name].schema, (key,), state, buckets=buckets).where(F.col(key).isin(few))

    def merge(self) -> None:
        """Merge the runs of all tables into their bases."""
        for name in TABLES:
            if key := replaced_by(name):
                self.versions.merge(name, TABLES[name].schema, key)
        for name in trigrams.SEARCHED:
            self.versions.merge(trigrams.index_name(name), trigrams.POSTINGS, ("key",), ("gram",))
            self.versions.pack(trigrams.counts_name(name), trigrams.COUNTS)

    def ingest_one(self, kind: str, key: str, html: str) -> int:
        """One page, without the log."""
        return self.ingest(self.spark.createDataFrame([(key, html)], "key string, html string"), kind, log=False)

    def ingest_all(self, companies: DataFrame, lobbyists: DataFrame) -> int:
        self.ingest(companies, "company")
        return self.ingest(lobbyists, "lobbyist")
