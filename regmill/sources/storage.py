"""Folders and versions in any store that Spark reaches."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes that a bucket of a base has, about; runs that a table may have before they are folded; tries to publish a change.
BUCKET_BYTES, RUNS, ATTEMPTS = 128 << 20, 16, 8


def path_of(spark: SparkSession, where: str):
    """The store's file system, and the path in it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = path_of(spark, where)
    return fs.exists(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, local mode makes one of its own; a cluster raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="regmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    where = f"{shared_dir(spark)}/regmill-{uuid.uuid4().hex[:12]}-{name}"
    fs, path = path_of(spark, where)
    fs.deleteOnExit(path)
    return where


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder: what is made from it reads it from there."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


class Conflict(RuntimeError):
    """Another load published the version that this one was to become."""


class Tables:
    """Tables that are replaced by key and merged on read.

    A table is a base, in buckets of its keys' hashes, and runs on top of it. A load adds one run: new rows, and the keys whose
    earlier rows they take the place of; a key without rows is deleted. Reading keeps each key's rows of the last run that names it, and the
    base's rows of all other keys. So a load writes in proportion to itself, and loads of different keys do not disturb
    each other. `tend` folds runs when there are many, and merges them into a new base when they have become large beside it; a
    base has as many buckets as its bytes ask for.

    A version is a file that lists all of this. It gets the next number as its name when it is whole, or not at all if another load
    has that number; a change that comes too late is made again on the newer version. Folders have names of their own, so a
    load that breaks off leaves nothing that a later one would stumble over; `sweep` removes such folders.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.bucket_bytes = spark, root.rstrip("/"), bucket_bytes

    # -- versions

    def _numbers(self) -> list[int]:
        fs, path = path_of(self.spark, f"{self.root}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> int:
        """The newest published version, 0 for none."""
        return max(self._numbers(), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version lists, the newest if none is named."""
        version = self.current() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "appended": {}, "notes": {}}
        fs, path = path_of(self.spark, f"{self.root}/_versions/{version}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def publish(self, state: dict) -> int:
        """Make the state the next version; raises Conflict if another load was first."""
        version, context = state["version"] + 1, self.spark.sparkContext
        fs, made = path_of(self.spark, f"{self.root}/_versions/.{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(json.dumps({k: v for k, v in state.items() if k != "version"}).encode())
        stream.close()
        hadoop = context._jvm.org.apache.hadoop.fs
        names = hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
        never_over = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            names.rename(made, hadoop.Path(f"{self.root}/_versions/{version}"), never_over)
        except Exception as e:
            fs.delete(made, False)
            raise Conflict(f"version {version} is there already") from e
        return version

    def commit(self, change: Callable[[dict], bool | None]) -> int:
        """Publish the newest version with a change made to it, again on a newer one if another load was first. A change that
        returns False is none."""
        for left in reversed(range(ATTEMPTS)):
            state = self.state()
            if change(state) is False:
                return state["version"]
            try:
                return self.publish(state)
            except Conflict:
                if not left:
                    raise

    # -- writing

    def write(self, df: DataFrame, name: str) -> dict:
        """A new folder with the rows of df, and its bytes; no version lists it yet."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self._measured(folder)

    def _measured(self, folder: str) -> dict:
        fs, path = path_of(self.spark, f"{self.root}/{folder}")
        return {"folder": folder, "bytes": fs.getContentSummary(path).getLength()}

    def write_keys(self, keys: DataFrame, name: str) -> dict:
        """A new folder with keys, whatever their columns are called."""
        return self.write(keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys.columns)]).distinct(), f"{name}-keys")

    @staticmethod
    def add(state: dict, name: str, rows: dict | None, keys: dict) -> None:
        """Put a run on top of a table: rows (None to delete the keys only) and the keys that they replace."""
        state["tables"].setdefault(name, {"base": None, "runs": []})["runs"].append({"rows": rows, "keys": keys})

    @staticmethod
    def append(state: dict, name: str, rows: dict) -> None:
        """Put rows behind those of a table without a key."""
        state["appended"].setdefault(name, []).append(rows)

    # -- reading

    def _read(self, schema, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def rows_in(self, made: dict, schema: StructType) -> DataFrame:
        """The rows of a folder that was written, whether a version lists it or not."""
        return self._read(schema, [made["folder"]])

    def _runs(self, runs: list[dict], part: str, schema) -> DataFrame | None:
        """The rows or keys of runs with the run's number under _run."""
        parts = [self._read(schema, [r[part]["folder"]]).withColumn("_run", F.lit(i)) for i, r in enumerate(runs) if r[part]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _last(self, runs: list[dict], schema: StructType, key: tuple[str, ...]) -> DataFrame:
        """The keys of runs, under their names in the table, with the number of the last run of each."""
        named = StructType([StructField(f"_k{i}", schema[c].dataType) for i, c in enumerate(key)])
        keys = self._runs(runs, "keys", named)
        return keys.groupBy(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)]).agg(F.max("_run").alias("_run"))

    def _newest(self, runs: list[dict], schema: StructType, key: tuple[str, ...]) -> DataFrame | None:
        """The newest rows of each key in runs. The last run's are, as it names the keys of all its rows; those of earlier ones are joined with the keys."""
        last = self._runs(runs[-1:], "rows", schema)
        parts = [last.dropna(subset=list(key))] if last is not None else []
        if (rows := self._runs(runs[:-1], "rows", schema)) is not None:
            parts.append(rows.join(self._last(runs, schema, key), [*key, "_run"]))
        return reduce(DataFrame.unionByName, [p.select(*schema.names) for p in parts]) if parts else None

    def read(self, name: str, schema: StructType, key: tuple[str, ...] = (), state: dict | None = None, values: tuple | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, the newest if none is given; with `values` the rows of that key only, from its bucket and the runs;
        with `buckets` those of the base and the runs."""
        state = self.state() if state is None else state
        if not key:
            folders = [x["folder"] for x in state["appended"].get(name, [])]
            return self._read(schema, folders) if folders else self.spark.createDataFrame([], schema)
        held = state["tables"].get(name, {"base": None, "runs": []})
        parts = []
        if held["base"]:
            folder = held["base"]["folder"]
            if values is not None:
                buckets = [self._bucket_of(values, held["base"]["buckets"])]
            folders = [folder] if buckets is None else [f"{folder}/_bucket={b}" for b in buckets]
            folders = [f for f in folders if exists(self.spark, f"{self.root}/{f}")]
            if folders:
                base = self._read(schema, folders)
                parts.append(base.join(self._last(held["runs"], schema, key), list(key), "left_anti") if held["runs"] else base)
        newest = self._newest(held["runs"], schema, key) if held["runs"] else None
        parts = [p.select(*schema.names) for p in (*parts, newest) if p is not None]
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        for c, v in zip(key, values or (), strict=False):
            found = found.where(F.col(c) == v)
        return found

    def _bucket_of(self, values: tuple, buckets: int) -> int:
        return self.spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(v) for v in values]), F.lit(buckets))).first()[0]

    # -- keeping in shape

    def merge(self, name: str, schema: StructType, key: tuple[str, ...], by: tuple[str, ...] = ()) -> int:
        """Make all rows of a table its base, in buckets of about bucket_bytes; runs that are added meanwhile stay on top. The
        buckets are those of the key's hashes, or of other columns' (`by`)."""
        held = self.state()["tables"].get(name)
        if not held or not held["runs"]:
            return self.current()
        size = sum(x["bytes"] for x in (held["base"], *[r["rows"] for r in held["runs"]]) if x)
        buckets = 1 << max(0, (size // self.bucket_bytes).bit_length())
        rows = self.read(name, schema, key, {"tables": {name: held}}).withColumn("_bucket", F.pmod(F.xxhash64(*(by or key)), F.lit(buckets)))
        folder = f"data/{name}/{uuid.uuid4().hex}"
        # the planner splits a bucket that is much larger than others
        rows.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *by, *key).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        base, done = self._measured(folder) | {"buckets": buckets}, len(held["runs"])

        def change(state: dict) -> bool | None:
            now = state["tables"][name]
            if now["base"] != held["base"] or now["runs"][:done] != held["runs"]:
                return False  # another merge was first
            state["tables"][name] = {"base": base, "runs": now["runs"][done:]}

        return self.commit(change)

    def fold(self, name: str, schema: StructType, key: tuple[str, ...]) -> int:
        """Make all runs of a table one."""
        runs = self.state()["tables"].get(name, {"runs": []})["runs"]
        if len(runs) < 2:
            return self.current()
        newest = self._newest(runs, schema, key)
        folded = {"rows": newest if newest is None else self.write(newest, name), "keys": self.write_keys(self._last(runs, schema, key).select(*key), name)}

        def change(state: dict) -> bool | None:
            now = state["tables"][name]
            if now["runs"][: len(runs)] != runs:
                return False
            now["runs"] = [folded, *now["runs"][len(runs) :]]

        return self.commit(change)

    def pack(self, name: str, schema: StructType) -> int:
        """Put the small folders of an appended table into one."""
        small = [x for x in self.state()["appended"].get(name, []) if 4 * x["bytes"] < self.bucket_bytes]
        if len(small) < 2:
            return self.current()
        packed = self.write(self._read(schema, [x["folder"] for x in small]).hint("rebalance"), name)

        def change(state: dict) -> bool | None:
            now = state["appended"].get(name, [])
            if any(x not in now for x in small):
                return False
            state["appended"][name] = [packed, *[x for x in now if x not in small]]

        return self.commit(change)

    def tend(self, name: str, schema: StructType, key: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> None:
        """Fold, merge or pack a table that has more than RUNS runs, or small folders."""
        state = self.state()
        if not key:
            if sum(4 * x["bytes"] < self.bucket_bytes for x in state["appended"].get(name, [])) > RUNS:
                self.pack(name, schema)
            return
        held = state["tables"].get(name, {"base": None, "runs": []})
        if len(held["runs"]) > RUNS:
            on_top, below = sum(r["rows"]["bytes"] for r in held["runs"] if r["rows"]), held["base"]["bytes"] if held["base"] else 0
            if 2 * on_top >= below:
                self.merge(name, schema, key, by)
            else:
                self.fold(name, schema, key)

    def sweep(self, keep: int = 2, grace: float = 86_400.0) -> list[str]:
        """Remove the versions before the last `keep`, and the folders that none of those list and that are `grace` seconds old.

        The grace covers loads that have written but not published, and readers of the versions that go. One name for each folder is
        what the driver sees.
        """
        numbers = self._numbers()
        kept_, listed = numbers[-keep:], set()
        for n in kept_:
            state = self.state(n)
            runs = [r for t in state["tables"].values() for r in ({"rows": t["base"], "keys": None}, *t["runs"])]
            listed |= {x["folder"] for r in runs for x in (r["rows"], r["keys"]) if x} | {x["folder"] for xs in state["appended"].values() for x in xs}
        fs, data = path_of(self.spark, f"{self.root}/data")
        before, gone = (time.time() - grace) * 1000, []
        for table in fs.listStatus(data) if fs.exists(data) else []:
            for made in fs.listStatus(table.getPath()):
                folder = f"data/{table.getPath().getName()}/{made.getPath().getName()}"
                if folder not in listed and made.getModificationTime() <= before:
                    fs.delete(made.getPath(), True)
                    gone.append(folder)
        for n in numbers[:-keep]:
            fs.delete(path_of(self.spark, f"{self.root}/_versions/{n}")[1], False)
        return gone
