"""A source-keyed, time-ordered store of samples in Parquet, with versioned manifests.

Files are laid out by a hash bucket of the source and sorted by source and time inside; ranges of (bucket,
source, time) are dealt to tasks, so a source of any size is split by time. After a write the true range of
time and sources of each file goes into a zone table. A manifest is a small JSON file that names the zone
tables of a version; creating it exclusively is the commit, and a version never changes afterwards. A reader
filters the zone tables and scans only the files that a range can touch; Parquet statistics do the rest.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import backoff
from tidemark.operators import samples
from tidemark.session import whole_timestamps

#: Delta-encoded integers and timestamps, and the fastest block codec.
WRITE_OPTIONS = {"compression": "lz4_raw", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}


class Conflict(Exception):
    """Another writer committed the version first."""


class Files:
    """The few operations on paths that the manifests need, on whatever file system Spark uses."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file, whole or not at all; Conflict if there is one. The local file system's own
        exclusive creation looks first and writes later, so there a hard link to a finished file does it."""
        fs, p = self._at(path)
        if fs.getUri().getScheme() == "file":
            target = p.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
            with open(part, "w") as f:
                f.write(text)
            try:
                os.link(part, target)
            except FileExistsError:
                raise Conflict(path) from None
            finally:
                os.unlink(part)
            return
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(path) from None
            raise
        out.write(bytearray(text.encode()))
        out.close()


class Snapshot:
    """A version of the store. It reads the same whatever is committed later, in this process or another."""

    def __init__(self, store: TelemetryStore, manifest: dict):
        self.store, self.manifest = store, manifest
        self.version = manifest["version"]

    def zones(self) -> DataFrame:
        """(file, bucket, min_source, max_source, min_ts, max_ts, n_samples) of each file."""
        return self.store._zones(self.manifest)

    def files(self, source: int | None = None, t_from: Column | None = None, t_to: Column | None = None) -> list[str]:
        """Files that can hold samples of a source and range, newest first."""
        zones = self.zones()
        if source is not None:
            zones = zones.where((F.col("bucket") == self.store.bucket(F.lit(source))) & (F.col("min_source") <= source) & (F.col("max_source") >= source))
        if t_from is not None:
            zones = zones.where(F.col("max_ts") >= t_from)
        if t_to is not None:
            zones = zones.where(F.col("min_ts") <= t_to)
        return [r["file"] for r in zones.orderBy(F.desc("max_ts"), F.desc("min_ts"), "file").select("file").collect()]

    def _read(self, files: list[str]) -> DataFrame:
        schema = self.store.schema_of(self.manifest)
        reader = self.store.spark.read.schema(schema)
        return reader.parquet(*files) if files else self.store.spark.createDataFrame([], schema)

    def all(self) -> DataFrame:
        return self._read(self.files())

    def source(self, source: int) -> DataFrame:
        return samples.of_source(self._read(self.files(source)), source)

    def range_scan(self, source: int, t_from: Column, t_to: Column, closed: str = "left", newest_first: bool = False) -> DataFrame:
        return samples.range_scan(self._read(self.files(source, t_from, t_to)), source, t_from, t_to, closed, newest_first)

    def newest(self, source: int, k: int) -> DataFrame:
        return samples.newest(self.source(source), k)

    def latest_ts(self, source: int | None = None):
        """Newest timestamp of a source or of all, None if there is no sample. For all, zones suffice."""
        if source is None:
            return self.zones().agg(F.max("max_ts")).first()[0]
        return samples.latest_ts(self.source(source)).first()[0]


@dataclass
class Answer:
    """What a range query took: waiting for data, reading them, both, and the rows found."""

    source: int
    rows: int
    data_latency_s: float
    execution_latency_s: float

    @property
    def total_latency_s(self) -> float:
        return self.data_latency_s + self.execution_latency_s


class TelemetryStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, rows_per_file: int = 4_000_000):
        self.spark, self.path, self.buckets, self.rows_per_file = spark, path.rstrip("/"), buckets, rows_per_file
        self.fs = Files(spark)
        whole_timestamps(spark)
        self._cached: tuple[float, Snapshot] | None = None

    def bucket(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(source.cast("bigint")), F.lit(self.buckets)).cast("int")

    # manifests

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.fs.names(f"{self.path}/manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest; default the latest. Version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "parent": None, "zones": [], "batches": {}, "schema": None}
        for wait, _ in zip(backoff(0.05), range(8)):  # a manifest may be in the middle of being written
            try:
                return json.loads(self.fs.read(f"{self.path}/manifests/v{version:010d}.json"))
            except json.JSONDecodeError:
                time.sleep(wait)
        raise ValueError(f"manifest {version} cannot be read")

    def history(self, version: int | None = None) -> list[int]:
        """A version and its parents, newest first."""
        out, m = [], self.manifest(version)
        while m["version"]:
            out.append(m["version"])
            m = self.manifest(m["parent"])
        return out

    def schema_of(self, manifest: dict) -> T.StructType:
        if not manifest["schema"]:
            return T.StructType([T.StructField("source_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType())])
        return T.StructType.fromJson(manifest["schema"])

    def _zones(self, manifest: dict) -> DataFrame:
        ts = self.schema_of(manifest)["ts"].dataType.simpleString()
        schema = f"file string, bucket int, min_source bigint, max_source bigint, min_ts {ts}, max_ts {ts}, n_samples bigint"
        return self.spark.read.schema(schema).parquet(*manifest["zones"]) if manifest["zones"] else self.spark.createDataFrame([], schema)

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Apply a change to the latest manifest, again if another writer was first. None changes nothing."""
        for wait, _ in zip(backoff(0.02, 1.0), range(200)):
            latest = self.manifest()
            new = change(latest)
            if new is None:
                return latest["version"]
            new |= {"version": latest["version"] + 1, "parent": latest["version"] or 0}
            try:
                self.fs.create(f"{self.path}/manifests/v{new['version']:010d}.json", json.dumps(new))
                return new["version"]
            except Conflict:
                time.sleep(wait)
        raise Conflict("too many writers")

    # writing

    def _write(self, df: DataFrame) -> str:
        """Data files and their zone table; the path of the latter."""
        name = uuid.uuid4().hex
        data = f"{self.path}/data/{name}"
        keys = ["bucket", "source_id", "ts", "seq"]
        laid = df.withColumn("bucket", self.bucket(F.col("source_id"))).repartitionByRange(*keys).sortWithinPartitions(*keys)
        laid.write.options(**WRITE_OPTIONS).option("maxRecordsPerFile", self.rows_per_file).partitionBy("bucket").parquet(data)
        written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(data)
        zones = written.groupBy(F.col("_metadata.file_path").alias("file"), "bucket").agg(
            F.min("source_id").alias("min_source"), F.max("source_id").alias("max_source"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n_samples"),
        )
        zones.coalesce(1 + self.buckets // 64).write.parquet(f"{self.path}/zones/{name}")
        return f"{self.path}/zones/{name}"

    def append(self, df: DataFrame, stream: str | None = None, batch_id: int | None = None) -> int:
        """Add samples (source_id, ts, seq, values) and return the version that has them. With a stream's
        name and batch number a batch that was committed before is not added again."""
        missing = {"source_id", "ts", "seq"} - set(df.columns)
        if missing:
            raise ValueError(f"samples lack {sorted(missing)}")
        fields = [f for f in df.schema.fields if f.name in ("source_id", "ts", "seq")] + [f for f in df.schema.fields if f.name not in ("source_id", "ts", "seq")]
        df = df.select(*(f.name for f in fields))
        schema = json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in fields]).json())
        done = lambda m: stream is not None and m["batches"].get(stream, -1) >= batch_id
        latest = self.manifest()
        if done(latest):
            return latest["version"]
        if latest["schema"] and latest["schema"] != schema:
            raise ValueError("samples do not have the store's columns")
        zones = self._write(df)

        def change(m: dict) -> dict | None:
            if done(m):
                return None
            batches = m["batches"] | ({stream: batch_id} if stream is not None else {})
            return {"zones": [*m["zones"], zones], "batches": batches, "schema": schema}

        return self._commit(change)

    def compact(self) -> int:
        """Rewrite the latest version's files into few large ones, as a new version. Older versions and
        snapshots of them keep reading theirs."""
        old = self.manifest()
        if not old["zones"]:
            return old["version"]
        zones = self._write(Snapshot(self, old).all())

        def change(m: dict) -> dict:
            later = [z for z in m["zones"] if z not in old["zones"]]
            return {"zones": [zones, *later], "batches": m["batches"], "schema": m["schema"]}

        return self._commit(change)

    # sources

    def register(self, sources: DataFrame) -> None:
        """Add (source_id, kinds array<string>) of sources that are not known yet."""
        new = sources.select(F.col("source_id").cast("bigint"), "kinds").dropDuplicates(["source_id"])
        known = self.sources()
        new.join(known, "source_id", "left_anti").write.mode("append").parquet(f"{self.path}/sources")

    def sources(self) -> DataFrame:
        schema = "source_id bigint, kinds array<string>"
        return self.spark.read.schema(schema).parquet(f"{self.path}/sources") if self.fs.names(f"{self.path}/sources") else self.spark.createDataFrame([], schema)

    # reading

    def read(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    def snapshot(self, max_staleness_s: float = 0.5, clock: Callable[[], float] = time.monotonic) -> Snapshot:
        """The latest version, looked up again only when the last look is older than max_staleness_s."""
        now = clock()
        if self._cached is None or now - self._cached[0] >= max_staleness_s:
            self._cached = (now, self.read())
        return self._cached[1]

    def wait_until_fresh(self, ts, source: int | None = None, timeout_s: float = 60.0, poll_s: float = 0.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Snapshot:
        """A snapshot whose newest sample (of the source) is later than ts; TimeoutError if none comes."""
        end = clock() + timeout_s
        seen = None
        while True:
            version = max(self.versions(), default=0)
            if version != seen:  # nothing new can have come without a version
                found = self.read(version)
                seen, latest = version, found.latest_ts(source)
                if latest is not None and latest > ts:
                    return found
            if clock() >= end:
                raise TimeoutError(f"no sample after {ts}")
            sleep(poll_s)

    def ask(self, source: int, t_from: Column, t_to: Column, fresh_after, timeout_s: float = 60.0, poll_s: float = 0.5) -> Answer:
        """Count a source's samples in a range once data later than fresh_after are there."""
        began = time.monotonic()
        snapshot = self.wait_until_fresh(fresh_after, source, timeout_s, poll_s)
        ready = time.monotonic()
        rows = snapshot.range_scan(source, t_from, t_to).count()
        return Answer(source, rows, ready - began, time.monotonic() - ready)
