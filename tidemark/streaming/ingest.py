"""Continuous ingest and stateful queries on streams of samples."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.operators import samples
from tidemark.sources.store import TelemetryStore


def stream_folder(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Samples of Parquet files as they come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def ingest(stream: DataFrame, store: TelemetryStore, name: str, checkpoint: str, every: str | None = "500 milliseconds", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream's batches to a store. The batch number goes into the manifest with the files, so a
    batch that is run again after a failure is not added twice. every=None: what is there now, then end."""

    def add(batch: DataFrame, number: int) -> None:
        store.append(transform(batch) if transform else batch, stream=name, batch_id=number)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def running_latest(stream: DataFrame) -> DataFrame:
    """Newest timestamp of each source as running state: one row of state a source, partial maxima first."""
    return stream.groupBy("source_id").agg(F.max("ts").alias("latest_ts"))


def running_completeness(stream: DataFrame, generated: str, dropped: str, lateness: str = "10 seconds") -> DataFrame:
    """samples.completeness on a stream. Windows close when the watermark passes them; later samples of
    them are left out. Raw ingest has no watermark, so nothing is lost there."""
    return samples.completeness(stream.withWatermark("ts", lateness), generated, dropped)


def to_tables(stream: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def shed(df: DataFrame, keep: float, key: str = "seq") -> DataFrame:
    """Load shedding asked for: keep about that share of samples, chosen by a hash of key, so that a batch
    run again keeps the same ones."""
    limit = int(keep * (1 << 20))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < limit)


def replay(spark: SparkSession, table: DataFrame, rows_per_second: int) -> DataFrame:
    """The samples of a table as an endless stream at a rate, in order of time, from the start again after
    the end; times are the stream's."""
    numbered = table.sort("ts", "seq").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    names = [f"_{c}" if c == "position" else c for c in table.columns]
    indexed = spark.createDataFrame(numbered, "position bigint, " + ", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, table.dtypes)))
    n = max(1, table.count())
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.withColumn("position", F.pmod("value", F.lit(n))).join(indexed.drop("ts"), "position").withColumnRenamed("timestamp", "ts").drop("position")


class Progress(StreamingQueryListener):
    """Counters of all streaming queries: batches, rows, rows per second of the last batch, and its lag."""

    def __init__(self):
        self.batches = self.rows = 0
        self.rate = 0.0
        self.batch_ms: list[int] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows or 0
        self.rate = p.processedRowsPerSecond or 0.0
        self.batch_ms.append(p.batchDuration)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def summary(self) -> dict:
        n = max(1, self.batches)
        return {"batches": self.batches, "rows": self.rows, "mean_batch_rows": self.rows / n, "mean_batch_ms": sum(self.batch_ms) / n, "rows_per_second": self.rate}


def concurrently(queries: list[Callable[[], object]], threads: int = 8) -> list:
    """Results of queries run at the same time on one session, in order."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda q: q(), queries))
