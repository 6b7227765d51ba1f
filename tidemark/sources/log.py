"""A partitioned, append-only log of byte messages: in folders, or in Kafka where its connector is installed.

Both forms have (partition, offset, value) rows and are read from given positions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest message, in bytes; longer values go in several.
MESSAGE = 1_500_000


def chunks(value: Column, size: int = MESSAGE) -> Column:
    """Bytes as an array of (chunk, part) of at most ``size`` bytes; an empty value has one empty part."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(value) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("chunk"), F.substring(value, k * size + 1, F.lit(size)).alias("part")))


class FolderLog:
    """A topic as Parquet: each append is a folder of its own, offsets go on where the last ended."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = 4, size: int = MESSAGE):
        self.spark, self.path, self.partitions, self.size = spark, path.rstrip("/"), partitions, size
        # message: the offset of a message's first chunk; its n_chunks chunks have the offsets from there on.
        self.schema = "topic_partition int, offset bigint, key bigint, message bigint, chunk int, n_chunks int, value binary"

    def _table(self) -> DataFrame | None:
        from tidemark.sources.store import Files

        return self.spark.read.schema(self.schema).parquet(self.path) if Files(self.spark).names(self.path) else None

    def ends(self) -> dict[int, int]:
        """Next offset of each partition."""
        table = self._table()
        found = {} if table is None else {r[0]: r[1] + 1 for r in table.groupBy("topic_partition").agg(F.max("offset")).collect()}
        return {p: found.get(p, 0) for p in range(self.partitions)}

    def append(self, df: DataFrame, key: str, value: str) -> dict[int, tuple[int, int]]:
        """Append values (binary) to the partition of their key; (first, next) offset by partition."""
        before = self.ends()
        base = F.element_at(F.create_map(*(F.lit(x) for p in before for x in (p, before[p]))), F.col("topic_partition"))
        whole = df.select(F.col(key).cast("bigint").alias("key"), F.pmod(F.col(key), F.lit(self.partitions)).cast("int").alias("topic_partition"), F.col(value).alias("value"))
        whole = whole.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("value") / self.size).cast("int")))
        # Rows that agree in key and value may change places: their chunks are the same.
        w = Window.partitionBy("topic_partition").orderBy("key", F.sha2("value", 256)).rowsBetween(Window.unboundedPreceding, 0)
        numbered = whole.withColumn("message", base + F.sum("n_chunks").over(w) - F.col("n_chunks"))
        rows = numbered.select("topic_partition", "key", "message", "n_chunks", F.inline(chunks(F.col("value"), self.size)))
        rows.select("topic_partition", (F.col("message") + F.col("chunk")).alias("offset"), "key", "message", "chunk", "n_chunks", F.col("part").alias("value")).write.mode("append").parquet(self.path)
        after = self.ends()
        return {p: (before[p], after[p]) for p in before if after[p] > before[p]}

    def read(self, positions: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        """Messages from (first, next) offsets by partition; default all."""
        table = self._table()
        if table is None:
            return self.spark.createDataFrame([], self.schema)
        if positions is None:
            return table
        wanted = F.lit(False)
        for p, (first, end) in positions.items():
            wanted = wanted | ((F.col("topic_partition") == p) & (F.col("offset") >= first) & (F.col("offset") < end))
        return table.where(wanted)

    def messages(self, positions: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        """(topic_partition, message, key, value): whole messages, from all their chunks, of which positions
        (default all) have at least one chunk. A message that lacks a chunk is an error."""
        found = self.read()
        if positions is not None:
            found = found.join(self.read(positions).select("topic_partition", "message").distinct(), ["topic_partition", "message"], "left_semi")
        parts = found.groupBy("topic_partition", "message").agg(F.first("key").alias("key"), F.first("n_chunks").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk", "value"))).alias("parts"))
        value = F.when(F.size("parts") == 1, F.col("parts")[0]["value"]).otherwise(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), "")))
        complete = F.transform("parts", lambda p: p["chunk"]) == F.sequence(F.lit(0), F.col("n_chunks") - 1)
        lost = F.raise_error(F.concat(F.lit("chunks lost of message "), F.col("message").cast("string"), F.lit(" of partition "), F.col("topic_partition").cast("string"))).cast("binary")
        return parts.select("topic_partition", "message", "key", F.when(complete, value).otherwise(lost).alias("value"))

    def stream(self, files_per_trigger: int | None = None) -> DataFrame:
        """Messages as they come."""
        reader = self.spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(self.path)


def has_kafka(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def kafka_options(servers: str, topic: str, positions: dict[int, tuple[int, int]] | None = None, acks_all: bool = True) -> dict[str, str]:
    """Options of Spark's Kafka source and sink; positions limit a batch read to those offsets."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "topic": topic, "kafka.acks": "all" if acks_all else "1", "kafka.max.request.size": str(2 * MESSAGE)}
    if positions is None:
        out["startingOffsets"] = "latest"
    else:
        out["startingOffsets"] = json.dumps({topic: {str(p): a for p, (a, _) in positions.items()}})
        out["endingOffsets"] = json.dumps({topic: {str(p): b for p, (_, b) in positions.items()}})
    return out


def kafka_read(spark: SparkSession, servers: str, topic: str, positions: dict[int, tuple[int, int]]) -> DataFrame:
    options = {k: v for k, v in kafka_options(servers, topic, positions).items() if k not in ("topic", "kafka.acks")}
    return spark.read.format("kafka").options(**options).load()


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int | None = None) -> DataFrame:
    options = {k: v for k, v in kafka_options(servers, topic).items() if k not in ("topic", "kafka.acks")}
    if offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(offsets_per_trigger)
    return spark.readStream.format("kafka").options(**options).load()


def kafka_write(df: DataFrame, servers: str, topic: str, key: str, value: str, acks_all: bool = True) -> None:
    """Append values to a topic in messages of at most MESSAGE bytes."""
    rows = df.select(F.col(key).cast("string").cast("binary").alias("key"), F.inline(chunks(F.col(value)))).select("key", F.col("part").alias("value"))
    rows.write.format("kafka").options(**{k: v for k, v in kafka_options(servers, topic, acks_all=acks_all).items() if k != "subscribe" and "Offsets" not in k}).save()


def load(spark: SparkSession, megabytes_per_second: int, message: int = MESSAGE, partitions: int = 4) -> DataFrame:
    """A stream of constant messages at a rate, dealt to partitions at random."""
    rate = max(1, megabytes_per_second * 1_000_000 // message)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return ticks.select(F.floor(F.rand(1) * partitions).cast("int").alias("topic_partition"), F.repeat(F.lit("a"), F.lit(message)).cast("binary").alias("value"))
