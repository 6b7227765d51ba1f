"""Readers of telemetry texts: tagged JSON lines, OTLP-style metrics and logs, Jaeger-style spans.

All are scans of text with JSON parsed in the JVM; a directory is read by as many tasks as it has splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar

#: Tags of a typed value and what they hold.
TAGS = {"String": "string", "Int": "bigint", "Uint": "decimal(20,0)", "Float": "double", "Bool": "boolean"}

ATTRIBUTE = "STRUCT<key: STRING, value: STRUCT<stringValue: STRING>>"
POINT = f"STRUCT<attributes: ARRAY<{ATTRIBUTE}>, timeUnixNano: STRING, asDouble: DOUBLE, quantileValues: ARRAY<STRUCT<quantile: DOUBLE, value: DOUBLE>>>"
_POINTS = f"STRUCT<dataPoints: ARRAY<{POINT}>>"
METRICS = f"resourceMetrics ARRAY<STRUCT<resource: STRUCT<attributes: ARRAY<{ATTRIBUTE}>>, scopeMetrics: ARRAY<STRUCT<metrics: ARRAY<STRUCT<name: STRING, gauge: {_POINTS}, sum: {_POINTS}, summary: {_POINTS}>>>>>>"
_TAG = "STRUCT<key: STRING, vStr: STRING, vInt64: STRING, vFloat64: DOUBLE, vBool: BOOLEAN>"
SPAN = f"operationName STRING, startTime STRING, tags ARRAY<{_TAG}>, process STRUCT<serviceName: STRING, tags: ARRAY<{_TAG}>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a file or folder, in column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def _once(raw: DataFrame, parsed: Column) -> DataFrame:
    """(j) parsed. Exploding an array of one keeps the optimiser from parsing anew for each filter on j."""
    return raw.select(F.explode(F.array(parsed)).alias("j"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row: a column that then names twice would be computed twice."""
    return F.get(F.transform(F.array(value), then), 0)


# tagged JSON lines


def tagged_value(v: Column) -> Column:
    """Typed sample of a tagged value: a struct of which one field is set (f64, i64, u64, bytes)."""
    return F.struct(
        scalar.as_f64(v, False).alias("f64"), scalar.as_i64(v, False).alias("i64"), scalar.as_u64(v, False).alias("u64"), scalar.as_bytes(v, False).alias("bytes"),
    )


def json_points(raw: DataFrame, line: str = "line") -> DataFrame:
    """(source_id, ts, otel_type, attributes, values) of JSON lines; points with a Null value, and lines
    that are no such point, are left out. The source is a hash of the attributes in any order."""
    parsed = _once(raw, F.try_parse_json(F.col(line)))
    fields = parsed.select(
        F.try_variant_get("j", "$.otel_type", "string").alias("otel_type"), F.try_variant_get("j", "$.attributes", "map<string,variant>").alias("attributes"),
        F.try_variant_get("j", "$.timestamp", "bigint").alias("us"), F.try_variant_get("j", "$.values", "array<variant>").alias("values"),
    ).where("us is not null and values is not null and attributes is not null")
    is_null = lambda v: v.isNull() | F.is_variant_null(v) | (F.to_json(v) == '"Null"')
    kept = fields.where(~F.exists("values", is_null))
    return kept.select(scalar.variant_hash("attributes").alias("source_id"), scalar.from_micros("us").alias("ts"), "otel_type", "attributes", F.transform("values", tagged_value).alias("values"))


def tags_of(values: Column) -> Column:
    """Kind of each typed value: f64, i64, u64 or bytes."""
    return F.transform(values, lambda v: F.when(v["f64"].isNotNull(), "f64").when(v["i64"].isNotNull(), "i64").when(v["u64"].isNotNull(), "u64").otherwise("bytes"))


def typed_sizes(values: Column) -> Column:
    """Bytes of all values of a point, and 16."""
    size = lambda v: F.coalesce(F.octet_length(v["bytes"]).cast("bigint"), F.lit(8).cast("bigint"))
    return F.aggregate(F.transform(values, size), F.lit(16).cast("bigint"), lambda a, x: a + x)


def is_metric(values: Column) -> Column:
    """The first value is a number."""
    return F.coalesce(F.get(values, 0)["bytes"].isNull(), F.lit(False))


def source_kinds(points: DataFrame) -> DataFrame:
    """(source_id, kinds) by the first point of each source."""
    first = points.groupBy("source_id").agg(F.min_by("values", "ts").alias("v"))
    return first.select("source_id", tags_of(F.col("v")).alias("kinds"))


# attribute lists, sorted by sort_array: array_sort calls a comparator for each two elements


def text_attributes(attributes: Column) -> Column:
    """Sorted (key, value) of OTLP attributes with a text value."""
    texts = F.filter(attributes, lambda a: a["value"]["stringValue"].isNotNull())
    return F.sort_array(F.transform(texts, lambda a: F.struct(a["key"].alias("key"), a["value"]["stringValue"].alias("value"))))


def typed_tags(tags: Column) -> Column:
    """Sorted (key, value as text) of typed tags."""
    value = lambda t: F.coalesce(t["vInt64"], t["vStr"], t["vFloat64"].cast("string"), t["vBool"].cast("string"))
    return F.sort_array(F.transform(tags, lambda t: F.struct(t["key"].alias("key"), value(t).alias("value"))))


def with_attribute(attributes: Column, key: str, value: Column) -> Column:
    return F.sort_array(F.concat(attributes, F.array(F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))))


def without_attribute(attributes: Column, key: str) -> Column:
    return F.filter(attributes, lambda a: a["key"] != key)


def attribute(attributes: Column, key: str) -> Column:
    """Value of the first attribute of a key, else null."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), 0)["value"]


def _json_hash(*parts: Column) -> Column:
    return F.xxhash64(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts)))))


# OTLP-style metrics


def otlp_metrics(raw: DataFrame, line: str = "line", dropped_key: str = "experiment_id") -> DataFrame:
    """(source_id, ts, ts_ns, name, value): one row a metric of gauges, sums and summaries.

    value maps each data point's attributes (hashed, without dropped_key, which must be there) to its number,
    a repeated one to its last; a summary, which must have one point, has a field for each quantile. All
    points of a metric must have one time; breaking a rule fails the query.
    """
    parsed = _once(raw, F.from_json(line, METRICS))
    resources = parsed.select(F.explode("j.resourceMetrics").alias("r"))
    scopes = resources.select(text_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeMetrics").alias("s"))
    metrics = scopes.select("resource", F.explode("s.metrics").alias("m"))
    numbers = F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints")
    found = metrics.select("resource", F.col("m.name").alias("name"), numbers.alias("numbers"), F.col("m.summary.dataPoints").alias("summary"))
    found = found.withColumn("points", F.coalesce("numbers", "summary")).where(F.size("points") > 0)
    time = F.get("points", 0)["timeUnixNano"]
    one_time = F.forall("points", lambda p: p["timeUnixNano"].eqNullSafe(time))
    bare = lambda p: text_attributes(without_attribute(p["attributes"], dropped_key))
    entry = lambda p: F.struct(_json_hash(bare(p)).alias("key"), p["asDouble"].alias("value"))
    field = lambda b, q: F.struct(_json_hash(with_attribute(b, "quantile", scalar.quantile_key(q["quantile"]))).alias("key"), q["value"].alias("value"))
    quantile = lambda p: _let(bare(p), lambda b: F.transform(p["quantileValues"], lambda q: field(b, q)))
    entries = F.when(F.col("numbers").isNotNull(), F.transform("numbers", entry)).otherwise(F.flatten(F.transform("summary", quantile)))
    named = F.forall("points", lambda p: F.exists(p["attributes"], lambda a: a["key"] == dropped_key))
    checked = found.where(
        F.assert_true(one_time, "the points of a metric have several times").isNull()
        & F.assert_true(named, f"a data point has no {dropped_key}").isNull()
        & F.assert_true(F.col("numbers").isNotNull() | (F.size("summary") == 1), "a summary has several points").isNull()
    )
    ns = scalar.nanos(time)
    return checked.select(_json_hash(F.col("resource"), F.col("name")).alias("source_id"), scalar.nanos_to_timestamp(ns).alias("ts"), ns.alias("ts_ns"), "name", last_wins(entries).alias("value"))


def last_wins(entries: Column) -> Column:
    """Map of an array of (key, value); of equal keys the last entry counts. Sorted by key and place, an entry
    counts if the next one has another key."""
    placed = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["value"].alias("value"))))
    last = lambda own, after: after.isNull() | (own["key"] != after["key"])
    kept = _let(placed, lambda all_: F.filter(all_, lambda e, i: last(e, F.get(all_, i + 1))))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


# OTLP-style logs and Jaeger-style spans


def otlp_logs(raw: DataFrame, line: str = "line", key: str = "log.file.path") -> DataFrame:
    """(source_id, ts, ts_ns, body): one row a record, its JSON as bytes; the source is a hash of the
    attribute ``key``, and a record without it fails the query."""
    shape = "resourceLogs ARRAY<STRUCT<scopeLogs: ARRAY<STRUCT<logRecords: ARRAY<VARIANT>>>>>"
    records = raw.select(F.from_json(line, shape).alias("j")).select(F.explode("j.resourceLogs").alias("r")).select(F.explode("r.scopeLogs").alias("s")).select(F.explode("s.logRecords").alias("v"))
    attributes = F.variant_get("v", "$.attributes", "array<struct<key:string,value:struct<stringValue:string>>>")
    path = attribute(text_attributes(attributes), key)
    ns = scalar.nanos(F.variant_get("v", "$.timeUnixNano", "string"))
    out = records.select(path.alias("path"), ns.alias("ts_ns"), F.encode(F.to_json("v"), "UTF-8").alias("body"))
    out = out.where(F.assert_true(F.col("path").isNotNull(), f"a log record has no {key}").isNull())
    return out.select(F.xxhash64("path").alias("source_id"), scalar.nanos_to_timestamp("ts_ns").alias("ts"), "ts_ns", "body")


def jaeger_spans(raw: DataFrame, line: str = "line") -> DataFrame:
    """(source_id, ts, body): one row a span, its JSON as bytes. The source is a hash of operation, span
    kind, experiment, service and the process's sorted tags; the two tags must be there."""
    parsed = raw.select(F.col(line).alias("text"), F.from_json(line, SPAN).alias("j"))
    tags = typed_tags(F.col("j.tags"))
    kind, experiment = attribute(tags, "span.kind"), attribute(tags, "experiment_id")
    checked = parsed.where(F.assert_true(kind.isNotNull() & experiment.isNotNull(), "a span has no span.kind or experiment_id").isNull())
    source = _json_hash(F.col("j.operationName"), kind, experiment, F.col("j.process.serviceName"), typed_tags(F.col("j.process.tags")))
    return checked.select(source.alias("source_id"), F.timestamp_millis(scalar.rfc3339_millis("j.startTime")).alias("ts"), F.encode("text", "UTF-8").alias("body"))


# saved source maps


def read_source_map(spark: SparkSession, path: str) -> DataFrame:
    """A saved table of samples with unsigned ids and times: (source_id, ts_us, values)."""
    return spark.read.parquet(path)


def write_sorted(df: DataFrame, path: str) -> None:
    """All samples in order of time over the whole table, as Parquet: range-partitioned, so each task
    sorts a range of its own."""
    df.sort("ts").write.mode("errorifexists").parquet(path)


def to_document(df: DataFrame, *values: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON documents {series_id, timestamp, data} of samples, after the columns to keep."""
    document = F.to_json(F.struct(F.col("source_id").cast("string").alias("series_id"), scalar.micros("ts").alias("timestamp"), F.array(*(F.col(v).cast("string") for v in values)).alias("data")))
    return df.select(*keep, document.alias("document"))
