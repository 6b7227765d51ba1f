"""The catalog: each query on the test tables, and DuckDB SQL of the same rows.

``events`` stands for samples: user_id is the source, event_id the order of arrival. "Now" is the newest
timestamp of the table, so that relative ranges do not move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import samples
from tidemark.session import scratch_path
from tidemark.sources import codecs, log, telemetry
from tidemark.sources.store import TelemetryStore
from tidemark.streaming import ingest

SOURCE = 5
_NOW = "(select max(ts) from events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples, with value, props and event_type."""
    return events(spark, sf_dir).select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), "event_type", "value", "props")


def _now(spark: SparkSession, sf_dir: str) -> Column:
    """The newest timestamp, from the statistics of the scan, as a literal."""
    latest = events(spark, sf_dir).agg(F.max("ts")).first()[0]
    return F.lit(latest.isoformat(sep=" ") if latest else None).cast("timestamp_ntz")


def _range(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    now = _now(spark, sf_dir)
    return now - F.expr("interval '13' day"), now - F.expr("interval '3' day")


_IN_RANGE = f"user_id = {SOURCE} and ts {{}} {_NOW} - interval '3' day and ts >= {_NOW} - interval '13' day"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


# scans


@query(f"select user_id as source_id, ts, value, props from events where {_IN_RANGE.format('<')}")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.range_scan(event_samples(spark, sf_dir), SOURCE, *_range(spark, sf_dir)).select("source_id", "ts", "value", "props")


@query(f"select user_id as source_id, ts, value, props from events where {_IN_RANGE.format('<=')}")
def range_scan_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.range_scan(event_samples(spark, sf_dir), SOURCE, *_range(spark, sf_dir), closed="both").select("source_id", "ts", "value", "props")


@query(f"select user_id as source_id, ts, event_id as seq, value from events where {_IN_RANGE.format('<')} order by ts desc, event_id desc")
def range_scan_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.range_scan(event_samples(spark, sf_dir), SOURCE, *_range(spark, sf_dir), newest_first=True).select("source_id", "ts", "seq", "value")


@query(f"select user_id as source_id, ts, event_id as seq, value from events where user_id = {SOURCE} order by ts desc, event_id desc limit 10")
def newest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.newest(samples.of_source(event_samples(spark, sf_dir), SOURCE), 10).select("source_id", "ts", "seq", "value")


@query("select user_id as source_id, ts, event_id as seq, value from events order by ts desc, event_id desc limit 100")
def newest_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.newest(event_samples(spark, sf_dir), 100).select("source_id", "ts", "seq", "value")


@query(f"select user_id as source_id, ts, event_id as seq, value as v from events where user_id = {SOURCE}")
def field_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.field(samples.of_source(event_samples(spark, sf_dir), SOURCE), "value", "v")


@query("select ts, event_id as seq, user_id as source_id, value from events order by ts, event_id")
def time_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.time_order(event_samples(spark, sf_dir)).select("ts", "seq", "source_id", "value")


# counts and newest times


@query(f"select count(*) as doc_count from events where {_IN_RANGE.format('<=')}")
def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.range_count(event_samples(spark, sf_dir), SOURCE, *_range(spark, sf_dir))


@query("select count(*) as doc_count from events")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).agg(F.count("*").alias("doc_count"))


@query(f"select max(ts) as latest_ts from events where user_id = {SOURCE}")
def latest_ts_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.latest_ts(event_samples(spark, sf_dir), SOURCE)


@query("select max(ts) as latest_ts from events")
def latest_ts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.latest_ts(event_samples(spark, sf_dir))


@query("select source_id, ts, seq, value from (select user_id as source_id, ts, event_id as seq, value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.latest_per_source(event_samples(spark, sf_dir), "value")


@query(f"select user_id as source_id, max(ts) as latest_ts, date_diff('microsecond', max(ts), {_NOW}) as age_us from events group by user_id")
def data_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.data_age(event_samples(spark, sf_dir), _now(spark, sf_dir))


@query("select user_id as source_id, count(*) as n_samples from events group by user_id")
def source_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.source_lengths(event_samples(spark, sf_dir))


@query("""
with l as (select user_id as source_id, count(*) as n_samples from events group by user_id),
     r as (select *, row_number() over (order by n_samples desc, source_id desc) as rk, count(*) over () as n from l)
select source_id, n_samples, rk from r where rk <= n // 10""")
def hot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.hot_sources(event_samples(spark, sf_dir))


@query("""
with l as (select user_id, count(*) as c from events group by user_id)
select count(*) as n_sources, min(c) as min_len, max(c) as max_len, cast(floor(sum(c) / count(*)) as bigint) as mean_len from l""")
def source_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.length_stats(event_samples(spark, sf_dir))


@query("select event_type, count(*) as n_samples, count(distinct user_id) as n_sources from events group by event_type")
def kind_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.kind_stats(event_samples(spark, sf_dir), "event_type")


@query("select event_type, count(*) as n_samples, count(distinct user_id) as n_sources from events group by rollup (event_type)")
def kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.kind_totals(event_samples(spark, sf_dir), "event_type")


@query("select event_id as seq, cast(8 + octet_length(cast(props as blob)) + 16 as bigint) as n_bytes from events")
def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = scalar.row_size(scalar.value_size("value", "double"), scalar.value_size("props", "string"))
    return event_samples(spark, sf_dir).select("seq", size.alias("n_bytes"))


@query("""
select event_type <> 'error' as is_metric, count(distinct user_id) as n_sources, count(*) as n_samples,
       cast(sum(case when event_type = 'error' then octet_length(cast(props as blob)) else 8 end + 16) as bigint) as n_bytes
from events group by 1""")
def metric_kind_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.col("event_type") != "error"
    size = F.when(metric, scalar.row_size(F.lit(8))).otherwise(scalar.row_size(scalar.value_size("props", "string")))
    return samples.metric_stats(event_samples(spark, sf_dir), metric, size)


@query("""
with d as (select cast(ts as date) as day, count(*) as n from events group by 1),
     r as (select n, row_number() over (order by n) - 1 as i, count(*) over () as k from d)
select cast(n as double) as median_rate from r where i = k // 2""")
def upper_median_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = event_samples(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return samples.upper_median(days, "n", "median_rate")


# layout and codecs


@query("""
with s as (select user_id as source_id, ts, (row_number() over (partition by user_id order by ts, event_id) - 1) // 16 as seg_no from events)
select source_id, seg_no, min(ts) as min_ts, max(ts) as max_ts, count(*) as n_samples from s group by source_id, seg_no""")
def segment_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.zone_map(samples.segments(event_samples(spark, sf_dir), 16), "source_id", "seg_no")


@query("select user_id as source_id, event_id as seq, (row_number() over (partition by user_id order by ts, event_id) - 1) // 16 as seg_no from events")
def segments_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment numbers counted within days first, for sources too large for one task."""
    return samples.segments(event_samples(spark, sf_dir), 16, "day").select("source_id", "seq", "seg_no")


@query("select user_id as source_id, ts, event_id as seq, value, props from events")
def unpack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.unpack(samples.pack(event_samples(spark, sf_dir), "value", "props", rows=16), newest_first=True)


_DELTAS = """
with t as (select user_id as source_id, ts, event_id as seq, epoch_us(ts) as us from events),
     d as (select *, us - lag(us) over (partition by source_id order by ts, seq) as delta from t),
     e as (select *, delta - lag(delta) over (partition by source_id order by ts, seq) as delta_of_delta from d)"""


@query(_DELTAS + " select source_id, seq, delta, delta_of_delta from e")
def delta_of_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.deltas(event_samples(spark, sf_dir), scalar.micros("ts"), "source_id").select("source_id", "seq", "delta", "delta_of_delta")


@query(_DELTAS + " select seq, delta_of_delta as v, delta_of_delta as back, case when delta_of_delta >= 0 then 2 * delta_of_delta else -2 * delta_of_delta - 1 end as z from e where delta_of_delta is not null")
def zigzag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples.deltas(event_samples(spark, sf_dir), scalar.micros("ts"), "source_id").where("delta_of_delta is not null")
    z = d.select("seq", F.col("delta_of_delta").alias("v"), scalar.zigzag("delta_of_delta").alias("z"))
    return z.select("seq", "v", scalar.unzigzag("z").alias("back"), "z")


@query("select event_id as seq, epoch_us(ts) as us from events")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = samples.deltas(event_samples(spark, sf_dir).withColumn("us", scalar.micros("ts")), F.col("us"), "source_id")
    return samples.undo_deltas(d, "us", "source_id").select("seq", F.col("value_again").alias("us"))


@query("select user_id % 4 as part, count(*) as n_samples, count(distinct user_id) as n_sources from events group by 1")
def partition_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).groupBy(scalar.route("source_id", 4).alias("part")).agg(F.count("*").alias("n_samples"), F.countDistinct("source_id").alias("n_sources"))


@query("select range as i, cast(1000003 // 7 + case when range = 6 then 1000003 % 7 else 0 end as bigint) as rate from range(7)")
def split_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(7).select(F.col("id").alias("i"), scalar.split_rate(F.lit(1_000_003).cast("bigint"), "id", 7).alias("rate"))


@query("select user_id as source_id, ts, event_id as seq, value, props from events")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples through every encoding, one after the other: a fault of any stays in the result."""
    out = event_samples(spark, sf_dir).select("source_id", "ts", "seq", "value", "props")
    for name in codecs.ENCODINGS:
        out = codecs.encode(out, name, scratch_path(spark, name))
    return out


# windows and rates


@query("""
with c as (select ts, row_number() over (order by ts, event_id) as generated, sum(case when event_type = 'error' then 1 else 0 end) over (order by ts, event_id) as dropped from events),
     w as (select (epoch_us(ts) // 432000000000 - k) * 432000000000 as us, generated, dropped from c, (values (0), (1)) v(k))
select make_timestamp(us) as window_start, cast(max(generated) - min(generated) as bigint) as generated, cast(max(dropped) - min(dropped) as bigint) as dropped,
       round(1 - (max(dropped) - min(dropped)) / nullif(max(generated) - min(generated), 0), 9) as completeness
from w group by us""")
def completeness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters by running sums within days and over days, so no task holds the whole table."""
    from pyspark.sql import Window

    e = event_samples(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("bad", (F.col("event_type") == "error").cast("bigint"))
    inside = Window.partitionBy("day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    days = e.groupBy("day").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("day"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"))
    counted = e.select("day", "ts", F.row_number().over(inside).alias("n1"), F.sum("bad").over(inside).alias("b1")).join(days, "day")
    counters = counted.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("n0") + F.col("n1")).alias("generated"), (F.col("b0") + F.col("b1")).alias("dropped"))
    out = samples.completeness(counters, "generated", "dropped", "10 days", "5 days")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "generated", "dropped", F.round("completeness", 9).alias("completeness"))


@query("""
with d as (select date_trunc('day', ts) as ts, count(*) as n from events group by 1),
     c as (select ts, cast(sum(n) over (order by ts) as bigint) as total from d)
select ts, total, round((total - lag(total) over (order by ts)) / ((epoch_us(ts) - lag(epoch_us(ts)) over (order by ts)) / 1000000.0), 9) as per_second from c""")
def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per second between daily readings of a cumulative counter (a row a day)."""
    from pyspark.sql import Window

    days = event_samples(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("n"))
    readings = days.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.sum("n").over(Window.orderBy("ts")).alias("total"))
    return samples.progress_rates(readings, "total").withColumn("per_second", F.round("per_second", 9))


# reshaping


@query("""
with d as (select user_id as source_id, cast(ts as date) as day, event_type as field, arg_max(value, (ts, event_id)) as value from events group by all),
     f as (select distinct source_id, field from d),
     k as (select distinct source_id, day from d)
select k.source_id, k.day, f.field, coalesce(d.value, 'NaN'::double) as value
from k join f using (source_id) left join d using (source_id, day, field)""")
def metric_pivot_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir).withColumn("day", F.to_date("ts"))
    last = e.groupBy("source_id", "day", "event_type").agg(F.max_by("value", F.struct("ts", "seq")).alias("v"))
    maps = last.groupBy("source_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("value"))
    wide = samples.widen(maps)
    return wide.select("source_id", "day", F.explode(F.arrays_zip("fields", "values")).alias("z")).select("source_id", "day", F.col("z.fields").alias("field"), F.col("z.values").alias("value"))


@query("""
with m as (select user_id, cast(ts as date) as day, count(distinct event_type) as n from events group by all),
     w as (select user_id, max(n) as n from m group by user_id)
select min(n) as min_fields, max(n) as max_fields, cast(floor(sum(n) / count(*)) as bigint) as mean_fields from w""")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir).groupBy("source_id", F.to_date("ts").alias("day")).agg(F.array_distinct(F.collect_list("event_type")).alias("f"))
    return samples.field_stats(e.withColumn("value", F.map_from_arrays("f", F.transform("f", lambda x: F.lit(1.0)))))


@query("select user_id as source_id, string_agg(distinct event_type, ',' order by event_type) as fields from events group by user_id")
def field_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir).select("source_id", F.create_map("event_type", "value").alias("value"))
    return samples.field_lists(e).select("source_id", F.array_join("fields", ",").alias("fields"))


@query("""
select user_id as source_id, ts, value from events
where user_id in (select user_id from events group by user_id having count(distinct cast(ts as date)) < 28)""")
def wide_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.narrow_sources(event_samples(spark, sf_dir), F.countDistinct(F.to_date("ts")), 28).select("source_id", "ts", "value")


@query("""
with b as (select user_id, row_number() over (order by user_id) - 1 as position from (select distinct user_id from events)),
     p as (select range as source_id, (range * 7919) % (select count(*) from b) as position from range(20))
select p.source_id, e.ts, e.event_id as seq, e.value from p join b using (position) join events e using (user_id)""")
def source_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.expand_sources(event_samples(spark, sf_dir), 20).select("source_id", "ts", "seq", "value")


@query("select ts, source_id, body from (select ts, user_id as source_id, props as body from events where event_type <> 'error' union all select ts, user_id, event_type from events where event_type = 'error') order by ts")
def union_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    metrics = e.where("event_type <> 'error'").select("ts", "source_id", F.col("props").alias("body"))
    logs = e.where("event_type = 'error'").select("ts", "source_id", F.col("event_type").alias("body"))
    return samples.union_sorted(metrics, logs)


@query("select user_id as source_id, arg_min(event_type, (ts, event_id)) as first_type, count(*) as n_samples from events group by user_id")
def first_sample_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).groupBy("source_id").agg(F.min_by("event_type", F.struct("ts", "seq")).alias("first_type"), F.count("*").alias("n_samples"))


@query("select count(*) as n_sources, count(*) as n_ids from (select distinct user_id, event_type from events)")
def attr_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of attribute maps: as many as there are maps, whatever the order of the keys."""
    maps = event_samples(spark, sf_dir).select("source_id", "event_type", F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("user"), F.col("source_id").cast("string"), F.lit("type"), F.col("event_type"))).otherwise(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("source_id").cast("string"))).alias("m"))
    return maps.agg(F.countDistinct("source_id", "event_type").alias("n_sources"), F.countDistinct(scalar.attribute_hash("m")).alias("n_ids"))


@query("select event_id as seq, '{\"series_id\":\"' || user_id || '\",\"timestamp\":' || epoch_us(ts) || ',\"data\":[\"' || event_type || '\"]}' as document from events")
def bulk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.to_document(event_samples(spark, sf_dir), "event_type", keep=("seq",))


@query("select user_id as source_id, ts, event_id as seq, value from events")
def sorted_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples written in order of time, and read again."""
    path = scratch_path(spark, "sorted")
    telemetry.write_sorted(event_samples(spark, sf_dir).select("source_id", "ts", "seq", "value"), path)
    return telemetry.read_source_map(spark, path)


# the store


def _store(spark: SparkSession, label: str, buckets: int = 8) -> TelemetryStore:
    return TelemetryStore(spark, scratch_path(spark, label), buckets=buckets)


@query(f"select user_id as source_id, ts, value, props from events where {_IN_RANGE.format('<')}")
def pruned_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_scan through a store: only files whose zone the range touches are opened."""
    store = _store(spark, "pruned")
    store.append(event_samples(spark, sf_dir))
    return store.read().range_scan(SOURCE, *_range(spark, sf_dir)).select("source_id", "ts", "value", "props")


@query("select user_id as source_id, ts, event_id as seq, value from events where event_id < (select (max(event_id) + 1) * 7 // 10 from events)")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two versions, read after the second was committed."""
    store, e = _store(spark, "asof"), event_samples(spark, sf_dir)
    cut = (e.agg(F.max("seq")).first()[0] + 1) * 7 // 10
    first = store.append(e.where(F.col("seq") < cut))
    store.append(e.where(F.col("seq") >= cut))
    return store.read(first).all().select("source_id", "ts", "seq", "value")


@query("select user_id as source_id, ts, event_id as seq, value from events")
def compacted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples after several appends and a compaction."""
    store, e = _store(spark, "compacted"), event_samples(spark, sf_dir)
    for k in range(3):
        store.append(e.where(F.col("seq") % 3 == k))
    return store.read(store.compact()).all().select("source_id", "ts", "seq", "value")


@query(f"select user_id as source_id, ts, value, props from events where {_IN_RANGE.format('<')}")
def stream_ingest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_scan of what a stream has put into a store."""
    store, e = _store(spark, "stream"), event_samples(spark, sf_dir)
    landing = scratch_path(spark, "landing")
    e.repartition(4, "seq").write.parquet(landing)
    ingest.ingest(ingest.stream_folder(spark, landing, e.schema, 2), store, "samples", scratch_path(spark, "offsets"), every=None).awaitTermination()
    return store.read().range_scan(SOURCE, *_range(spark, sf_dir)).select("source_id", "ts", "value", "props")


@query("select user_id as source_id, max(ts) as latest_ts from events group by user_id")
def stream_latest_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest timestamp by source as a stream's running state; its last complete output."""
    e = event_samples(spark, sf_dir).select("source_id", "ts")
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "latest")
    e.repartition(4, "ts").write.parquet(landing)
    latest = ingest.running_latest(ingest.stream_folder(spark, landing, e.schema, 2))
    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        numbers.append(number)

    ingest.to_tables(latest, scratch_path(spark, "state"), "complete", keep).awaitTermination()
    return spark.read.parquet(f"{out}/{numbers[-1]}")


@query("select conv_id as key, turn as seq, text as body from conversations where text is not null")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through a partitioned log in small chunks, put together again."""
    topic = log.FolderLog(spark, scratch_path(spark, "topic"), 4, size=37)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null").select("conv_id", "turn", F.concat_ws("\u0001", "turn", "text").cast("binary").alias("body"))
    topic.append(rows, "conv_id", "body")
    whole = topic.messages().select("key", F.decode("value", "UTF-8").alias("v"))
    return whole.select("key", F.substring_index("v", "\u0001", 1).cast("bigint").alias("seq"), F.expr("substring(v, instr(v, '\u0001') + 1)").alias("body"))


# telemetry texts


@query("select event_type as otel_type, count(*) as n_samples, count(distinct user_id) as n_sources, round(sum(value), 4) as total from events where event_id % 10 <> 0 group by event_type")
def json_points_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events written as tagged JSON lines, a tenth of them with a Null value, and read as samples."""
    e = event_samples(spark, sf_dir)
    value = F.when(F.col("seq") % 10 == 0, F.lit('"Null"')).otherwise(F.concat(F.lit('{"Float":'), F.col("value").cast("string"), F.lit("}")))
    line = F.concat(F.lit('{"otel_type":"'), F.col("event_type"), F.lit('","attributes":{"user":{"Int":'), F.col("source_id").cast("string"), F.lit('}},"timestamp":'), scalar.micros("ts").cast("string"), F.lit(',"values":['), value, F.lit("]}"))
    points = telemetry.json_points(e.select(line.alias("line")))
    return points.groupBy("otel_type").agg(F.count("*").alias("n_samples"), F.countDistinct("source_id").alias("n_sources"), F.round(F.sum(F.col("values")[0]["f64"]), 4).alias("total"))


def _tagged_points(e: DataFrame) -> DataFrame:
    """events as points of two values, the first of a kind by event_id, the second the event_id."""
    seq = F.col("seq").cast("string")
    tagged = F.element_at(F.array(F.concat(F.lit('{"Float":'), F.col("value").cast("string"), F.lit("}")), F.concat(F.lit('{"Int":-'), seq, F.lit("}")), F.concat(F.lit('{"Uint":'), seq, F.lit("}")), F.concat(F.lit('{"String":"'), F.col("event_type"), F.lit('"}'))), (F.col("seq") % 4 + 1).cast("int"))
    line = F.concat(F.lit('{"otel_type":"Metric","attributes":{"user":{"Int":'), F.col("source_id").cast("string"), F.lit('}},"timestamp":'), scalar.micros("ts").cast("string"), F.lit(',"values":['), tagged, F.lit(',{"Int":'), seq, F.lit("}]}"))
    return telemetry.json_points(e.select(line.alias("line")))


@query("""
select event_id as seq, case when event_id % 4 = 0 then round(value, 6) end as f64, case when event_id % 4 = 1 then -event_id end as i64, case when event_id % 4 = 2 then event_id end as u64,
       case when event_id % 4 = 3 then event_type end as text, ['f64', 'i64', 'u64', 'bytes'][event_id % 4 + 1] as kind, event_id % 4 <> 3 as metric,
       cast(24 + case when event_id % 4 = 3 then octet_length(encode(event_type)) else 8 end as bigint) as n_bytes from events""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every kind through tagged JSON lines and the typed accessors."""
    points = _tagged_points(event_samples(spark, sf_dir))
    v = F.col("values")[0]
    return points.select(
        F.col("values")[1]["i64"].alias("seq"), F.round(v["f64"], 6).alias("f64"), v["i64"].alias("i64"), v["u64"].cast("bigint").alias("u64"), scalar.utf8(v["bytes"]).alias("text"),
        telemetry.tags_of(F.col("values"))[0].alias("kind"), telemetry.is_metric(F.col("values")).alias("metric"), telemetry.typed_sizes(F.col("values")).alias("n_bytes"),
    )


@query("select kind, count(*) as n_sources from (select arg_min(['f64', 'i64', 'u64', 'bytes'][event_id % 4 + 1] || ',i64', (ts, event_id)) as kind from events group by user_id) group by kind")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of each source by its first point."""
    kinds = telemetry.source_kinds(_tagged_points(event_samples(spark, sf_dir)))
    return kinds.groupBy(F.array_join("kinds", ",").alias("kind")).agg(F.count("*").alias("n_sources"))


@query("select event_id as seq, -event_id as i64, event_id as u64, ts, props as text from events")
def cell_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times from 8-byte big-endian cells, text from bytes."""
    cell = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    e = event_samples(spark, sf_dir).select("seq", cell(-F.col("seq")).alias("a"), cell(F.col("seq")).alias("b"), cell(scalar.micros("ts")).alias("c"), F.encode("props", "UTF-8").alias("d"))
    return e.select("seq", scalar.big_endian("a", "i64").alias("i64"), scalar.big_endian("b", "u64").cast("bigint").alias("u64"), scalar.big_endian("c", "timestamp").cast("timestamp_ntz").alias("ts"), scalar.utf8("d").alias("text"))


@query("select user_id as source_id, cast(ts as date) as day, string_agg(event_type || '=' || n, ',' order by event_type) as vals from (select user_id, ts::date as ts, event_type, count(*) as n from events group by all) group by all")
def ordered_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of fields a source and day, as values in order of their fields."""
    counts = event_samples(spark, sf_dir).groupBy("source_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("source_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.concat_ws("=", "event_type", "n")))).alias("value"))
    return samples.ordered_values(maps).select("source_id", "day", F.array_join("values", ",").alias("vals"))


def _dealt(e: DataFrame) -> DataFrame:
    """Samples in even shares. A scan has no more tasks with rows than its files have row groups, too few for
    metrics, of which a row takes far longer to write and parse as JSON than to shuffle."""
    spark = e.sparkSession
    return e.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "seq", "source_id", "ts")


def _rich_metric_lines(e: DataFrame) -> DataFrame:
    """Sums of three points, the third repeating the attributes of the first, and summaries of three quantiles, one
    without a number, in turn."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    ns = (scalar.micros("ts") * 1000).cast("string").alias("timeUnixNano")
    point = lambda core, v: F.struct(F.array(text("core", F.lit(core)), text("experiment_id", F.lit("e1"))).alias("attributes"), ns, v.alias("asDouble"))
    v = F.col("value")
    sums = F.struct(F.array(point(1, v), point(2, v + 1), point(1, v + 2)).alias("dataPoints"))
    quantile = lambda q, x: F.struct(q.cast("double").alias("quantile"), x.alias("value"))
    summary = F.struct(F.array(F.struct(F.array(text("experiment_id", F.lit("e1"))).alias("attributes"), ns, F.array(quantile(F.lit(None), v), quantile(F.lit(0.5), v + 10), quantile(F.lit(1.0), v + 20)).alias("quantileValues"))).alias("dataPoints"))
    odd = F.col("seq") % 2 == 1
    metric = F.struct(F.col("event_type").alias("name"), F.when(~odd, sums).alias("sum"), F.when(odd, summary).alias("summary"))
    resource = F.struct(F.array(text("user", F.col("source_id"))).alias("attributes"))
    return e.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("line"))


@query("""
select event_type as name, ts, count(*) as n_metrics, cast(sum(case when event_id % 2 = 0 then 2 else 3 end) as bigint) as n_fields,
       round(sum(case when event_id % 2 = 0 then 2 * value + 3 else 3 * value + 30 end), 6) as total, count(distinct user_id) as n_sources from events group by event_type, ts""")
def otlp_sums_and_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums with a repeated point, of which the last counts, and summaries with a field for each quantile."""
    found = telemetry.otlp_metrics(_rich_metric_lines(_dealt(event_samples(spark, sf_dir))))
    total = F.aggregate(F.map_values("value"), F.lit(0.0), lambda a, x: a + x)
    return found.groupBy("name", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_metrics"), F.sum(F.size("value").cast("bigint")).alias("n_fields"), F.round(F.sum(total), 6).alias("total"), F.countDistinct("source_id").alias("n_sources"))


def _metric_lines(e: DataFrame) -> DataFrame:
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    point = F.struct(F.array(text("core", F.col("seq") % 4), text("experiment_id", F.lit("e1"))).alias("attributes"), (scalar.micros("ts") * 1000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    metric = F.struct(F.col("event_type").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    resource = F.struct(F.array(text("user", F.col("source_id"))).alias("attributes"))
    return e.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("line"))


@query("select event_type as name, ts, count(*) as n_samples, round(sum(value), 6) as total from events group by event_type, ts")
def otlp_metrics_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.otlp_metrics(_metric_lines(_dealt(event_samples(spark, sf_dir))))
    total = F.aggregate(F.map_values("value"), F.lit(0.0), lambda a, x: a + x)
    return found.groupBy("name", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_samples"), F.round(F.sum(total), 6).alias("total"))


@query("select ts, count(*) as n_records, count(distinct user_id % 7) as n_sources from events group by ts")
def otlp_logs_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    attribute = F.struct(F.lit("log.file.path").alias("key"), F.struct(F.concat(F.lit("/var/log/"), (F.col("source_id") % 7).cast("string")).alias("stringValue")).alias("value"))
    record = F.struct((scalar.micros("ts") * 1000).cast("string").alias("timeUnixNano"), F.array(attribute).alias("attributes"), F.struct(F.col("props").alias("stringValue")).alias("body"))
    line = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return telemetry.otlp_logs(e.select(line.alias("line"))).groupBy(F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_records"), F.countDistinct("source_id").alias("n_sources"))


@query("select date_trunc('millisecond', ts) as ts, count(*) as n_spans, count(distinct (event_type, user_id % 3)) as n_sources from events group by 1")
def jaeger_spans_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("vStr"))
    process = F.struct(F.lit("svc").alias("serviceName"), F.array(F.struct(F.lit("zone").alias("key"), (F.col("source_id") % 3).cast("string").alias("vInt64"))).alias("tags"))
    span = F.struct(F.col("event_type").alias("operationName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startTime"), F.array(tag("span.kind", F.lit("server")), tag("experiment_id", F.lit("e1"))).alias("tags"), process.alias("process"))
    found = telemetry.jaeger_spans(e.select(F.to_json(span).alias("line")))
    return found.groupBy(F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n_spans"), F.countDistinct("source_id").alias("n_sources"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


