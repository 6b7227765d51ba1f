"""Operators on a table of samples: source_id, ts, seq and value columns.

Each is a plain DataFrame expression, so predicates and columns reach the scan and Catalyst plans the rest.
``seq`` breaks ties between equal timestamps; it is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.session import scratch_path


def of_source(df: DataFrame, source) -> DataFrame:
    """Samples of one source; an unknown source has none."""
    return df.where(F.col("source_id") == source)


def in_range(df: DataFrame, t_from: Column, t_to: Column, closed: str = "left") -> DataFrame:
    """Samples with t_from <= ts < t_to, or <= t_to with closed="both"."""
    if closed not in ("left", "both"):
        raise ValueError("closed is 'left' or 'both'")
    ts = F.col("ts")
    return df.where((ts >= t_from) & ((ts < t_to) if closed == "left" else (ts <= t_to)))


def range_scan(df: DataFrame, source, t_from: Column, t_to: Column, closed: str = "left", newest_first: bool = False) -> DataFrame:
    """Samples of a source in a range; a set, unless newest_first."""
    out = in_range(of_source(df, source), t_from, t_to, closed)
    return newest_first_order(out) if newest_first else out


def newest_first_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("seq"))


def time_order(df: DataFrame) -> DataFrame:
    return df.orderBy("ts", "seq")


def newest(df: DataFrame, k: int) -> DataFrame:
    """The k newest samples; planned as a top-k, not as a sort."""
    return newest_first_order(df).limit(k)


def without_nulls(df: DataFrame, values: str = "values") -> DataFrame:
    """Samples none of whose values is null."""
    return df.where(~F.exists(values, lambda v: v.isNull()))


def range_count(df: DataFrame, source, t_from: Column, t_to: Column, closed: str = "both") -> DataFrame:
    return range_scan(df, source, t_from, t_to, closed).agg(F.count("*").alias("doc_count"))


def latest_ts(df: DataFrame, source=None) -> DataFrame:
    """Newest timestamp, of a source or of all; null if there is no sample."""
    return (df if source is None else of_source(df, source)).agg(F.max("ts").alias("latest_ts"))


def latest_per_source(df: DataFrame, *values: str) -> DataFrame:
    """The newest sample of each source. A partial maximum per task goes through the shuffle, one row a
    source and task, so a source with a third of all samples is no hot spot."""
    best = F.max(F.struct("ts", "seq", *values)).alias("b")
    return df.groupBy("source_id").agg(best).select("source_id", *(F.col(f"b.{c}").alias(c) for c in ("ts", "seq", *values)))


def data_age(df: DataFrame, now: Column) -> DataFrame:
    """Microseconds between now and the newest sample of each source."""
    return df.groupBy("source_id").agg(F.max("ts").alias("latest_ts")).withColumn("age_us", scalar.micros(now) - scalar.micros("latest_ts"))


def source_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("source_id").agg(F.count("*").alias("n_samples"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rk, the place of each row from 1 on in an order without ties. Rows are sorted in ranges, one a
    task, and written; a row's place is that in its range after the sizes of the ranges before."""
    spark = df.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, "ranked")
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(sizes), "_range").select(*df.columns, place.alias("rk"))  # a row a shuffle partition


def hot_sources(df: DataFrame, one_in: int = 10) -> DataFrame:
    """The longest tenth of the sources, ties by the larger id: (source_id, n_samples, rk).

    The length of the last one that stays comes from the numbers of sources of each length, of which there are
    far fewer than sources; only sources of that length or more are ranked, by ranges."""
    lengths = source_lengths(df)
    keep = lengths.count() // one_in
    before = Window.orderBy(F.desc("n_samples")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = lengths.groupBy("n_samples").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    least = sizes.where(F.col("before") < keep).agg(F.min("n_samples")).first()[0]
    long = lengths.where(F.col("n_samples") >= F.lit(least).cast("bigint"))
    return ranked(long, F.desc("n_samples"), F.desc("source_id")).where(F.col("rk") <= keep)


def length_stats(df: DataFrame) -> DataFrame:
    """Number of sources, and least, greatest and mean (whole number) samples of one."""
    n = F.col("n_samples")
    return source_lengths(df).agg(F.count("*").alias("n_sources"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.floor(F.sum(n) / F.count("*")).alias("mean_len"))


def kind_stats(df: DataFrame, kind: str) -> DataFrame:
    """Samples and different sources of each kind."""
    return df.groupBy(kind).agg(F.count("*").alias("n_samples"), F.countDistinct("source_id").alias("n_sources"))


def kind_totals(df: DataFrame, kind: str) -> DataFrame:
    """kind_stats with a row for all kinds together (kind null)."""
    return df.rollup(kind).agg(F.count("*").alias("n_samples"), F.countDistinct("source_id").alias("n_sources"))


def metric_stats(df: DataFrame, is_metric: Column, size: Column) -> DataFrame:
    """Sources, samples and bytes of metrics and of the rest."""
    return df.groupBy(is_metric.alias("is_metric")).agg(F.countDistinct("source_id").alias("n_sources"), F.count("*").alias("n_samples"), F.sum(size).alias("n_bytes"))


def upper_median(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """Element floor(n / 2) of the n sorted values (of each group), without interpolation. The discrete
    percentile just above one half is that element; its state counts distinct values in each task first."""
    picked = F.expr(f"percentile_disc(0.500000000001) WITHIN GROUP (ORDER BY `{value}`)").alias(out)
    return df.groupBy(*keys).agg(picked)


def segments(df: DataFrame, rows: int = 256, slot: str | None = None) -> DataFrame:
    """df with seg_no: rows of a source in order of time, ``rows`` to a segment.

    With a slot (day, hour ...) rows are numbered within slots and the slots' counts are summed up, so that a
    source with a large share of all samples is numbered by as many tasks as it has slots."""
    order = ("ts", "seq")
    if slot is None:
        w = Window.partitionBy("source_id").orderBy(*order)
        return df.withColumn("seg_no", F.floor((F.row_number().over(w) - 1) / rows))
    slotted = df.withColumn("_slot", F.date_trunc(slot, "ts"))
    counts = slotted.groupBy("source_id", "_slot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_id", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source_id", "_slot").orderBy(*order))
    numbered = slotted.withColumn("_inside", inside).join(counts, ["source_id", "_slot"])
    return numbered.withColumn("seg_no", F.floor((F.col("_before") + F.col("_inside") - 1) / rows)).select(*df.columns, "seg_no")


def zone_map(df: DataFrame, *keys: str) -> DataFrame:
    """True range of time and number of samples by keys."""
    return df.groupBy(*keys).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n_samples"))


def overlapping(zones: DataFrame, t_from: Column, t_to: Column, closed: str = "left") -> DataFrame:
    """Zones that a range can touch, newest first."""
    low = (F.col("min_ts") < t_to) if closed == "left" else (F.col("min_ts") <= t_to)
    return zones.where(low & (F.col("max_ts") >= t_from)).orderBy(F.desc("min_ts"), F.desc("max_ts"))


def pack(df: DataFrame, *values: str, rows: int = 256) -> DataFrame:
    """One row a segment: its samples as an array in order of time. A segment never outgrows ``rows``."""
    packed = segments(df, rows).groupBy("source_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", *values))).alias("samples"))
    return packed.withColumn("min_ts", F.col("samples")[0]["ts"]).withColumn("max_ts", F.element_at("samples", -1)["ts"])


def unpack(packed: DataFrame, newest_first: bool = False) -> DataFrame:
    """Samples of packed segments; newest first within each if asked."""
    samples = F.sort_array("samples", asc=False) if newest_first else F.col("samples")
    return packed.select("source_id", F.inline(samples))


def deltas(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """df with delta and delta_of_delta of a whole-number column in order of time; null where undefined."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    out = df.withColumn("_v", value)
    out = out.withColumn("delta", F.col("_v") - F.lag("_v").over(w))
    return out.withColumn("delta_of_delta", F.col("delta") - F.lag("delta").over(w)).drop("_v")


def undo_deltas(df: DataFrame, first: str, *keys: str) -> DataFrame:
    """The values again: first (the value where delta is null) plus the running sum of delta."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value_again", F.first(first).over(w) + F.sum(F.coalesce("delta", F.lit(0))).over(w))


def completeness(df: DataFrame, generated: str, dropped: str, window: str = "10 seconds", slide: str = "5 seconds") -> DataFrame:
    """1 - dropped / generated by hopping window, from the growth of two cumulative counters; null where
    nothing was generated."""
    w = F.window("ts", window, slide)
    out = df.groupBy(w.alias("w")).agg((F.max(generated) - F.min(generated)).alias("generated"), (F.max(dropped) - F.min(dropped)).alias("dropped"))
    return out.select(F.col("w.start").alias("window_start"), "generated", "dropped", (1 - F.try_divide("dropped", "generated")).alias("completeness"))


def progress_rates(df: DataFrame, counter: str, *keys: str) -> DataFrame:
    """Growth of a cumulative counter per second between neighbouring readings."""
    w = Window.partitionBy(*keys).orderBy("ts") if keys else Window.orderBy("ts")
    seconds = (scalar.micros("ts") - F.lag(scalar.micros("ts")).over(w)) / 1_000_000
    return df.withColumn("per_second", F.try_divide(F.col(counter) - F.lag(counter).over(w), seconds))


def expand_sources(df: DataFrame, n: int, bases: DataFrame | None = None) -> DataFrame:
    """n new sources, each a copy of a base source drawn by a fixed rule, in one table.

    bases (n_base rows of base_id, position from 0) names the base sources; default: all of df by id."""
    spark = df.sparkSession
    if bases is None:
        ids = df.select("source_id").distinct()
        bases = ranked(ids, F.asc("source_id")).select(F.col("source_id").alias("base_id"), (F.col("rk") - 1).alias("position"))
    count = bases.count()
    picks = spark.range(n).select(F.col("id").alias("new_id"), F.pmod(F.col("id") * 7919, F.lit(max(1, count))).alias("position"))
    return df.join(bases.join(picks, "position"), df["source_id"] == F.col("base_id")).drop("source_id", "base_id", "position").withColumnRenamed("new_id", "source_id")


def narrow_sources(df: DataFrame, width: Column, below: int) -> DataFrame:
    """Samples of sources with fewer than ``below`` fields."""
    keep = df.groupBy("source_id").agg(width.alias("_width")).where(F.col("_width") < below).select("source_id")
    return df.join(keep, "source_id", "left_semi")


def checked_width(df: DataFrame, values: str = "values") -> DataFrame:
    """df, failing the query if a source has samples of different numbers of values."""
    widths = df.groupBy("source_id").agg(F.min(F.size(values)).alias("_lo"), F.max(F.size(values)).alias("_hi"))
    return df.join(widths, "source_id").where(F.assert_true(F.col("_lo") == F.col("_hi"), "a source has samples of different widths").isNull()).drop("_lo", "_hi")


def add_fields(df: DataFrame, **fields: Column) -> DataFrame:
    return df.withColumns(fields)


def field(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """A single value column with its place."""
    return df.select("source_id", "ts", "seq", F.col(name).alias(out or name))


def field_lists(df: DataFrame, values: str = "value") -> DataFrame:
    """(source_id, fields): the sorted names of all fields of each source; a set of names is gathered, not rows."""
    names = df.select("source_id", F.explode(F.map_keys(values)).alias("f")).distinct()
    return names.groupBy("source_id").agg(F.array_sort(F.collect_list("f")).alias("fields"))


def field_stats(df: DataFrame, values: str = "value") -> DataFrame:
    """Least, greatest and mean (whole number) fields of a source's widest sample."""
    widest = df.groupBy("source_id").agg(F.max(F.size(values)).cast("bigint").alias("n"))
    return widest.agg(F.min("n").alias("min_fields"), F.max("n").alias("max_fields"), F.floor(F.sum("n") / F.count("*")).alias("mean_fields"))


def observed(df: DataFrame, name: str, size: Column | None = None):
    """(df, its Observation): samples and bytes that pass through, counted in the same job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).cast("bigint").alias("bytes")), seen


def widen(df: DataFrame, values: str = "value", out: str = "values") -> DataFrame:
    """Maps of fields to numbers as arrays: each source has one sorted list of all its fields, and an absent
    field is NaN."""
    nan = F.lit(float("nan"))
    joined = df.join(field_lists(df, values), "source_id")
    return joined.withColumn(out, F.transform("fields", lambda f: F.coalesce(F.try_element_at(values, f), nan)))


def ordered_values(df: DataFrame, values: str = "value", out: str = "values") -> DataFrame:
    """Maps as arrays of values in order of their fields, without filling."""
    return df.withColumn(out, F.transform(F.array_sort(F.map_entries(values)), lambda e: e["value"]))


def union_sorted(*tables: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, in order of time."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy("ts")
