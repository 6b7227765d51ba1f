import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import samples

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def df(spark):
    rows = [(s, T0 + dt.timedelta(seconds=k // 2), k, float(k)) for s, n in ((1, 40), (2, 1), (3, 16)) for k in range(n)]
    return spark.createDataFrame(rows, "source_id bigint, ts timestamp, seq bigint, value double")


def test_segments_hold_rows_in_order(df):
    packed = samples.pack(df, "value", rows=16)
    sizes = {(r["source_id"], r["seg_no"]): len(r["samples"]) for r in packed.collect()}
    assert sizes == {(1, 0): 16, (1, 1): 16, (1, 2): 8, (2, 0): 1, (3, 0): 16}
    assert samples.unpack(packed).exceptAll(df).count() == 0 and df.exceptAll(samples.unpack(packed)).count() == 0
    assert all(r["min_ts"] == r["samples"][0]["ts"] and r["max_ts"] == r["samples"][-1]["ts"] for r in packed.collect())
    newest = samples.unpack(packed.where("source_id = 1 and seg_no = 0"), newest_first=True).collect()
    assert [r["seq"] for r in newest] == list(range(15, -1, -1))


def test_segments_by_slot_are_the_same(df):
    assert samples.segments(df, 7, "minute").exceptAll(samples.segments(df, 7)).count() == 0
    out, seen = samples.observed(df, "through", F.lit(2))
    assert out.count() == 57 and seen.get == {"samples": 57, "bytes": 114}


def test_zones_overlap(df):
    zones = samples.zone_map(samples.segments(df.where("source_id = 1"), 16), "seg_no")
    hits = lambda a, b, closed="left": [r["seg_no"] for r in samples.overlapping(zones, F.lit(T0 + dt.timedelta(seconds=a)), F.lit(T0 + dt.timedelta(seconds=b)), closed).collect()]
    assert hits(6, 9) == [1, 0] and hits(8, 8, "both") == [1] and hits(30, 40) == [] and hits(0, 8) == [0]


def test_median_is_the_upper_one(spark):
    for values in ([1], [1, 2], [3, 1, 2], [4, 1, 3, 2], [5, 5, 1, 1]):
        got = samples.upper_median(spark.createDataFrame([(v,) for v in values], "v bigint"), "v", "m").first()["m"]
        assert got == sorted(values)[len(values) // 2]


def test_completeness(spark):
    rows = [(T0 + dt.timedelta(seconds=k), 10 * k, k) for k in range(20)]
    got = samples.completeness(spark.createDataFrame(rows, "ts timestamp, generated bigint, dropped bigint"), "generated", "dropped").collect()
    assert all(r["completeness"] is None or math.isclose(r["completeness"], 0.9) for r in got) and len(got) == 5


def test_hot_and_lengths(df):
    assert samples.hot_sources(df, 3).collect()[0]["source_id"] == 1
    r = samples.length_stats(df).first()
    assert (r["n_sources"], r["min_len"], r["max_len"], r["mean_len"]) == (3, 1, 40, 19)


def test_null_points_go(spark):
    rows = spark.createDataFrame([([1.0, None],), ([1.0],), ([],)], "values array<double>")
    assert samples.without_nulls(rows).count() == 2


def test_widths(spark):
    good = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [1.0, 2.0])], "source_id bigint, values array<double>")
    assert samples.checked_width(good).count() == 3
    with pytest.raises(Exception):
        samples.checked_width(good.union(spark.createDataFrame([(1, [1.0, 1.0])], good.schema))).collect()


def test_maps(spark):
    m = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0}), (1, {"c": 3.0})], "source_id bigint, value map<string,double>")
    wide = sorted((r["values"] for r in samples.widen(m).collect()), key=str)
    assert wide[0][:2] == [1.0, 2.0] and math.isnan(wide[0][2]) and wide[1][2] == 3.0
    assert samples.ordered_values(m).collect()[0]["values"] == [1.0, 2.0]


def test_newest_is_a_top_k(df):
    plan = samples.newest(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and [r["seq"] for r in samples.newest(df.where("source_id = 1"), 3).collect()] == [39, 38, 37]
    assert samples.add_fields(df, twice=F.col("value") * 2).columns[-1] == "twice"


def test_hot_sources_with_many_ties(spark):
    rows = [(k, 1 + (k % 3 == 0) + 5 * (k % 50 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "source_id bigint, n int").select("source_id", F.explode(F.sequence(F.lit(1), "n")))
    wanted = sorted(((n, k) for k, n in rows), reverse=True)[:40]
    got = samples.hot_sources(df).orderBy("rk").collect()
    assert [(r["n_samples"], r["source_id"], r["rk"]) for r in got] == [(n, k, i + 1) for i, (n, k) in enumerate(wanted)]
    assert samples.hot_sources(df.limit(0)).count() == 0


def test_ranks_need_no_window_over_all_rows(spark):
    got = samples.ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("source_id")), F.desc("source_id"))
    assert all(r["rk"] == 1000 - r["source_id"] for r in got.collect())
