import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import samples
from tidemark.plans import catalog
from tidemark.sources import telemetry


def lines(spark, *objects):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in objects], "line string")


def test_json_points(spark):
    metric = {"otel_type": "Metric", "attributes": {"host": {"String": "a"}, "cpu": {"Int": 0}}, "timestamp": 1700000000000000, "values": [{"Float": 0.5}, {"Uint": 7}]}
    turned = {**metric, "attributes": {"cpu": {"Int": 0}, "host": {"String": "a"}}, "values": [{"Int": -3}]}
    log = {"otel_type": "Log", "attributes": {"file": {"String": "/x"}}, "timestamp": 1700000000000001, "values": [{"String": "started"}]}
    span = {"otel_type": "Span", "attributes": {"svc": {"String": "db"}}, "timestamp": 1700000000000002, "values": ["Null"]}
    got = telemetry.json_points(lines(spark, metric, turned, log, span, "", "no json", "{}")).collect()
    assert len(got) == 3 and got[0]["source_id"] == got[1]["source_id"] != got[2]["source_id"]
    assert (got[0]["values"][0]["f64"], int(got[0]["values"][1]["u64"]), got[1]["values"][0]["i64"], bytes(got[2]["values"][0]["bytes"])) == (0.5, 7, -3, b"started")
    df = telemetry.json_points(lines(spark, metric, log))
    rows = df.select("otel_type", telemetry.is_metric(F.col("values")).alias("m"), telemetry.tags_of(F.col("values")).alias("k"), telemetry.typed_sizes(F.col("values")).alias("n")).collect()
    assert {r["otel_type"]: (r["m"], r["k"], r["n"]) for r in rows} == {"Metric": (True, ["f64", "u64"], 32), "Log": (False, ["bytes"], 23)}
    assert sorted(len(r["kinds"]) for r in telemetry.source_kinds(df).collect()) == [1, 2]


def points(*pairs, ns="1700000000000000000", extra=True):
    return [{"attributes": [{"key": "core", "value": {"stringValue": c}}, *([{"key": "experiment_id", "value": {"stringValue": "e1"}}] if extra else [])], "asDouble": v, "timeUnixNano": ns} for c, v in pairs]


def metrics(*ms):
    return {"resourceMetrics": [{"resource": {"attributes": [{"key": "host", "value": {"stringValue": "a"}}]}, "scopeMetrics": [{"metrics": list(ms)}]}]}


def test_otlp_metrics(spark):
    summary = {"name": "lat", "summary": {"dataPoints": [{"attributes": [{"key": "experiment_id", "value": {"stringValue": "e1"}}], "timeUnixNano": "1700000000000000000", "quantileValues": [{"value": 0.1}, {"quantile": 0.5, "value": 0.2}]}]}}
    line = metrics({"name": "cpu", "gauge": {"dataPoints": points(("0", 1.5), ("1", 2.5), ("0", 9.0))}}, {"name": "n", "sum": {"dataPoints": points(("0", 3.0))}}, summary)
    got = {r["name"]: r for r in telemetry.otlp_metrics(lines(spark, line)).collect()}
    assert sorted(got["cpu"]["value"].values()) == [2.5, 9.0]  # the last of a repeated point
    assert list(got["n"]["value"].values()) == [3.0] and sorted(got["lat"]["value"].values()) == [0.1, 0.2]
    assert got["cpu"]["ts_ns"] == 1700000000000000000 and len({r["source_id"] for r in got.values()}) == 3
    wide = {r["name"]: r["values"] for r in samples.widen(telemetry.otlp_metrics(lines(spark, line, metrics({"name": "cpu", "gauge": {"dataPoints": points(("2", 5.0), ns="1700000001000000000")}})))).collect()}
    assert len(wide["cpu"]) == 3


@pytest.mark.parametrize(
    "metric",
    [
        {"name": "x", "gauge": {"dataPoints": points(("0", 1.0)) + points(("1", 1.0), ns="1")}},
        {"name": "x", "gauge": {"dataPoints": points(("0", 1.0), extra=False)}},
        {"name": "x", "summary": {"dataPoints": points(("0", 1.0)) * 2}},
    ],
)
def test_otlp_metrics_rules(spark, metric):
    with pytest.raises(Exception):
        telemetry.otlp_metrics(lines(spark, metrics(metric))).collect()


def test_otlp_logs(spark):
    def record(path, ns):
        return {"timeUnixNano": ns, "body": {"stringValue": "hi"}, "attributes": [{"key": "log.file.path", "value": {"stringValue": path}}]}

    line = {"resourceLogs": [{"scopeLogs": [{"logRecords": [record("/a", "1700000000000000001"), record("/b", "1700000000000000002")]}, {"logRecords": [record("/a", "3000")]}]}]}
    got = telemetry.otlp_logs(lines(spark, line)).collect()
    assert len(got) == 3 and len({r["source_id"] for r in got}) == 2 and json.loads(bytes(got[0]["body"]))["body"]["stringValue"] == "hi"
    bad = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1", "attributes": []}]}]}]}
    with pytest.raises(Exception):
        telemetry.otlp_logs(lines(spark, bad)).collect()


def test_jaeger_spans(spark):
    def span(tags, process):
        return {"operationName": "op", "startTime": "2023-01-02T03:04:05.678901Z", "tags": tags, "process": {"serviceName": "s", "tags": process}}

    tags = [{"key": "span.kind", "vStr": "server"}, {"key": "experiment_id", "vInt64": "7"}]
    p = [{"key": "a", "vInt64": "1"}, {"key": "b", "vBool": True}, {"key": "c", "vFloat64": 0.5}]
    got = telemetry.jaeger_spans(lines(spark, span(tags, p), span(tags[::-1], p[::-1]), span(tags, p[:2]))).collect()
    assert got[0]["source_id"] == got[1]["source_id"] != got[2]["source_id"]
    assert got[0]["ts"].microsecond == 678000 and json.loads(bytes(got[0]["body"]))["operationName"] == "op"
    with pytest.raises(Exception):
        telemetry.jaeger_spans(lines(spark, span(tags[:1], p))).collect()


def test_attribute_lists(spark):
    a = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("b", "2"), ("a", "1"))))
    r = spark.range(1).select(telemetry.with_attribute(a, "0", F.lit(5)).alias("w"), telemetry.without_attribute(a, "b").alias("o"), telemetry.attribute(a, "z").alias("n")).first()
    assert [x["key"] for x in r["w"]] == ["0", "a", "b"] and [x["key"] for x in r["o"]] == ["a"] and r["n"] is None


def test_readers_of_folders(spark, tmp_path):
    (tmp_path / "one.json").write_text("a\nb\n")
    (tmp_path / "two.json").write_text("c\n")
    assert sorted(r["line"] for r in telemetry.lines(spark, str(tmp_path)).collect()) == ["a", "b", "c"]
    out = str(tmp_path / "sorted")
    telemetry.write_sorted(spark.createDataFrame([(3,), (1,), (2,)], "ts bigint"), out)
    assert [r["ts"] for r in telemetry.read_source_map(spark, out).collect()] == [1, 2, 3]
    doc = telemetry.to_document(spark.sql("select 7L source_id, timestamp'2024-01-01' ts, 1.5D value"), "value").first()["document"]
    assert json.loads(doc) == {"series_id": "7", "timestamp": 1704067200000000, "data": ["1.5"]}


def test_json_is_parsed_once(spark):
    raw = spark.createDataFrame([("{}",)], "line string")
    for df, call in ((telemetry.json_points(raw), "parse_json"), (telemetry.otlp_metrics(raw), "from_json")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower().replace("parsejson", "parse_json")
        plan = plan.replace("jsontostructs", "from_json")
        assert plan.count(call) == 1, plan


def test_last_wins_keeps_the_last_of_equal_keys(spark):
    df = spark.sql("select array(struct(2L as key, 1.0 as value), struct(1L as key, 2.0 as value), struct(2L as key, 3.0 as value)) as e union all select array()")
    got = [r[0] for r in df.select(telemetry.last_wins(F.col("e"))).collect()]
    assert {2: 3, 1: 2} in got and {} in got


def test_points_of_a_metric_are_hashed_once(spark):
    plan = telemetry.otlp_metrics(spark.createDataFrame([("{}",)], "line string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 3 and "array_sort" not in plan, plan  # a source, a number's point and a quantile


@pytest.mark.parametrize("query", [catalog.otlp_sums_and_summaries, catalog.otlp_metrics_flatten])
def test_metrics_are_dealt_out_before_they_are_parsed(spark, sf_dir, query):
    assert "RepartitionByExpression" in query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    shares = [r["count"] for r in catalog._dealt(catalog.event_samples(spark, sf_dir)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 4 and max(shares) < 2 * sum(shares) / len(shares)
