import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.session import scratch_path, session
from tidemark.sources import log
from tidemark.sources.store import TelemetryStore
from tidemark.streaming import ingest


@pytest.fixture
def landing(spark, sf_dir):
    df = catalog.event_samples(spark, sf_dir)
    path = scratch_path(spark, "landing")
    df.repartition(5, "seq").write.parquet(path)
    return df, path


def test_stream_equals_batch(spark, landing):
    df, path = landing
    store, offsets = TelemetryStore(spark, scratch_path(spark, "store"), 4), scratch_path(spark, "offsets")
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.stream_folder(spark, path, df.schema, 2), store, "s", offsets, every=None).awaitTermination()
    got = store.read().all().select(df.columns)
    assert got.exceptAll(df).count() == 0 and df.exceptAll(got).count() == 0
    assert store.read().version == 3
    ingest.ingest(ingest.stream_folder(spark, path, df.schema), store, "half", scratch_path(spark, "o2"), every=None, transform=lambda b: ingest.shed(b, 0.5)).awaitTermination()
    kept = store.read().all().count() - df.count()
    assert 0.4 < kept / df.count() < 0.6 and kept == ingest.shed(df, 0.5).count()
    spark.streams.removeListener(progress)
    assert progress.summary()["batches"] >= 0


def test_running_completeness(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=k), 10 * k, k) for k in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, generated bigint, dropped bigint")
    path, out = scratch_path(spark, "counters"), []
    df.repartitionByRange(3, "ts").write.parquet(path)
    stream = ingest.running_completeness(ingest.stream_folder(spark, path, df.schema), "generated", "dropped")
    ingest.to_tables(stream, scratch_path(spark, "state"), "append", lambda b, n: out.extend(b.collect())).awaitTermination()
    assert out and all(r["completeness"] is None or abs(r["completeness"] - 0.9) < 1e-9 for r in out)


def test_replay_and_load(spark, landing):
    df, _ = landing
    stream = ingest.replay(spark, df.limit(20), 1000)
    assert stream.isStreaming and {"ts", "seq", "source_id", "value"} <= set(stream.columns)
    q = stream.writeStream.format("memory").queryName("replayed").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if q.lastProgress and spark.table("replayed").count():
                break
            q.awaitTermination(0.5)
        assert spark.table("replayed").count() > 0
    finally:
        q.stop()
    assert log.load(spark, 3, message=1000).isStreaming


def test_log_stream(spark):
    topic = log.FolderLog(spark, scratch_path(spark, "topic"), 2)
    topic.append(spark.range(10).select("id", F.lit(bytearray(b"x")).alias("v")), "id", "v")
    seen = []
    ingest.to_tables(topic.stream(), scratch_path(spark, "state"), "append", lambda b, n: seen.append(b.count())).awaitTermination()
    assert sum(seen) == 10


def test_concurrent_queries(spark, sf_dir):
    df = catalog.event_samples(spark, sf_dir)
    assert ingest.concurrently([lambda k=k: df.where(F.col("seq") % 3 == k).count() for k in range(3)]) == [df.where(F.col("seq") % 3 == k).count() for k in range(3)]
    assert session(name="same") is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source_id", "ts", "value", "props"]
    assert set(catalog.oracle_sql()) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
