import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import samples
from tidemark.session import scratch_path
from tidemark.sources.bulk import BUSY, BulkClient, BulkError, FolderReceiver, write_bulk
from tidemark.sources.log import FolderLog, chunks, has_kafka, kafka_options
from tidemark.sources.store import TelemetryStore

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "source_id bigint, ts timestamp, seq bigint, value double, body binary"


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def made(spark, rows):
    return spark.createDataFrame([(s, at(t), q, float(v), b) for s, t, q, v, b in rows], SCHEMA)


@pytest.fixture
def store(spark):
    return TelemetryStore(spark, scratch_path(spark, "store"), buckets=4, rows_per_file=50)


def test_everything_pushed_comes_back_newest_first(spark, store):
    rng = random.Random(3)
    rows, seq = [], 0
    for _ in range(4):
        batch = []
        for _ in range(300):
            seq += 1
            batch.append((rng.choice([1, 1, 1, 2, 3]), rng.randrange(2000), seq, rng.random(), rng.randbytes(rng.randrange(20))))
        rows += batch
        store.append(made(spark, batch))
    for source in (1, 2, 3, 9):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1], r[2]), reverse=True)
        got = samples.newest_first_order(store.read().source(source)).collect()
        assert [(g["ts"], g["seq"], bytes(g["body"])) for g in got] == [(at(r[1]), r[2], r[4]) for r in own]
        for lo, hi in ((0, 2000), (100, 200), (500, 500), (777, 778), (3000, 4000)):
            a, b = F.lit(at(lo)), F.lit(at(hi))
            for closed in ("left", "both"):
                n = sum(lo <= r[1] < hi or (closed == "both" and r[1] == hi) for r in own)
                assert store.read().range_scan(source, a, b, closed).count() == n
    assert store.read().latest_ts() == at(max(r[1] for r in rows))
    assert store.read().latest_ts(9) is None
    with pytest.raises(ValueError):
        samples.in_range(store.read().all(), F.lit(at(0)), F.lit(at(1)), closed="right")


def test_pruning_opens_few_files(spark, store):
    store.append(made(spark, [(s, 1000 * k, k, k, b"") for s in range(8) for k in range(200)]))
    snapshot = store.read()
    every = snapshot.files()
    some = snapshot.files(3, F.lit(at(50_000)), F.lit(at(60_000)))
    assert 1 <= len(some) < len(every) / 3
    plan = snapshot.range_scan(3, F.lit(at(50_000)), F.lit(at(60_000)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(source_id,3)" in plan and "GreaterThanOrEqual(ts" in plan


def test_versions_do_not_change(spark, store):
    first = store.append(made(spark, [(1, 1, 1, 1, b"a")]))
    old = store.read()
    store.append(made(spark, [(1, 2, 2, 2, b"b"), (2, 2, 3, 2, b"b")]))
    third = store.compact()
    assert old.all().count() == 1 and store.read(first).all().count() == 1
    assert store.read().all().count() == 3 and store.read().version == third
    assert store.history() == [3, 2, 1] and store.read(0).all().count() == 0
    again = TelemetryStore(spark, store.path, buckets=4)
    assert again.read().all().count() == 3
    assert sorted(r["n_samples"] for r in store.read().zones().collect()) and store.read().zones().agg(F.sum("n_samples")).first()[0] == 3


def test_batches_are_added_once(spark, store):
    batch = made(spark, [(1, 1, 1, 1, b"a")])
    assert store.append(batch, "s", 0) == 1
    assert store.append(batch, "s", 0) == 1
    assert store.append(batch, "s", 1) == 2
    assert store.append(batch, "other", 0) == 3
    assert store.read().all().count() == 3


def test_writers_at_the_same_time(spark, store):
    failed = []

    def write(k):
        try:
            store.append(made(spark, [(k, k, k, k, b"")]))
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.read().version == 6
    assert sorted(r["source_id"] for r in store.read().all().collect()) == list(range(6))


def test_wrong_columns_are_refused(spark, store):
    store.append(made(spark, [(1, 1, 1, 1, b"a")]))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1, at(1), 1, "x")], "source_id bigint, ts timestamp, seq bigint, value string"))
    with pytest.raises(ValueError):
        store.append(spark.range(1))


def test_special_values(spark):
    store = TelemetryStore(spark, scratch_path(spark, "special"), buckets=2)
    rows = [(1, at(5), 1, float("nan"), 2**64 - 1, b""), (1, at(5), 2, 0.5, 0, b"\xff\x00")]
    store.append(spark.createDataFrame([(a, b, c, d, str(e), f) for a, b, c, d, e, f in rows], "source_id bigint, ts timestamp, seq bigint, v double, u string, b binary").withColumn("u", F.col("u").cast("decimal(20,0)")))
    got = store.read().newest(1, 5).collect()
    assert [g["seq"] for g in got] == [2, 1] and got[1]["v"] != got[1]["v"] and int(got[1]["u"]) == 2**64 - 1 and bytes(got[0]["b"]) == b"\xff\x00"


def test_snapshots_are_kept_for_a_while(spark, store):
    clock = [0.0]
    store.append(made(spark, [(1, 1, 1, 1, b"")]))
    assert store.snapshot(0.5, lambda: clock[0]).version == 1
    store.append(made(spark, [(1, 2, 2, 1, b"")]))
    clock[0] = 0.4
    assert store.snapshot(0.5, lambda: clock[0]).version == 1
    clock[0] = 0.5
    assert store.snapshot(0.5, lambda: clock[0]).version == 2


def test_freshness(spark, store):
    clock = [0.0]
    store.append(made(spark, [(1, 10, 1, 1, b"")]))
    assert store.wait_until_fresh(at(9), 1).version == 1

    def sleep(s):
        clock[0] += s
        if clock[0] == 1.5:
            store.append(made(spark, [(1, 30, 2, 1, b"")]))

    assert store.wait_until_fresh(at(10), 1, timeout_s=9, clock=lambda: clock[0], sleep=sleep).version == 2
    with pytest.raises(TimeoutError):
        store.wait_until_fresh(at(30), 1, timeout_s=2, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))


def test_sources(spark, store):
    store.register(spark.createDataFrame([(1, ["f64"]), (2, ["bytes"])], "source_id bigint, kinds array<string>"))
    store.register(spark.createDataFrame([(2, ["i64"]), (3, ["u64"]), (3, ["u64"])], "source_id bigint, kinds array<string>"))
    assert {r["source_id"]: r["kinds"] for r in store.sources().collect()} == {1: ["f64"], 2: ["bytes"], 3: ["u64"]}


def test_log(spark):
    topic = FolderLog(spark, scratch_path(spark, "topic"), 3)
    assert topic.read().count() == 0
    moved = topic.append(spark.createDataFrame([(k, bytearray(bytes([k]) * k)) for k in range(10)], "k bigint, v binary"), "k", "v")
    assert sum(b - a for a, b in moved.values()) == 10
    more = topic.append(spark.createDataFrame([(1, bytearray(b"later"))], "k bigint, v binary"), "k", "v")
    assert more == {1: (moved[1][1], moved[1][1] + 1)}
    assert [bytes(r["value"]) for r in topic.read(more).collect()] == [b"later"]
    parts = spark.createDataFrame([(bytearray(b"abcdefg"),), (bytearray(),)], "v binary").select(chunks(F.col("v"), 3).alias("c")).collect()
    assert [[bytes(x["part"]) for x in r["c"]] for r in parts] == [[b"abc", b"def", b"g"], [b""]]


def test_log_messages_come_back_whole(spark):
    rows = [(k % 5, bytearray("aé語😀".encode() * k + bytes([n]))) for k in range(12) for n in (1, 2)] + [(1, bytearray(b"same" * 9)), (1, bytearray(b"same" * 9)), (2, bytearray())]
    topic = FolderLog(spark, scratch_path(spark, "topic"), 3, size=7)
    moved = [topic.append(spark.createDataFrame(part, "k bigint, v binary"), "k", "v") for part in (rows[:14], rows[14:])]
    every = lambda df: sorted((r["key"], bytes(r["value"])) for r in df.collect())
    assert every(topic.messages()) == sorted((k, bytes(v)) for k, v in rows)
    assert topic.read().where("chunk > 0").count() > len(rows)
    assert [r["offset"] for r in topic.read({0: (0, 10**9)}).orderBy("offset").collect()] == list(range(topic.ends()[0]))
    assert every(topic.messages(moved[1])) == sorted((k, bytes(v)) for k, v in rows[14:])
    one = topic.read().where("n_chunks > 2 and chunk = 1").first()
    cut = {one["topic_partition"]: (one["offset"], one["offset"] + 1)}
    assert [len(r["value"]) > 14 for r in topic.messages(cut).collect()] == [True]
    lost = FolderLog(spark, scratch_path(spark, "lost"), 3, size=7)
    topic.read().where(~((F.col("topic_partition") == one["topic_partition"]) & (F.col("offset") == one["offset"]))).write.parquet(lost.path)
    with pytest.raises(Exception, match="chunks lost"):
        lost.messages().collect()


def test_log_roundtrip_of_long_texts(spark, tmp_path):
    from tidemark.plans import catalog

    text = "é😀" * 400_000  # 2.4 MB, more than one message holds
    spark.createDataFrame([(1, 0, text), (1, 1, "a"), (1, 2, None), (2, 0, "")], "conv_id bigint, turn bigint, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {(r["key"], r["seq"]): r["body"] for r in catalog.log_roundtrip(spark, str(tmp_path)).collect()}
    assert found == {(1, 0): text, (1, 1): "a", (2, 0): ""}


def test_kafka_options(spark):
    assert has_kafka(spark) in (True, False)
    options = kafka_options("h:1", "t", {0: (3, 9)})
    assert options["startingOffsets"] == '{"t": {"0": 3}}' and options["endingOffsets"] == '{"t": {"0": 9}}' and options["kafka.acks"] == "all"
    assert kafka_options("h:1", "t")["startingOffsets"] == "latest"


def test_delta_encoding_saves(spark):
    from tidemark.sources import codecs

    df = spark.range(20_000).select(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000 + F.pmod(F.xxhash64("id"), F.lit(100))).alias("ts"))
    sizes = {r["encoding"]: r["bytes_per_row"] for r in codecs.compare(df.coalesce(1), ("delta_lz4", "lz4"))}
    assert sizes["delta_lz4"] < 0.6 * sizes["lz4"]


def test_ask_reports_latencies(spark, store):
    store.append(made(spark, [(1, k, k, 1, b"") for k in range(20)]))
    got = store.ask(1, F.lit(at(5)), F.lit(at(15)), at(10), timeout_s=5)
    assert got.rows == 10 and got.total_latency_s >= got.execution_latency_s > 0


def test_http_receiver():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tidemark.sources.bulk import HttpReceiver

    seen, answers = [], [429, 200]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(answers.pop(0))
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = BulkClient(HttpReceiver(f"http://127.0.0.1:{server.server_port}", "i", "u", "p"), batch_bytes=5, sleep=lambda s: None)
        assert client.ingest('{"a":1}')
        assert len(seen) == 2 and seen[0][0] == "Basic dTpw" and seen[1][1] == b'{"index": {"_index": "i"}}\n{"a":1}\n'
    finally:
        server.shutdown()


def test_index_table(spark):
    from tidemark.sources.bulk import create_index

    create_index(spark, "documents_index", 4)
    try:
        spark.createDataFrame([("1", 2, ["a"])], "series_id string, timestamp bigint, data array<string>").write.mode("append").insertInto("documents_index")
        assert spark.table("documents_index").where("series_id = '1'").count() == 1
    finally:
        spark.sql("drop table documents_index")


def test_bulk(spark, tmp_path):
    class Receiver:
        def __init__(self, busy):
            self.busy, self.got = busy, []

        def send(self, documents):
            if self.busy:
                self.busy -= 1
                return BUSY
            self.got.append(list(documents))
            return 200

    slept = []
    r = Receiver(2)
    c = BulkClient(r, batch_bytes=10, sleep=slept.append)
    assert [c.ingest(x) for x in ("12345", "67890", "1")] == [False, True, False]
    assert c.flush() and not c.flush() and len(slept) == 2 and r.got == [["12345", "67890"], ["1"]] and c.sent == 3
    with pytest.raises(BulkError):
        c = BulkClient(Receiver(9), batch_bytes=1, sleep=slept.append)
        c.ingest("x")
    folder = str(tmp_path / "bulk")
    write_bulk(spark.range(25).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document")), lambda: FolderReceiver(folder), batch_bytes=20)
    lines = [x for p in (tmp_path / "bulk").iterdir() for x in p.read_text().split()]
    assert sorted(lines) == sorted(f"d{k}" for k in range(25))
