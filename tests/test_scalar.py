import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_zigzag(spark):
    values = [0, -1, 1, -2, 2, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", scalar.zigzag("v").alias("z"))
    rows = df.select("v", "z", scalar.unzigzag("z").alias("back")).collect()
    assert all(r["v"] == r["back"] for r in rows)
    assert [r["z"] for r in rows[:5]] == [0, 1, 2, 3, 4]


def test_time(spark):
    r = one(spark, scalar.rfc3339_millis(F.lit("2024-01-02T03:04:05.678Z")).alias("a"), scalar.rfc3339_millis(F.lit("no time")).alias("b"), scalar.nanos(F.lit("1700000000000000999")).alias("c"), scalar.nanos(F.lit("x")).alias("d"))
    assert r["a"] == 1704164645678 and r["b"] is None and r["c"] == 1700000000000000999 and r["d"] is None
    r = one(spark, scalar.micros(scalar.nanos_to_timestamp(F.lit(1700000000000000999).cast("bigint"))).alias("a"), scalar.micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("b"))
    assert r["a"] == 1700000000000000 and r["b"] == 1704067200000000


def test_ranges():
    assert scalar.range_before(100_000_000, 3, 10) == (87_000_000, 97_000_000)
    rng = random.Random(10)
    for _ in range(50):
        a, b = scalar.random_range(10**9, rng)
        assert 10_000_000 <= b - a < 60_000_000 and 3_000_000 <= 10**9 - b < 10_000_000


def test_big_endian(spark):
    cells = [("i64", ">q", -5), ("i64", ">q", 2**62), ("u64", ">Q", 2**64 - 1), ("f64", ">d", 1.5), ("f64", ">d", -0.1), ("f64", ">d", 5e-324), ("f64", ">d", float("inf")), ("f64", ">d", 0.0)]
    for kind, form, value in cells:
        got = one(spark, scalar.big_endian(F.lit(bytearray(struct.pack(form, value))), kind).alias("x"))["x"]
        assert got == value, (kind, value, got)
    with pytest.raises(ValueError):
        scalar.big_endian(F.lit(b"12345678"), "text")


def test_typed_access(spark):
    v = F.parse_json(F.lit('{"Float": 1.5}'))
    r = one(spark, scalar.as_f64(v).alias("f"), scalar.as_i64(v, strict=False).alias("i"), scalar.as_text(v, strict=False).alias("t"))
    assert (r["f"], r["i"], r["t"]) == (1.5, None, None)
    u = F.parse_json(F.lit('{"Uint": 18446744073709551615}'))
    assert int(one(spark, scalar.as_u64(u).alias("u"))["u"]) == 2**64 - 1
    with pytest.raises(Exception):
        one(spark, scalar.as_i64(F.parse_json(F.lit('{"Int": "x"}'))).alias("i"))


def test_values(spark):
    r = one(spark, scalar.utf8(F.lit(bytearray(b"\xff\xfe"))).alias("bad"), scalar.utf8(F.lit(bytearray("é".encode()))).alias("good"), scalar.value_size(F.lit("é"), "string").alias("n"), scalar.row_size(F.lit(8), F.lit(3)).alias("row"))
    assert (r["bad"], r["good"], r["n"], r["row"]) == (None, "é", 2, 27)
    assert [one(spark, scalar.quantile_key(F.lit(q).cast("double")).alias("k"))["k"] for q in (None, 0.0, 0.5)] == ["0.0", "0.0", "0.5"]
    assert len(one(spark, scalar.random_text(12, 1).alias("x"))["x"]) == 12
    a = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    b = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, (scalar.attribute_hash(a) == scalar.attribute_hash(b)).alias("x"))["x"]
    assert one(spark, scalar.route(F.lit(-3), 4).alias("x"))["x"] == 1


def test_split_rate(spark):
    for rate, n in ((10, 3), (7, 7), (2, 5), (0, 2)):
        parts = [r[0] for r in spark.range(n).select(scalar.split_rate(F.lit(rate).cast("bigint"), "id", n)).collect()]
        assert sum(parts) == rate and parts[:-1] == [rate // n] * (n - 1)


def test_retries():
    waits = [w for w, _ in zip(scalar.backoff(1, 8, 0), range(5))]
    assert waits == [1, 2, 4, 8, 8]
    calls, slept = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert scalar.retried(action, 4, OSError, sleep=slept.append) == "done" and len(slept) == 2
    with pytest.raises(OSError):
        scalar.retried(lambda: (_ for _ in ()).throw(OSError()), 2, OSError, sleep=slept.append)
