"""Scalar functions as column expressions, all evaluated in the JVM."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# time


def now_micros() -> Column:
    """Microseconds since the epoch, once per query."""
    return F.unix_micros(F.current_timestamp())


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (without: UTC)."""
    return F.unix_micros(_column(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(_column(us).cast("long"))


def rfc3339_millis(text: Column | str) -> Column:
    """Milliseconds of an RFC 3339 text; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(_column(text)))


def nanos(text: Column | str) -> Column:
    """Nanoseconds from decimal text; null if it is none or does not fit."""
    return _column(text).try_cast("bigint")


def nanos_to_timestamp(ns: Column | str) -> Column:
    """Timestamp of nanoseconds, floored to microseconds."""
    ns, thousand = _column(ns).cast("bigint"), F.lit(1000).cast("bigint")
    return F.timestamp_micros(F.call_function("div", ns, thousand) - (ns % thousand < 0).cast("bigint"))


def range_before(now_us: int, delay_s: float, span_s: float) -> tuple[int, int]:
    """(t_from, t_to) in microseconds of a range that ends delay_s before now and lasts span_s."""
    t_to = int(now_us - delay_s * 1_000_000)
    return int(t_to - span_s * 1_000_000), t_to


def random_range(now_us: int, rng: random.Random, delays: tuple[int, int] = (3, 10), spans: tuple[int, int] = (10, 60)) -> tuple[int, int]:
    """range_before with whole seconds drawn below the upper bounds."""
    return range_before(now_us, rng.randrange(*delays), rng.randrange(*spans))


# integers


def zigzag(v: Column | str) -> Column:
    """Signed to unsigned order: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    v = _column(v)
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column | str) -> Column:
    z = _column(z)
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("bigint")))


def route(source: Column | str, n: int) -> Column:
    """Partition or writer of a source: the id modulo n, never negative."""
    return F.pmod(_column(source), F.lit(n))


def split_rate(rate: Column | str, i: Column | str, n: int) -> Column:
    """Share of generator i of n; the last takes the remainder."""
    rate, i = _column(rate), _column(i)
    return F.floor(rate / n).cast("bigint") + F.when(i == n - 1, F.pmod(rate, F.lit(n))).otherwise(0)


# values


def attribute_hash(attributes: Column | str) -> Column:
    """64-bit id of a map, the same for any order of its keys; Variant values count as their JSON text."""
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(_column(attributes)))))


def variant_hash(attributes: Column | str) -> Column:
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(F.transform_values(_column(attributes), lambda k, v: F.to_json(v))))))


def value_size(value: Column | str, kind: str) -> Column:
    """Bytes of a value: the length of text and bytes, 8 for numbers."""
    return F.octet_length(_column(value)).cast("bigint") if kind in ("string", "binary") else F.lit(8).cast("bigint")


def row_size(*sizes: Column) -> Column:
    """Bytes of a row: its values and 16 for source and time."""
    out = F.lit(16).cast("bigint")
    for s in sizes:
        out = out + s
    return out


def as_i64(v: Column | str, strict: bool = True) -> Column:
    """A tagged value as integer; a value of another kind fails the query, or is null if not strict."""
    return (F.variant_get if strict else F.try_variant_get)(_column(v), "$.Int", "bigint")


def as_u64(v: Column | str, strict: bool = True) -> Column:
    return (F.variant_get if strict else F.try_variant_get)(_column(v), "$.Uint", "decimal(20,0)")


def as_f64(v: Column | str, strict: bool = True) -> Column:
    return (F.variant_get if strict else F.try_variant_get)(_column(v), "$.Float", "double")


def as_text(v: Column | str, strict: bool = True) -> Column:
    return (F.variant_get if strict else F.try_variant_get)(_column(v), "$.String", "string")


def as_bytes(v: Column | str, strict: bool = True) -> Column:
    return F.encode(as_text(v, strict), "UTF-8")


def utf8(b: Column | str) -> Column:
    """Text of UTF-8 bytes; null where they are none."""
    return F.try_validate_utf8(_column(b).cast("string"))


def big_endian(cell: Column | str, kind: str) -> Column:
    """Number in an 8-byte big-endian cell: i64, u64, f64 or timestamp (microseconds)."""
    cell = _column(cell)
    signed = F.conv(F.hex(cell), 16, -10).cast("bigint")
    if kind == "i64":
        return signed
    if kind == "timestamp":
        return F.timestamp_micros(signed)
    if kind == "u64":
        return F.conv(F.hex(cell), 16, 10).cast("decimal(20,0)")
    if kind == "f64":  # sign, exponent and fraction of the IEEE form
        exponent = F.shiftrightunsigned(signed, 52).bitwiseAND(F.lit(2047).cast("bigint"))
        fraction = signed.bitwiseAND(F.lit((1 << 52) - 1).cast("bigint"))
        sign = F.when(signed < 0, F.lit(-1.0)).otherwise(1.0)
        normal = sign * (1 + fraction / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), exponent - 1023)
        small = sign * (fraction / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), F.lit(-1022))
        special = F.when(fraction != 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
        return F.when(exponent == 2047, special).when(exponent == 0, small).otherwise(normal)
    raise ValueError(f"no such kind: {kind}")


def quantile_key(q: Column | str) -> Column:
    """Field name of a quantile; a missing one is 0.0."""
    return F.coalesce(_column(q).cast("double").cast("string"), F.lit("0.0"))


def random_text(length: int, seed: int) -> Column:
    """Random letters and digits."""
    return F.randstr(F.lit(length), F.lit(seed))


# retries


def backoff(first_s: float = 0.1, cap_s: float = 10.0, jitter: float = 0.1, rng: random.Random | None = None) -> Iterator[float]:
    """Waiting times that double up to a cap, each with some jitter on top."""
    rng, wait = rng or random.Random(), first_s
    while True:
        yield min(cap_s, wait) * (1 + jitter * rng.random())
        wait = min(cap_s, wait * 2)


def retried(action: Callable, attempts: int = 4, retry_on: type[Exception] = Exception, waits: Iterator[float] | None = None, sleep: Callable[[float], None] = time.sleep):
    """Result of action, tried again after each failure of the given kind; the last failure is raised."""
    waits = waits or backoff()
    for k in range(attempts):
        try:
            return action()
        except retry_on:
            if k == attempts - 1:
                raise
            sleep(next(waits))
