"""Encodings of sample files: options for the Parquet writer, and what they cost and save.

Whole numbers and timestamps are delta-encoded where the page version allows it (delta of consecutive values,
bit-packed in blocks), text and bytes by length; pages then go through a block codec. All are lossless.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path, whole_timestamps

#: Options by name: delta encoding with the fastest block codec, the same codec alone, and denser ones.
ENCODINGS = {
    "delta_lz4": {"compression": "lz4_raw", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"},
    "lz4": {"compression": "lz4_raw", "parquet.writer.version": "PARQUET_1_0", "parquet.enable.dictionary": "false"},
    "delta_zstd": {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"},
    "dictionary_snappy": {"compression": "snappy", "parquet.writer.version": "PARQUET_1_0", "parquet.enable.dictionary": "true"},
}


def encode(df: DataFrame, encoding: str, path: str) -> DataFrame:
    """Write df with an encoding and return it as read back."""
    whole_timestamps(df.sparkSession)
    df.write.options(**ENCODINGS[encoding]).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compare(df: DataFrame, encodings: tuple[str, ...] = tuple(ENCODINGS)) -> list[dict]:
    """Bytes a row and rows a second, in and out, of each encoding."""
    spark, n, out = df.sparkSession, df.count(), []
    for name in encodings:
        path = scratch_path(spark, f"encoding-{name}")
        began = time.perf_counter()
        back = encode(df, name, path)
        written = time.perf_counter()
        back.agg(*(F.count(c) for c in df.columns)).collect()
        read = time.perf_counter()
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()
        out.append({"encoding": name, "bytes_per_row": size / max(1, n), "write_rows_per_s": n / (written - began), "read_rows_per_s": n / (read - written)})
    return out
