"""Helpers that several operators share: shared scratch tables, cleared shuffles, groups in sorted batches."""

from __future__ import annotations

import gc
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors
    cost no more than the reading of a file. What discard() does not delete goes when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of DataFrames that are no longer referenced. Its cleaner acts
    when the JVM collects garbage, which on a large heap may come long after a job has ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(df: DataFrame, id_col: str, columns: dict[str, Column], run, schema: str) -> DataFrame:
    """mapInPandas over (i: the id as text, columns) to rows (i, schema); the id keeps its name and type.
    As text, ids pass through pandas whole even where some are null."""
    kind = df.schema[id_col].dataType
    out = df.select(F.col(id_col).cast("string").alias("i"), *(c.alias(k) for k, c in columns.items())).mapInPandas(run, f"i string, {schema}")
    return out.select(F.col("i").cast(kind).alias(id_col), *out.columns[1:])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo modulus, equals remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def one_of_each(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; only the first of each task is shuffled."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def sorted_groups(batches, key: str):
    """Whole groups of equal key from an iterator of pandas frames that is sorted by key. A group
    may span frames; no more than one group is held beyond a frame."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        k = pdf[key].to_numpy()
        cuts = [0, *((k[1:] != k[:-1]).nonzero()[0] + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield pdf.iloc[lo:hi]
        rest = pdf.iloc[cuts[-1]:]
    if rest is not None:
        yield rest


def whole_groups(batches, key: str):
    """Frames that hold only whole groups of equal key, from an iterator of frames sorted by key. The last
    group of a frame waits for the next one."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        k = pdf[key].to_numpy()
        cut = (k != k[-1]).nonzero()[0]
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:]
    if rest is not None:
        yield rest


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies: TIDEMARK_TOKENIZERS names a folder, else the installed
    package of public tokenizers."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
