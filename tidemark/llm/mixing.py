"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Documents of a source are shuffled by a hash and queue behind each other, twice over. A document's virtual
finish time is the source's words up to its end divided by the source's target, so at virtual time 1 each
source has been served its target. All queued documents are sorted by finish time over the whole table and
cut where the words taken reach the total budget; a document being served at that moment gives the part
served so far. Running sums are taken in two steps, within buckets and over buckets, so that a source of any
size spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Weights by rank of the source, share of all words to take, times a document may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Documents of a bucket, on average.
BUCKET = 256
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], amount: str, out: str) -> DataFrame:
    """df with the sum of amount over the earlier rows of the same keys (bucket first, then order)."""
    inside = df.withColumn("_own", F.sum(amount).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount))
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    before = sums.withColumn("_before", F.sum("_sum").over(over) - F.col("_sum")).drop("_sum")
    renamed = before.select(*(F.col(k).alias(f"_{k}") for k in (*keys, bucket)), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k in keys else F.col(k) == F.col(f"_{k}") for k in (*keys, bucket)]
    joined = inside.join(renamed, same)
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", *(f"_{k}" for k in (*keys, bucket)))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size) with the target of each: shares of the budget by weight, none above
    ``repeats`` times its size, the excess going to the others by weight.

    Sources are ranked by code point, null last, and weights repeat in that order. The level at which the
    budget runs out is found over the sources sorted by limit per weight (a row a source).
    """
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * float(repeats))
    up = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_budget", F.sum("source_size").over(everything) * share)
    level = (F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    ranked = ranked.withColumn("_full", level >= F.col("_limit") / F.col("_weight"))
    left = F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(everything)
    ranked = ranked.withColumn("_level", F.try_divide(left, open_))
    return ranked.select("source", "source_size", F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_level") * F.col("_weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(sizes, queue): sizes has a row for each row of df, queue one for each time that a row is taken.

    sizes: row (its key), id_col, source, text_hash, size (words; null text: 0), source_size, target. queue: row,
    id_col, copy, size, taken (words, the last of a source in part), finish (virtual time), offset (words
    taken before it), sorted by finish over the whole table. Rows without words are never taken. Rows that
    agree in id and text are ordered by key, which may swap them between runs; all else is the same in each
    run. A null source is a source like any other, null ids and repeated ids stay apart as rows, other
    columns are left out, and an empty table gives two empty tables.
    """
    narrow = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"),
    )
    # The order of the shuffle: 60 bits of an MD5 of id and text, which other engines can compute as well.
    name = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    narrow = narrow.withColumn("at", F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")).drop("text")
    rows = materialize(narrow, "mix-rows")
    bits = max(0, min(20, (rows.count() // BUCKET).bit_length()))  # the sums over buckets are one task's: a million rows at most
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialize(targets(sources, weights, share, repeats), "mix-targets")
    queued = _running(rows.withColumn("bucket", F.shiftright("at", 60 - bits)), ["source"], "bucket", ["at", "row"], "size", "before")
    # A source of any size meets its one row of aims: the row is copied for each salt.
    spread = aims.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    queued = queued.withColumn("salt", F.pmod(F.col("at"), F.lit(64)).cast("int"))
    queued = queued.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt"))).drop("_source", "_salt", "salt", "bucket")
    queued = materialize(queued, "mix-queue")
    sizes = queued.select("row", F.col("id").alias(id_col), "source", "text_hash", "size", "source_size", "target")

    copies = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("start", F.col("before") + F.col("copy") * F.col("source_size"))
    # Served by virtual time 1: at most up to the target of the source.
    copies = copies.withColumn("taken", F.least(F.col("size"), F.floor(F.col("target") - F.col("start") + 1e-6))).where("taken > 0")
    copies = copies.withColumn("finish", F.least(F.lit(1.0), F.try_divide(F.col("start") + F.col("size"), F.col("target"))))
    copies = copies.withColumn("slot", F.least(F.floor(F.col("finish") * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")).withColumn("one", F.lit(0))
    ordered = _running(copies, ["one"], "slot", ["finish", "source", "start", "row", "copy"], "taken", "offset")
    budget = aims.agg(F.coalesce(F.sum("source_size") * share, F.lit(0.0)).alias("words")).first()["words"]
    queue = ordered.where(F.col("offset") < F.lit(budget + 1e-6)).select("row", F.col("id").alias(id_col), "copy", "size", "taken", "finish", "offset")
    return sizes, queue.repartitionByRange("finish", "offset").sortWithinPartitions("finish", "offset")


def mixed_sizes(df: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of df, from the rows of its queue."""
    sizes, queue = mix(df)
    taken = queue.groupBy("row").agg(F.sum("taken").alias("taken"))
    return sizes.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame) -> DataFrame:
    """The rows of df, all columns, as often as the mix takes them (a part of a document counts as once)."""
    sizes, queue = mix(df.select("doc_id", "text", "source"))
    times = sizes.join(queue.groupBy("row").agg(F.count("*").alias("times")), "row", "left")
    keys = ["doc_id", "source", "text_hash"]
    per = times.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum("times").cast("int").alias("_times"), F.count("*").cast("int").alias("_rows")).where("_times > 0")
    joined = df.withColumn("_th", F.xxhash64("text")).join(per, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_th") == F.col("_text_hash")))
    # Rows that agree in all three share what was taken of them.
    nth = F.row_number().over(Window.partitionBy("_th", "doc_id", "source").orderBy("_rows"))
    shared = joined.where("_rows > 1").withColumn("_nth", nth).withColumn("_times", F.expr("int(_times div _rows) + int(_nth <= _times % _rows)")).drop("_nth").where("_times > 0")
    taken = joined.where("_rows = 1").unionByName(shared)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*df.columns)
