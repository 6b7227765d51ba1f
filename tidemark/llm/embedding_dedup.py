"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one class first. Centroids are fitted on a bounded sample, and each vector belongs to the cell
of the centroid nearest by angle; vectors of one cell are compared. A pair near a border may lie in two cells,
so the space is cut into cells anew, from other parts of the sample, until of pairs of exactly the least cosine,
turned from sampled vectors (not those fitted on) towards their nearest, and of those turned towards any others,
the share RECALL has met in some run. Near copies in the sample count once, since a centroid that a dense group
gets in every run would part its border always alike. A pair counts in the first run in which it meets. Cells hold PER_CELL vectors on average at
any size: where one clustering would need more than LEVEL centroids, a cell is a cell of each of several
clusterings. So a vector has as many copies as there are runs, and work grows with the rows and the runs. A
table no larger than the sample has one cell and is compared exactly.

Within a cell the products of blocks with blocks are taken in double precision; a task returns numbers of links
and a spanning forest, never pairs. The smallest id of a component stays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, shuffle_partitions, sorted_groups
from tidemark.llm.components import forest, least_members

COSINE, RECALL = 0.9, 0.9995
#: Vectors fitted on at most, lengths with cells of their own, vectors a cell should have, centroids of one
#: clustering at most, rounds of fitting, rows of a block.
SAMPLE_ROWS, LENGTHS, PER_CELL, LEVEL, ROUNDS, BLOCK = 8192, 64, 400, 256, 2, 512
#: Sampled vectors that turns are tried from, and how many towards near and towards other ones.
PROBES, TOWARDS = 1024, 4
#: Runs at most; where they do not suffice, cells are made fewer.
MOST_RUNS = 64


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows x, fitted on 8 k of them; empty cells take the rows that fit worst."""
    x = x[np.random.default_rng(seed).permutation(len(x))[: 8 * k]]
    c = x[:k].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        size = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        new[empty] = x[s.max(axis=1).argsort()[: len(empty)]]
        size[empty] = 1
        c = new / size[:, None]
    return c


def turned_pairs(x: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of exactly the least cosine: unit rows of x, and these turned to both sides of their nearest rows;
    then the same with any other rows."""
    rng = np.random.default_rng(0)
    own = rng.permutation(len(x))[:PROBES]
    near = np.concatenate([(x[rows] @ x.T).argsort(axis=1)[:, -TOWARDS - 1 :] for rows in np.array_split(own, 8)])
    out = []
    for to in (near, rng.integers(0, len(x), (len(own), TOWARDS))):
        start, target = np.repeat(x[own], to.shape[1], axis=0), x[to.ravel()]
        turn = target - (target * start).sum(axis=1)[:, None] * start
        size = np.linalg.norm(turn, axis=1)
        start, turn = start[size > 1e-6], turn[size > 1e-6] / size[size > 1e-6, None]
        ends = [cosine * start + sign * math.sqrt(1 - cosine * cosine) * turn for sign in (1, -1)]
        out.append((np.concatenate([start, start]), np.concatenate(ends)))
    return out


def cells_of(x: np.ndarray, runs: list[list[np.ndarray]]) -> np.ndarray:
    """Cell of each unit row of x in each run; a run is a list of clusterings."""
    out = np.zeros((len(x), len(runs)), dtype=np.int64)
    for r, levels in enumerate(runs):
        for c in levels:
            out[:, r] = out[:, r] * len(c) + (x @ c.T).argmax(axis=1)
    return out


def fit_runs(x: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL) -> list[list[np.ndarray]]:
    """Runs of clusterings for n unit vectors like the sample x: fitted on one half, tried on the other."""
    if n <= len(x) or recall >= 1:
        return [[x[:1]]]
    half, pairs = x[::2], turned_pairs(x[1::2], cosine)
    first = np.concatenate([(rows @ half.T >= cosine).argmax(axis=1) for rows in np.array_split(half, 8)])
    half = half[first == np.arange(len(half))]
    cells = n / PER_CELL
    while cells > 1 and len(half) >= 16:
        levels = max(1, math.ceil(math.log(cells) / math.log(LEVEL)))
        k = max(2, min(round(cells ** (1 / levels)), len(half) // 8))
        runs, apart = [], [np.ones(len(start), dtype=bool) for start, _ in pairs]
        while len(runs) < MOST_RUNS:
            runs.append([spherical_kmeans(half, k, seed=len(runs) * levels + j) for j in range(levels)])
            for a, (start, end) in zip(apart, pairs):
                a &= cells_of(start, runs[-1:])[:, 0] != cells_of(end, runs[-1:])[:, 0]
            missed = max((a.mean() for a in apart if len(a)), default=0)
            if missed <= 1 - recall:
                return runs
            if len(runs) == 4 and missed ** (MOST_RUNS / 4) > 1 - recall:
                break  # MOST_RUNS will not do either
        cells = min(cells, float(k) ** levels) / 2
    return [[x[:1]]]


def _compare(cosine: float):
    """Pairs of blocks of a cell, sorted by task, to links: rows (a, b, n): a and b hang together, a has n
    other vectors linked that it has not met in an earlier run."""

    def run(batches):
        for group in sorted_groups(batches, "task"):
            if len(group) < 2:
                continue
            side, before = group["side"].to_numpy(), int(group["run"].iat[0])
            same = not (side == 1).any() or not (side == 0).any()
            parts = [group] if same else [group[side == 0], group[side == 1]]
            units = [np.frombuffer(b"".join(p["unit"])).reshape(len(p), -1) for p in parts]
            cells = [np.frombuffer(b"".join(p["cells"]), dtype=np.int64).reshape(len(p), -1)[:, :before] for p in parts]
            own, copies = [p["class"].to_numpy() for p in parts], [p["copies"].to_numpy() for p in parts]
            linked = units[0] @ units[-1].T >= cosine
            if same:
                np.fill_diagonal(linked, False)
            i, j = linked.nonzero()
            if not len(i):
                continue
            for lo in range(0, len(i) if before else 0, 1 << 16):
                p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                met = (cells[0][p] == cells[-1][q]).any(axis=1)
                linked[p[met], q[met]] = False
            i, j = linked.nonzero()
            n = np.concatenate([linked @ copies[-1], linked.T @ copies[0]][: len(parts)]).astype(np.int64)
            both = np.concatenate(own)
            root = forest(len(both), i, j if same else j + len(own[0]))
            some = n > 0
            yield pd.DataFrame({"a": both[some], "b": both[root[some]], "n": n[some]})

    return run


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of df.

    n_links counts the other rows of cosine at or above the threshold (which must be positive); the
    component is the smallest id that links lead to. Vectors that are null, empty, zero, or hold a null, NaN
    or infinite component link with nothing and stay, so do rows with a null id (their component is null).
    Vectors of different lengths never link; beyond the LENGTHS commonest lengths, all vectors of one length
    are compared. Ids may be numbers or text, and may repeat: each row counts for its own vector. With recall
    1 all vectors are compared. Other columns are left out, so their names do not matter.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.when(good, v).alias("v"))

    def digest(batches):
        import xxhash

        for pdf in batches:
            keys, units = [], []
            for x in pdf["v"]:
                if x is None:
                    keys.append(None)
                    units.append(None)
                    continue
                a = np.asarray(x, dtype=np.float64) + 0.0
                keys.append(xxhash.xxh3_128_digest(a.tobytes()))
                a = a / np.abs(a).max()
                units.append((a / np.linalg.norm(a)).tobytes())
            yield pd.DataFrame({"i": pdf["i"], "key": keys, "unit": units})

    digests = rows.mapInPandas(digest, "i string, key binary, unit binary").select(F.col("i").cast(kind).alias("id"), "key", "unit")
    digests = materialize(digests, "vector-digests")
    classes = digests.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")

    length = F.octet_length("unit")
    counts = {r["length"]: r["n"] for r in classes.groupBy(length.alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(LENGTHS).collect()}
    runs = {}
    if counts:
        places = F.row_number().over(Window.partitionBy("length").orderBy(F.xxhash64("key"), "key"))
        sampled = classes.select(length.alias("length"), "key", "unit").where(F.col("length").isin(list(counts))).withColumn("place", places).where(F.col("place") <= SAMPLE_ROWS // len(counts))
        found: dict[int, list[np.ndarray]] = {}
        for r in sampled.select("length", "unit").collect():  # SAMPLE_ROWS vectors at most
            found.setdefault(r["length"], []).append(np.frombuffer(r["unit"]))
        runs = {k: fit_runs(np.array(x), counts[k], cosine, recall) for k, x in found.items()}
    sent = spark.sparkContext.broadcast(runs)  # LEVEL centroids a clustering at most; bounded by MOST_RUNS, not by the rows

    def assign(batches):
        for pdf in batches:
            lengths = pdf["unit"].map(len).to_numpy()
            for k in np.unique(lengths):
                part = pdf[lengths == k]
                x = np.frombuffer(b"".join(part["unit"])).reshape(len(part), -1)
                own = sent.value.get(int(k), [[]])
                cells = cells_of(x, own) + ((int(k) * MOST_RUNS + np.arange(len(own))) << 32)
                yield pd.DataFrame({"class": part["class"].to_numpy(), "copies": part["copies"].to_numpy(), "places": list(cells), "cells": [c.tobytes() for c in cells], "unit": part["unit"].to_numpy()})

    placed = classes.select("class", "copies", "unit").mapInPandas(assign, "class bigint, copies bigint, places array<bigint>, cells binary, unit binary")
    placed = materialize(placed, "vector-cells")
    each = placed.select("class", F.posexplode("places").alias("run", "cell"))
    sizes = each.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    # Members of a cell of several blocks meet its size in 16 parts.
    spread = materialize(sizes.withColumn("salt", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(-1))))), "vector-cell-sizes")
    one = each.join(spread.where("salt < 0").select("cell", "blocks"), "cell")
    more = each.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(16)).cast("int")).join(spread.where("salt >= 0").select("cell", "salt", "blocks"), ["cell", "salt"]).drop("salt")
    dealt = one.unionByName(more).withColumn("block", F.pmod(F.xxhash64("class", F.lit(5)), F.col("blocks")).cast("int"))
    # Block k meets every block: as side 0 those from k on, as side 1 those before.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("task"), (F.col("other") < F.col("block")).cast("int").alias("side"), "run", "class")
    tasks = tasks.join(placed.select("class", "copies", "cells", "unit"), "class")
    found_links = tasks.repartition(shuffle_partitions(spark), "task").sortWithinPartitions("task").mapInPandas(_compare(cosine), "a bigint, b bigint, n bigint")
    found_links = materialize(found_links, "vector-links")
    links = found_links.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    least = least_members(found_links.where("a <> b"), classes.select(F.col("class").alias("node"), "first"))
    described = classes.select("key", "class", "first", "copies").join(links, "class", "left").join(least.withColumnRenamed("node", "class"), "class", "left")
    described = described.select("key", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("least", "first").alias("component"))
    described = materialize(described, "vector-classes-described")
    discard(classes, placed, spread, found_links, least)
    out = digests.select("id", "key").join(described, "key", "left")
    bare = df.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast(kind).alias("component_id"), F.lit(True).alias("kept"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    ).unionByName(bare)
