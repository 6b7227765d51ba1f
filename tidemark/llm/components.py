"""Connected components of a graph given as a table of links, by alternating large and small stars.

Rounds of grouping and joining shrink every component to a star around its smallest node. No list of
links or nodes comes to the driver; each round is written to the shared folder, so that a lost executor
costs one round. The hubs of the stars are split over SALTS partitions in each join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize

SALTS = 32


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with m of least (u, m), a hub's links spread by salt."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).drop("salt")


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a smaller node in its component; component is the
    component's smallest node. Links with a null end and loops are ignored; repeated and reversed links
    count once; without links the result is empty. An error is raised if most_rounds do not settle it; each
    round about halves the longest way to a smallest node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    edges = materialize(edges, "links")
    seen = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = _with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = materialize(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(edges, large)
        edges = smaller
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def least_members(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, least): for each node of links (a, b) the least value of its component, from firsts (node, first)."""
    named = components(links)
    named = named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
    named = materialize(named.join(firsts, "node"), "component-members")
    least = materialize(named.groupBy("component").agg(F.min("first").alias("least")), "component-least")
    out = materialize(named.select("node", "component").join(least, "component").select("node", "least"), "component-named")
    discard(named, least)
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member's index of each of n nodes' components, for links i-j within one task."""
    label = np.arange(n)
    if not len(i):
        return label
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
