"""Connected components on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved


#: Edges that one task joins at once.
EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes under links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label != label[label]).any():
        label = label[label]
    return label


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) as stars: each node with the smallest one that it reaches over at most EDGES edges (and those of a batch)."""

    def joined(held: list[pd.DataFrame]) -> pd.DataFrame:
        e = pd.concat(held, ignore_index=True)
        at, names = pd.factorize(pd.concat([e["u"], e["v"]], ignore_index=True), sort=True)
        root = forest(at[: len(e)], at[len(e) :], len(names))
        i = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"u": names[i], "v": names[root[i]]})

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n > EDGES:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of edges; root is the smallest node reachable.

    Tasks first join the edges they hold into stars. Up to EDGES edges lie in one task, and that is the answer. More are
    joined by alternating large-star and small-star steps (Kiveris et al., 2014): each is a
    partial aggregation and a join back, edges never grow beyond their first number,
    and the number of rounds grows with the logarithm of the longest chain. Each round
    is a saved table; nothing is collected but a count and a checksum. Self-loops keep
    a lone node; null nodes don't take part.
    """
    a, b = F.col(u).alias("u"), F.col(v).alias("v")
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(a, b)
    nodes = saved(e.select("u").union(e.select("v")).distinct().withColumnRenamed("u", "node"), "cc-nodes")
    now = saved(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    kind = dict(now.dtypes)["u"]
    few = now.count() <= EDGES
    held, now = now, saved((now.coalesce(1) if few else now).mapInPandas(stars, f"u {kind}, v {kind}"), "cc-stars")
    drop(held)
    mark = None
    while not few:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = large.where("u > v").distinct()
        up = saved(up, "cc-large")
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now, up)
        now = new
        if got == mark:
            break
        mark = got
    root = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
