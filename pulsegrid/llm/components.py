"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every node hands its larger neighbours, then its smaller ones and
    itself, to its smallest neighbour, until each component is a star. Each step moves the edges once or twice, and is written, so
    no lineage grows; only counts come to the driver. A node with many edges is split by adaptive skew joins, as the minima
    that are joined back are a written table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = written(e, "edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-star")
        discard(e, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        hub = large.join(least, F.col("u") == F.col("w"))
        small = hub.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        e = written(small.where("u != v").distinct(), "small-star")
        discard(large, least)
        new = _state(e)
        if new == state:
            break
        state = new
    named = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 32))).first()
    return tuple(r)
