"""Connected components of a link table by alternating star contractions, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def _least(links: DataFrame) -> DataFrame:
    """(u, m) for each u of links (u, v): m is the least of u and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links between longs -> (node, root): every node of a link with the least node it reaches.

    Large-star and small-star steps alternate until the edge set no longer changes. Minima are pre-aggregated
    before each shuffle, and the join that hands them back has a plain equality key, which adaptive execution splits
    where a node has very many links. Nulls and loops are ignored; no links give no rows.
    """
    now = edges.where("u is not null and v is not null and u != v").select("u", "v").distinct()
    now = written(now, "links")
    before = None
    while (sign := _signature(now)) != before and sign[0]:
        before = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = written(large.distinct(), "large")
        least = _least(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
