"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import stored


def components(links: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b), ``label`` the smallest node of its component.

    Each step keeps the number of links at most and points nodes at smaller neighbours; when nothing
    changes every node points at the smallest of its component.  Steps are aggregations and joins on
    the links, each written to ``folder``; a component is never gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = stored(edges, f"{folder}/start")
    before = None
    for k in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                 .unionByName(lows.select("u", F.col("m").alias("v")))).distinct()
        edges = stored(small, f"{folder}/round{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
