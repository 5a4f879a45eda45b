"""Connected components of a graph held in DataFrames.

Alternating large-star and small-star rounds: every round is a partial
aggregate per node and a join back, so a node with very many links is reduced
map-side before the shuffle and the join on it can be split by the adaptive
skew handling.  Neither nodes nor links ever come to the driver; only a count
and a checksum of the links do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiprisk.llm.common import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node (the larger ones, or the smaller) to its least neighbour."""
    if large:
        seen = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of sortable ids -> (node, root), root the least id reachable.

    Nodes without links don't occur.  Null ends and loops are ignored; an
    empty graph gives an empty result.
    """
    links = materialise(
        links.select("u", "v").filter("u is not null and v is not null and u <> v").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = materialise(_star(_star(links, True), False), "links")
        after = _mark(links)
        if after == mark:
            break
        mark = after
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
