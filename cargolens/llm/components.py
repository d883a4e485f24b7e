"""Connected components of a graph of links, by alternating large and small stars on written tables.

The number of rounds grows with the logarithm of the longest chain; a node's links are never gathered in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: links all greater neighbours of a node to the least of it and its neighbours; small: the lesser ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        new = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.where("a != b").distinct()


def components(edges: DataFrame, table: Callable[[DataFrame, str], DataFrame] = common.table) -> DataFrame:
    """(node, root) for all nodes of edges (a, b) but the roots themselves; root: the least node that is reachable. table: writes the rounds' tables."""
    edges = table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        edges = table(_star(table(_star(edges, True), "large-star"), False), "small-star")
