"""Trees from parent keys: paths, depths, roots, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.staging import table


def paths(nodes: DataFrame, key: str, parent: str, name: str, separator: str = "/", deepest: int = 256) -> DataFrame:
    """(key, path, depth) by doubling: after k joins each node knows its 2^k nearest ancestors. Roots have a null parent or themselves.

    Nodes on or below a cycle, below a missing parent, or deeper than `deepest` have a null path. Each round is a written table:
    its plan would hold the one before twice."""
    at = nodes.select(F.col(key).alias("key"), F.when(F.col(parent) != F.col(key), F.col(parent)).alias("up"), F.col(name).alias("path"))
    at = table(at, "tree")
    known = at.select(F.col("key").alias("_k")).distinct()
    at = at.join(known, F.col("up") == F.col("_k"), "left").select(
        "key",
        F.col("_k").alias("up"),
        "path",
        F.when(F.col("_k").isNotNull(), F.lit(1)).otherwise(0).cast("long").alias("depth"),
        (F.col("up").isNotNull() & F.col("_k").isNull()).alias("lost"),
    )
    for _ in range(deepest.bit_length()):
        at = table(at, "tree")
        if at.where("up is not null").isEmpty():
            break
        above = at.select(F.col("key").alias("_key"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("lost").alias("_lost"))
        deep = F.coalesce(F.col("_depth") + F.col("depth") > deepest, F.lit(False))
        at = at.join(above, F.col("up") == F.col("_key"), "left").select(
            "key",
            F.when(~deep, F.col("_up")).alias("up"),
            F.coalesce(F.concat("_path", F.lit(separator), "path"), "path").alias("path"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            (F.col("lost") | F.coalesce("_lost", F.lit(False)) | deep).alias("lost"),
        )
    good = ~F.col("lost") & F.col("up").isNull()
    return at.select("key", F.when(good, F.col("path")).alias("path"), F.when(good, F.col("depth")).alias("depth"))


def roots(nodes: DataFrame, keys: list[str], key: str, parent: str) -> DataFrame:
    """The number of roots of each scope; a tree has one."""
    root = F.col(parent).isNull() | (F.col(parent) == F.col(key))
    return nodes.groupBy(*keys).agg(F.count_if(root).cast("long").alias("roots"))
