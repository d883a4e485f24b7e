"""Registration of queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
