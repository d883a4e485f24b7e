"""What the corpus operators share: tables in the shared folder, workers' import path, row-local text helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargolens.functions.arrays import let, running_sums
from cargolens.functions.staging import scratch, table  # noqa: F401  (all operators take them from here)

REPO = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *have])


def with_fields(df: DataFrame, fields: str) -> StructType:
    """df's schema and further fields (DDL)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def spaced(text: Column) -> Column:
    """The text with blanks for all white space that separates words."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def split_words(text: Column) -> Column:
    """The words of a text, null or blank: none; at a fraction of what a regular expression takes."""
    return F.filter(F.split(spaced(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, word), in code points, end exclusive.

    Splitting at the matches gives what lies between them; running sums of both lengths give the places. A text without a match costs one search."""

    def places(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return let(
            found,
            lambda ms: let(
                running_sums(F.zip_with(F.slice(F.split(t, pattern), 1, F.size(ms)), ms, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))),
                lambda ends: F.zip_with(ms, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("word"))),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,word:string>>")
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), places(text)).otherwise(none)
