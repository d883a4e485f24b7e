"""Uniqueness, renaming of collisions, unions in order, subset checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: Column, out: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key.alias(out)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rename_collisions(rows: DataFrame, keys: list[str], name: str, order: list[str], renamed: Column, out: str) -> DataFrame:
    """The first row of a name keeps it, by case-insensitive comparison; the others get renamed (over column `nth`, from 2)."""
    nth = F.row_number().over(Window.partitionBy(*keys, F.lower(name)).orderBy(*order)).cast("long")
    return rows.withColumn("nth", nth).withColumn(out, F.when(F.col("nth") == 1, F.col(name)).otherwise(renamed)).drop("nth")


def suffix_collisions(rows: DataFrame, keys: list[str], name: str, order: list[str], suffix: str, out: str) -> DataFrame:
    """name, name with suffix-2 before its extension, and so on. A candidate that another row bears by itself is passed over.

    The numbers that a name's rows may take are those whose candidate is free: with n rows and m taken candidates they lie
    below n + m + 2, so that the n-th free one comes from a rank over at most that many."""
    lower = F.lower(name)
    nth = F.row_number().over(Window.partitionBy(*keys, lower).orderBy(*order)).cast("long")
    numbered = rows.withColumn("_nth", nth).withColumn("_key", lower)
    stem = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1)
    ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    candidate = lambda k: F.concat(stem, F.lit(suffix), k.cast("string"), ext)
    # Declared names of the form stem-suffix-k.ext block k for stem.ext.
    form = rf"^(.*){suffix.replace('.', chr(92) + '.')}([1-9][0-9]{{0,8}})((?:\.[^./]*)?)$"
    declared = rows.select(*keys, lower.alias("_name")).where(F.col("_name").rlike(form)).distinct()
    blocked = declared.select(*keys, F.concat(F.regexp_extract("_name", form, 1), F.regexp_extract("_name", form, 3)).alias("_key"), F.regexp_extract("_name", form, 2).cast("long").alias("_k"))
    taken = blocked.groupBy(*keys, "_key").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    # The (nth - 1)-th number from 2 on that is not taken.
    step = lambda at, k: F.when(k <= at, at + 1).otherwise(at)
    number = F.aggregate(F.filter(F.coalesce("_taken", F.array().cast("array<bigint>")), lambda k: k >= 2), F.col("_nth"), step)
    out_name = F.when(F.col("_nth") == 1, F.col(name)).otherwise(candidate(number))
    return numbered.join(taken, [*keys, "_key"], "left").withColumn(out, out_name).drop("_nth", "_key", "_taken")


def ordinal_names(rows: DataFrame, keys: list[str], name: str, index: str, out: str) -> DataFrame:
    """The first row of a name keeps it, by case-insensitive comparison; another gets file_NNNN from its index (unique in its scope), or the
    first of file_NNNN_1, file_NNNN_2, ... that no row declares."""
    lower = F.lower(name)
    nth = F.row_number().over(Window.partitionBy(*keys, lower).orderBy(index))
    base = F.format_string("file_%04d", index)
    form = "^(file_[0-9]{4,})(?:_([1-9][0-9]{0,8}))?$"
    declared = rows.select(*keys, lower.alias("_name")).where(F.col("_name").rlike(form)).distinct()
    blocked = declared.select(*keys, F.regexp_extract("_name", form, 1).alias("_base"), F.coalesce(F.nullif(F.regexp_extract("_name", form, 2), F.lit("")).cast("long"), F.lit(0)).alias("_k"))
    taken = blocked.groupBy(*keys, "_base").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda at, k: F.when(k == at, at + 1).otherwise(at))
    other = F.when(free == 0, F.col("_base")).otherwise(F.concat_ws("_", "_base", free))
    numbered = rows.withColumns({"_nth": nth, "_base": base})
    return numbered.join(taken, [*keys, "_base"], "left").withColumn(out, F.when(F.col("_nth") == 1, F.col(name)).otherwise(other)).drop("_nth", "_base", "_taken")


def without_duplicates(rows: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """Rows of the scopes in which no key occurs twice; the others lose all their rows."""
    twice = rows.groupBy(*keys, key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).distinct()
    return rows.join(twice, keys, "left_anti")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """All rows, with source_order: the place of their part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_order", F.lit(i).cast("long"))
        out = p if out is None else out.unionByName(p)
    return out


def not_subset(part: DataFrame, whole: DataFrame, column: str) -> DataFrame:
    """Values of part that whole lacks, once each; null is a value."""
    return part.select(column).distinct().join(whole.select(F.col(column).alias("_w")), F.col(column).eqNullSafe(F.col("_w")), "left_anti")


def same_set(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: whether both have the same values."""
    rest = not_subset(a, b, column).unionByName(not_subset(b, a, column))
    return rest.agg((F.count(F.lit(1)) == 0).alias("same"))
