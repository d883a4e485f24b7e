"""Files as rows, their siblings, and volumes that continue each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.functions import names

FILE = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each file below a path. Select without content where bytes aren't needed: the source then does not read them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def placed(found: DataFrame) -> DataFrame:
    """Adds directory and name."""
    return found.withColumns({"directory": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", r"([^/]*)$", 1)})


def sibling(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, directory, sibling) with the path of the one file of that name in that directory, compared without case.

    Two files that differ by case only are none: what is ambiguous is not taken."""
    there = placed(found.select("path")).groupBy("directory", F.lower("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("sibling_path"))
    single = there.where("_n = 1").drop("_n")
    return wanted.withColumn("_name", F.lower("sibling")).join(single, ["directory", "_name"], "left").select(*wanted.columns, "sibling_path")


def descendant(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (root, relative) with the path of that file below root; only safe relative paths are looked up."""
    asked = wanted.withColumn("_path", F.when(names.safe_path(F.col("relative")), F.concat("root", F.lit("/"), "relative")))
    return asked.join(found.select(F.col("path").alias("descendant_path")), F.col("_path") == F.col("descendant_path"), "left").drop("_path")


def volume_names(packages: DataFrame) -> DataFrame:
    """packages (.., pattern, volumes) with a row for each numbered volume."""
    return packages.withColumn("volume", F.explode(F.sequence(F.lit(1), F.col("volumes")))).withColumn("volume_name", names.volume_name("pattern", "volume"))


def discovered_volumes(found: DataFrame, packages: DataFrame, pattern: str) -> DataFrame:
    """(package, name, volume, in_order): files (name, package) whose name has the pattern, its group the volume's number, and whose own
    identifier is a package's. in_order: the volumes of the package are numbered 1 to this one."""
    own = found.where(F.col("name").rlike(pattern)).join(packages.select("package"), "package", "left_semi").withColumn("volume", F.regexp_extract("name", pattern, 1).try_cast("long"))
    nth = F.row_number().over(Window.partitionBy("package").orderBy("volume"))
    return own.select("package", "name", "volume", (nth == F.col("volume")).alias("in_order"))


def joined_volumes(volumes: DataFrame, keys: list[str], header: int) -> DataFrame:
    """volumes (keys, volume, package_id, data) put together: headers stripped, in order, complete and of one package.

    A package's volumes are few by its format's own limits, so that one row may hold them."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("volume"))
    numbered = volumes.withColumn("_right", n == F.col("volume"))
    body = F.struct("volume", F.expr(f"substring(data, {header + 1}, length(data))").alias("data"))
    put = numbered.groupBy(*keys).agg(
        F.array_sort(F.collect_list(body)).alias("_parts"), F.bool_and("_right").alias("_right"), (F.count_distinct("package_id") == 1).alias("_one")
    )
    whole = F.aggregate("_parts", F.lit(bytearray()), lambda a, v: F.concat(a, v["data"]))
    error = F.when(~F.col("_right"), "volumes are not numbered 1 to n").when(~F.col("_one"), "volumes of several packages")
    return put.select(*keys, error.alias("error"), F.when(error.isNull(), whole).alias("data"))
