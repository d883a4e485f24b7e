"""Files that arrive: detections of each new file, and counts by format and time of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.sources.detect import detections
from cargolens.sources.files import FILE


def arriving(spark: SparkSession, path: str, at_once: int = 1000) -> DataFrame:
    """A stream of files; a batch has at most so many of them."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(path)


def detected(stream: DataFrame) -> DataFrame:
    """Detections with the file's time; stateless, so that it runs on any trigger."""
    times = stream.select(F.struct("path", "modificationTime").alias("path"), "content")
    return detections(times).select("path.path", "path.modificationTime", "format", "is_valid", "offset", "version")


def counts(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Files by format and window of their time; windows close once the watermark has passed them."""
    return detected(stream).withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "format").agg(F.count(F.lit(1)).alias("n"))
