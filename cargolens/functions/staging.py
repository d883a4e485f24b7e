"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary one where it is unset (local sessions; on a cluster that is an error)."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='cargolens-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a later loss of an executor costs no more than the stage at hand."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cargolens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a table() whose tables are removed at the end, for steps of which only a result written inside by the plain one is read later."""
    own = f"scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, name: table(df, f"{own}/{name}")
    finally:
        _remove(spark, own)


def clear(spark: SparkSession) -> None:
    """Removes all staged tables; for when no result that reads them is needed any more."""
    _remove(spark, "")


def _remove(spark: SparkSession, what: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cargolens/{what}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
