"""Payloads out: decoded under a size limit, verified with built-in hashes, written by Spark's committed tasks."""

from __future__ import annotations

import bz2
import lzma
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Methods that the standard library decodes; what a decoded payload may have at most.
METHODS = ("store", "zlib", "deflate", "bzip2", "lzma")
LARGEST = 256 << 20


def decode_bytes(method: str, data: bytes, most: int = LARGEST) -> bytes | None:
    """The decoded bytes; None where the data are bad, cut short or decode to more than `most`."""
    if method == "store":
        return data if len(data) <= most else None
    make = {"zlib": zlib.decompressobj, "deflate": lambda: zlib.decompressobj(-15), "bzip2": bz2.BZ2Decompressor, "lzma": lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE)}
    try:
        d = make[method]()
        out = d.decompress(data, most + 1)
    except (KeyError, zlib.error, OSError, lzma.LZMAError, EOFError):
        return None
    # An alone stream of known size ends without a mark.
    return out if len(out) <= most and (d.eof or method == "lzma" and not d.needs_input) else None


@F.pandas_udf(BinaryType())
def decoded(method: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([None if m is None or b is None else decode_bytes(m, b) for m, b in zip(method, data, strict=True)], dtype=object)


def checksum_of(data: Column, kind: Column) -> Column:
    """Hex digest of the kind named (MD5, SHA1, SHA256), null for others."""
    return F.when(kind == "MD5", F.md5(data)).when(kind == "SHA1", F.sha1(data)).when(kind == "SHA256", F.sha2(data, 256))


def verified(payloads: DataFrame, check_crc: bool = True) -> DataFrame:
    """payloads (.., data, result_crc, checksum, checksum_type, uncompressed_size) with crc_ok, checksum_ok, size_ok and error.

    A CRC that is not given or not asked for is right; a checksum must have a type that goes with it."""
    data = F.col("data")
    crc = F.coalesce(F.crc32(data) == F.col("result_crc"), F.col("result_crc").isNull()) if check_crc else F.lit(True)
    given = F.col("checksum").isNotNull() | F.col("checksum_type").isNotNull()
    right = F.coalesce(checksum_of(data, F.col("checksum_type")) == F.lower("checksum"), F.lit(False))
    out = payloads.withColumns({"crc_ok": crc, "checksum_ok": ~given | right, "size_ok": F.coalesce(F.length(data) == F.col("uncompressed_size"), F.lit(False))})
    error = F.when(data.isNull(), "not decoded").when(~F.col("size_ok"), "size differs").when(~F.col("crc_ok"), "CRC differs").when(~F.col("checksum_ok"), "checksum differs")
    return out.withColumn("error", error)


def write(payloads: DataFrame, path: str, partitions: list[str] = ("format",)) -> None:
    """Rows without an error as Parquet. A failed task leaves nothing; a rerun replaces what is there."""
    payloads.where("error is null").write.mode("overwrite").partitionBy(*partitions).parquet(path)
