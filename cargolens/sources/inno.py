"""The loader's offset table of a setup program: found by its mark, told from decoys by its checksum and its bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.arrays import let
from cargolens.functions.binary import big, find_all, little, take

# The mark, and for each revision the table's size and its fields (offset, size).
MARK = bytes.fromhex("72446C507453CDE6D77B0B2A")
SIZES = {1: 44, 2: 64}
FIELDS = {
    1: {"total_size": (16, 4), "exe_offset": (20, 4), "exe_size": (24, 4), "exe_checksum": (28, 4), "header_offset": (32, 4), "data_offset": (36, 4)},
    2: {"total_size": (16, 8), "exe_offset": (24, 8), "exe_size": (32, 4), "exe_checksum": (36, 4), "header_offset": (40, 8), "data_offset": (48, 8)},
}
RESERVED, HEADER_SIZE = 56, 64


def _table(content: Column, at: Column, revision: int) -> Column:
    """The table at a place as a struct, null if it is none."""
    size = SIZES[revision]

    def read(t: Column) -> Column:
        x = {n: little(t, o, k) for n, (o, k) in FIELDS[revision].items()}
        total, exe, header, data = x["total_size"], x["exe_offset"], x["header_offset"], x["data_offset"]
        whole = (F.length(t) == size) & (little(t, size - 4, 4) == F.crc32(F.substring(t, 1, size - 4)))
        bounds = (total >= at + size) & (total <= F.length(content)) & (x["exe_size"] > 0) & (exe > 0) & (exe < total) & (header > 0) & (header <= exe - HEADER_SIZE) & (data > 0) & (data <= header)
        unused = little(t, RESERVED, 4) == 0 if revision == 2 else F.lit(True)
        return F.when(whole & bounds & unused, F.struct(at.alias("table_offset"), F.lit(revision).alias("revision"), *(v.alias(n) for n, v in x.items())))

    return F.when(big(content, at + 12, 4) == revision, let(take(content, at, size), read))


def offset_tables(files: DataFrame) -> DataFrame:
    """(path, table_offset, revision, ..) of files (path, content): the first valid table of each; files without one have no row."""
    first = let(F.col("content"), lambda c: F.get(F.filter(F.transform(find_all(c, MARK), lambda at: F.coalesce(_table(c, at, 1), _table(c, at, 2))), lambda t: t.isNotNull()), F.lit(0)))
    return files.select("path", first.alias("t")).where("t IS NOT NULL").select("path", "t.*")
