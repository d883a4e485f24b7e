"""The self-contained setup archive: a signature, `ISDF`, and a table of stored files. Written and read with built-in functions.

Layout after the signature's NUL: magic, u32 count, u64 data offset, then for each file u16 name length, name (UTF-8), u64 offset,
u64 size, u32 CRC-32; numbers are little-endian. A table that ends early keeps the entries before; a range that reaches beyond
the file is cut there, so that only the CRC tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.arrays import fold_rows, let
from cargolens.functions.binary import find, little, take

SIGNATURE = b"Inno Setup Setup Data (5.5.0)\0"
MARK = b"ISDF"
#: Bytes of an entry besides its name; the farthest NUL after a signature.
FIXED, FARTHEST = 22, 256


def packed(value: Column, size: int) -> Column:
    """A number as little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1))))


def build(entries: DataFrame, key: str) -> DataFrame:
    """(key, content): an archive for each key from entries (key, name, data), sorted by name. Keys must be of bounded size."""
    sized = F.struct("name", "data")
    groups = entries.groupBy(key).agg(F.array_sort(F.collect_list(sized)).alias("f"))
    table_size = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + FIXED + F.octet_length(x["name"]))
    start = F.lit(len(SIGNATURE) + 16) + F.col("table_size")

    def add(acc: Column, x: Column) -> Column:
        name, n = F.encode(x["name"], "UTF-8"), F.length(x["data"]).cast("long")
        row = F.concat(packed(F.length(name), 2), name, packed(acc["at"], 8), packed(n, 8), packed(F.crc32(x["data"]), 4))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["table"], row).alias("table"), F.concat(acc["data"], x["data"]).alias("data"))

    begin = F.struct(start.alias("at"), F.lit(bytearray()).alias("table"), F.lit(bytearray()).alias("data"))
    head = F.concat(F.lit(bytearray(SIGNATURE + MARK)), packed(F.size("f"), 4), packed(start, 8))
    return groups.withColumn("table_size", table_size).select(key, F.aggregate("f", begin, add, lambda a: F.concat(head, a["table"], a["data"])).alias("content"))


def records(found: DataFrame) -> DataFrame:
    """(path, format, record_index, stream_offset, stream_size, original_name, .., result_crc) for files (path, content)."""
    c = F.col("content")
    at = F.coalesce(find(c, b"Inno Setup Setup Data"), find(c, b"Inno Setup: Setup Data"))
    nul = find(take(c, F.col("at"), FARTHEST), b"\0")
    table = F.col("at") + F.coalesce(F.col("nul") + 1, F.lit(FARTHEST))
    there = found.select("path", "content", at.alias("at")).where("at is not null").withColumn("nul", nul).withColumn("t", table)
    there = there.where(take(c, F.col("t"), 4) == F.lit(bytearray(MARK)))
    # The bytes from the table on are bound once for each file.
    own_bytes = F.substring("content", (F.col("t") + 17).cast("int"), F.length("content"))
    declared = little(take(c, F.col("t") + 4, 4), 0, 4)
    none = F.array().cast("array<struct<original_name:string,stream_offset:bigint,stream_size:bigint,result_crc:bigint>>")

    def entries(own: Column) -> Column:
        def read(state: Column, _: Column) -> Column:
            p = state["at"]
            body = p + 2 + little(own, p, 2)
            whole = state["good"] & F.coalesce(body + 20 <= F.length(own), F.lit(False))
            entry = lambda b: F.struct(
                F.make_valid_utf8(take(own, p + 2, (b - p - 2).cast("int")).cast("string")).alias("original_name"),
                little(own, b, 8).alias("stream_offset"),
                little(own, b + 8, 8).alias("stream_size"),
                little(own, b + 16, 4).alias("result_crc"),
            )
            after = F.struct(F.when(whole, body + 20).otherwise(p).alias("at"), whole.alias("good"))
            return F.struct(after.alias("state"), F.when(whole, F.array(let(body, entry))).otherwise(none).alias("rows"))

        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("good"))
        most = F.least(declared, F.floor(F.length(own) / FIXED)).cast("int")
        return let(most, lambda n: F.when(n > 0, fold_rows(n, begin, read, none)["rows"]).otherwise(none))

    listed = there.withColumn("entries", let(own_bytes, entries))
    each = listed.select("path", F.posexplode("entries").alias("record_index", "e"))
    return each.select(
        "path", F.lit("inno").alias("format"), "record_index", "e.original_name", "e.stream_offset", "e.stream_size",
        F.col("e.stream_size").alias("compressed_size"), F.col("e.stream_size").alias("uncompressed_size"), "e.result_crc", F.lit(False).alias("is_folder"),
    )


def payloads(found: DataFrame, listed: DataFrame) -> DataFrame:
    """listed with data, crc_ok and size_ok.

    A file's entries are cut together, so that its bytes are taken out of their row once; they are no more than its table holds."""
    rest = [c for c in listed.columns if c != "path"]
    wanted = listed.groupBy("path").agg(F.collect_list(F.struct(*rest)).alias("entries"))

    def cut(content: Column) -> Column:
        # A range beyond the file is cut at its end.
        size = F.length(content)
        piece = lambda e: take(content, F.least(e["stream_offset"], size).cast("int"), F.least(e["stream_size"], size).cast("int"))
        return F.transform("entries", lambda e: F.struct(e.alias("entry"), piece(e).alias("data")))

    each = wanted.join(found.select("path", "content"), "path").select("path", F.explode(let(F.col("content"), cut)).alias("e"))
    joined = each.select("path", "e.entry.*", "e.data")
    return joined.withColumns({"crc_ok": F.coalesce(F.crc32("data") == F.col("result_crc"), F.lit(False)), "size_ok": F.coalesce(F.length("data") == F.col("uncompressed_size"), F.lit(False))})
