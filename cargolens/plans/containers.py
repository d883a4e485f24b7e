"""Queries that write containers from the driver's tables, read them back, and return what was read.

The SQL twin reads the tables: a container is right if its rows come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions import binary
from cargolens.functions.staging import table
from cargolens.plans.base import query, t
from cargolens.sources import isdf, msi, script_text
from cargolens.sources.isdf import packed

#: Documents to an archive.
PER_ARCHIVE = 20


def _archives(spark, d) -> DataFrame:
    docs = t(spark, d, "documents").select(F.concat(F.lit("archive-"), F.floor(F.col("doc_id") / PER_ARCHIVE).cast("string")).alias("path"), F.concat(F.lit("é/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    return isdf.build(docs, "path")


@query("""SELECT 'archive-' || (doc_id // 20) AS path, 'é/' || doc_id || '.txt' AS original_name, CAST(octet_length(encode(text)) AS BIGINT) AS uncompressed_size, md5(text) AS md5, true AS crc_ok, true AS size_ok FROM documents""")
def isdf_extract(spark, d):
    found = table(_archives(spark, d), "archives")
    out = isdf.payloads(found, isdf.records(found))
    return out.select("path", "original_name", "uncompressed_size", F.md5("data").alias("md5"), "crc_ok", "size_ok")


def _pool(values: DataFrame) -> DataFrame:
    """(path, value, string_id) and streams of a string pool for distinct values of each database."""
    listed = values.where("value != ''").distinct().groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("v"))
    raw = F.transform("v", lambda x: F.encode(x, "UTF-8"))
    join = lambda parts: F.aggregate(parts, F.lit(bytearray()), lambda a, x: F.concat(a, x))
    heads = F.concat(F.lit(bytearray(b"\xe9\xfd\x00\x00")), join(F.transform(raw, lambda x: F.concat(packed(F.length(x), 2), packed(F.lit(1), 2)))))
    return listed.select("path", "v", heads.alias("_StringPool"), join(raw).alias("_StringData"))


def _column(rows: Column, value, size: int) -> Column:
    return F.aggregate(F.transform(rows, lambda r: packed(value(r), size)), F.lit(bytearray()), lambda a, x: F.concat(a, x))


def _database(rows: DataFrame, name: str, columns: dict[str, bool]) -> DataFrame:
    """Streams (path, name, data) of databases with one table, from rows (path, ..) ; columns: whether each is a string."""
    texts = [rows.select("path", F.col(c).alias("value")) for c, s in columns.items() if s]
    fixed = rows.select("path", F.explode(F.array(*map(F.lit, [name, *columns]))).alias("value"))
    values = fixed
    for x in texts:
        values = values.unionByName(x)
    pool = _pool(values)
    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows")).join(pool, "path")
    id_ = lambda v: F.array_position("v", v)
    cell = lambda c, s: (lambda r: F.when(r[c] == "", 0).otherwise(id_(r[c]))) if s else (lambda r: F.when(r[c].isNull(), 0).otherwise(F.pmod(r[c] + 2**31, F.lit(2**32))))
    data = F.concat(*(_column(F.col("rows"), cell(c, s), 2 if s else 4) for c, s in columns.items()))
    names_, kinds = list(columns), [0x0D00 if s else 0x0104 for s in columns.values()]
    each = lambda of: F.concat(*(packed(of(i), 2) for i in range(len(names_))))
    catalog = F.concat(each(lambda i: id_(F.lit(name))), each(lambda i: F.lit(0x8000 + i + 1)), each(lambda i: id_(F.lit(names_[i]))), each(lambda i: F.lit(0x8000 ^ kinds[i])))
    streams = F.array(*(F.struct(F.lit(n).alias("name"), c.alias("data")) for n, c in (("_StringPool", F.col("_StringPool")), ("_StringData", F.col("_StringData")), ("_Columns", catalog), (name, data))))
    return grouped.select("path", F.explode(streams).alias("s")).select("path", "s.*")


@query("""SELECT 'db-' || s_nationkey AS path, trim(s_name) AS name, CAST(s_suppkey AS BIGINT) AS id, CASE WHEN floor(s_acctbal) = 0 THEN NULL ELSE CAST(floor(s_acctbal) AS BIGINT) END AS balance FROM supplier""")
def msi_table_read(spark, d):
    rows = t(spark, d, "supplier").select(F.concat(F.lit("db-"), F.col("s_nationkey").cast("string")).alias("path"), F.trim("s_name").alias("Name"), F.col("s_suppkey").alias("Id"), F.nullif(F.floor("s_acctbal").cast("long"), F.lit(0)).alias("Balance"))
    streams = _database(rows, "Supplier", {"Name": True, "Id": False, "Balance": False})
    _, cells = msi.tables(table(streams, "msi-streams"))
    return msi.relation(cells, "supplier", {"name": ("name", "text"), "id": ("id", "number"), "balance": ("balance", "number")}).drop("table_order")


@query("SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) + 4 * ((octet_length(encode(text)) + 4095) // 4096) AS BIGINT) AS stored FROM documents")
def chunk_strip(spark, d):
    stored = table(t(spark, d, "documents").select("doc_id", binary.chunked(F.encode("text", "UTF-8")).alias("chunks")), "chunked")
    return stored.select("doc_id", F.md5(binary.unchunked("chunks")).alias("md5"), F.length("chunks").cast("long").alias("stored"))


#: Suppliers to a script.
PER_SCRIPT = 50


@query("SELECT s_suppkey, '$INSTDIR\\' || s_name || '$R' || (s_suppkey % 10) AS text FROM supplier")
def script_strings(spark, d):
    """Each supplier's name behind and before an escape, in the string block of its script, and read back by its place."""
    escape = lambda n: F.concat(F.lit(bytearray(b"\xfd")), packed(n + 0x80, 1), F.lit(bytearray(b"\x80")))
    raw = F.concat(escape(F.lit(21)), F.encode(F.concat(F.lit("\\"), "s_name"), "UTF-8"), escape(10 + F.col("s_suppkey") % 10), F.lit(bytearray(1)))
    rows = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("script-"), F.floor(F.col("s_suppkey") / PER_SCRIPT).cast("string")).alias("path"), raw.alias("raw"))
    before = Window.partitionBy("path").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    placed = table(rows.withColumn("pos", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("long")), "script-strings")
    blocks = placed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("raw").alias("digits")))).alias("parts"))
    header = F.unhex(F.array_join(F.transform("parts", lambda x: x["digits"]), ""))
    headers = table(blocks.select("path", header.alias("header"), F.lit(0).alias("strings_at"), F.length(header).alias("n_chars")), "script-headers")
    found = script_text.texts(placed, headers, script_text.DIALECTS["ansi2"])
    return placed.join(found, ["path", "pos"]).select("s_suppkey", "text")
