"""Installer databases: their table streams as relations, and the files they install.

A database is a set of named streams: a string pool, a catalog of columns, and one stream for each table with its cells column
after column. All decoding is SQL over the streams (path, name, data); a database with any bad part loses all its rows and
gets an error, and the others stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions import names
from cargolens.functions.arrays import let, running_sums
from cargolens.functions.binary import all_flags, any_flag, ascii_text, little, signed_cell, take, utf8, utf16
from cargolens.functions.staging import table
from cargolens.operators import joins, sets, trees

# Fixed values of the format.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"
STRING_TYPE, MOST_ROWS, WIDEST_ROW, MOST_COLUMNS, DEEPEST = 0x0800, 65_536, 4096, 256, 256
#: Code pages of UTF-8; besides them 1252, 20127 (ASCII) and 1200 (UTF-16) are read, text in others is null.
UTF8_PAGES = (0, 65001)


def stream_name(raw: Column) -> Column:
    """The readable name of a stream: two characters of the alphabet in each code point from U+3800 on, one from U+4800 on; U+4840 marks a table."""
    one = lambda i: F.substring(F.lit(ALPHABET), i + 1, F.lit(1))

    def decoded(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int")
        pair = F.concat(one((code - 0x3800) % 64), one(F.floor((code - 0x3800) / 64).cast("int")))
        return F.when(code.between(0x3800, 0x47FF), pair).when(code.between(0x4800, 0x483F), one(code - 0x4800)).when(code == 0x4840, F.lit("")).otherwise(ch)

    return F.array_join(F.transform(F.filter(F.split(raw, ""), lambda ch: ch != ""), decoded), "")


def _stream(streams: DataFrame, name: str, out: str) -> DataFrame:
    return streams.where(F.col("name") == name).select("path", F.col("data").alias(out))


def string_pool(streams: DataFrame) -> DataFrame:
    """(path, string_id, value, width) from _StringPool and _StringData; width: bytes of a reference.

    An entry of length 0 with references is the high half of the next one's length and takes no id."""
    both = _stream(streams, "_StringPool", "pool").join(_stream(streams, "_StringData", "text"), "path")
    width = F.when(any_flag(little("pool", 2, 2), 0x8000), 3).otherwise(2)
    page = little("pool", 0, 2) + F.floor(little("pool", 2, 2) % 0x8000) * 65536
    n = F.floor((F.length("pool") - 4) / 4).cast("int")
    heads = let(F.col("pool"), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 4) / 4).cast("int") - 1), lambda i: F.struct(little(p, 4 + 4 * i, 2).alias("size"), little(p, 6 + 4 * i, 2).alias("refs"))))
    high = lambda e: (e["size"] == 0) & (e["refs"] != 0)

    def sized(e: Column) -> Column:
        """Entries that take an id. Of two high halves in a row the second holds the low half."""
        before = lambda i: F.get(e, i - 1)
        was = lambda i: F.coalesce(high(before(i)), F.lit(False))
        with_high = F.transform(e, lambda x, i: F.struct((x["size"] + F.when(was(i), before(i)["refs"] * 65536).otherwise(0)).alias("size"), (~high(x) | was(i)).alias("own")))
        return F.transform(F.filter(with_high, lambda x: x["own"]), lambda x: x["size"])

    # Each stream is taken out of its row once, and every string is cut from it there.
    sizes = both.where(n > 0).select("path", width.alias("width"), page.alias("page"), "text", let(heads, sized).alias("sizes")).withColumn("ends", running_sums(F.col("sizes")))
    cut = lambda text: F.transform("sizes", lambda size, i: take(text, (F.get("ends", i) - size).cast("int"), size.cast("int")))
    strings = sizes.select("path", "width", "page", F.posexplode(let(F.col("text"), cut)).alias("i", "raw"))
    raw = F.col("raw")
    text = (
        F.when(F.col("page").isin(*UTF8_PAGES), utf8(raw))
        .when(F.col("page") == 1252, F.translate(F.decode(raw, "ISO-8859-1"), *WINDOWS))
        .when(F.col("page") == 20127, ascii_text(raw))
        .when(F.col("page") == 1200, utf16(raw))
    )
    return strings.where(F.length("raw") > 0).select("path", (F.col("i") + 1).cast("long").alias("string_id"), text.alias("value"), "width")


def _cells(data: Column, at: Column, width: Column) -> Column:
    return F.when(width == 2, little(data, at, 2)).when(width == 3, little(data, at, 3)).otherwise(little(data, at, 4))


def catalog(streams: DataFrame, pool: DataFrame) -> DataFrame:
    """(path, table, column, number, width, is_string, before, row_width, error) from _Columns."""
    widths = pool.select("path", "width").distinct()
    c = _stream(streams, "_Columns", "data").join(widths, "path")
    n = F.floor(F.length("data") / (2 * F.col("width") + 4)).cast("int")
    bad = (F.length("data") % (2 * F.col("width") + 4) != 0) | (n > MOST_ROWS) | (n < 1)
    at = lambda start, i, size: F.col("n") * start + i * size
    w = F.col("width")
    row = lambda data, i: F.struct(
        _cells(data, at(F.lit(0), i, w), w).alias("table_id"),
        signed_cell(little(data, at(w, i, F.lit(2)), 2), 16).alias("number"),
        _cells(data, at(w + 2, i, w), w).alias("name_id"),
        signed_cell(little(data, at(2 * w + 2, i, F.lit(2)), 2), 16).alias("type"),
    )
    read = let(F.col("data"), lambda data: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: row(data, i)))
    rows = c.withColumns({"n": n, "bad": bad}).where("n > 0").select("path", "width", "bad", F.explode(read).alias("r")).select("path", "width", "bad", "r.*")
    named = joins.dictionary_decode(rows, pool, "table_id", ["path"], "table")
    named = joins.dictionary_decode(named, pool, "name_id", ["path"], "column")
    string = any_flag("type", STRING_TYPE)
    size = F.when(string, F.col("width")).when(F.col("type") % 256 == 4, 4).otherwise(2)
    order = Window.partitionBy("path", F.lower("table")).orderBy("number")
    whole = Window.partitionBy("path", F.lower("table"))
    wrong = (
        F.col("bad") | F.coalesce(F.col("table") == "", F.lit(True)) | F.coalesce(F.col("column") == "", F.lit(True))
        | ~F.coalesce(F.col("number").between(1, MOST_COLUMNS), F.lit(False)) | ~F.coalesce(F.col("type") > 0, F.lit(False)) | (~string & ~(F.col("type") % 256).isin(0, 2, 4))
    )
    shaped = named.withColumns({"size": size, "is_string": string, "wrong": wrong, "place": F.row_number().over(order)})
    shaped = shaped.withColumns(
        {
            "before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "row_width": F.sum("size").over(whole),
            "same": F.count(F.lit(1)).over(Window.partitionBy("path", F.lower("table"), F.lower("column"))),
        }
    )
    error = F.when(F.col("wrong"), "bad catalog row").when(F.col("place") != F.col("number"), "column numbers are not 1 to n").when(F.col("same") > 1, "two columns of one name")
    return shaped.select("path", "table", "column", "number", F.col("size").alias("width"), "is_string", "before", "row_width", error.alias("error"))


def cells(streams: DataFrame, columns: DataFrame, pool: DataFrame) -> DataFrame:
    """(path, table, row, column, number, text, dangling) for all tables in the catalog; integer cells have number, null if 0."""
    there = columns.join(streams.select("path", F.lower("name").alias("_t"), "data"), (columns["path"] == streams["path"]) & (F.lower("table") == F.col("_t"))).drop(streams["path"])
    n = F.floor(F.length("data") / F.col("row_width")).cast("int")
    fits = (F.length("data") % F.col("row_width") == 0) & (F.col("row_width") <= WIDEST_ROW) & (n <= MOST_ROWS) & (n > 0)
    raw = let(F.col("data"), lambda data: F.transform(F.sequence(F.lit(0), n - 1), lambda i: _cells(data, n * F.col("before") + i * F.col("width"), F.col("width"))))
    each = there.where(fits).select("path", "table", "column", "is_string", "width", F.posexplode(raw).alias("row", "raw"))
    number = F.when(~F.col("is_string"), F.when(F.col("width") == 4, signed_cell(F.col("raw"), 32)).otherwise(signed_cell(F.col("raw"), 16)))
    coded = each.withColumn("string_id", F.when(F.col("is_string"), F.col("raw")).cast("long"))
    named = joins.dictionary_decode(coded, pool, "string_id", ["path"], "text")
    return named.select("path", "table", "row", "column", number.alias("number"), "text", (F.col("is_string") & F.col("text").isNull()).alias("dangling"))


def relation(all_cells: DataFrame, name: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One table as columns: fields maps an output name to (column in the database, `text` or `number`). Adds path and table_order."""
    own = all_cells.where(F.lower("table") == name.lower())
    value = lambda column, kind: F.max(F.when(F.lower("column") == column.lower(), F.col(kind)))
    return own.groupBy("path", F.col("row").alias("table_order")).agg(*(value(c, k).alias(out) for out, (c, k) in fields.items()))


def tables(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, cells) of all databases, written once: relations are taken from the cells. Databases with a bad catalog have none."""
    pool = table(string_pool(streams), "msi-strings")
    columns = table(catalog(streams, pool), "msi-columns")
    bad = columns.where("error is not null").select("path").distinct()
    return columns, table(cells(streams, columns.join(bad, "path", "left_anti"), pool), "msi-cells")


FILE = {"key": ("File", "text"), "component": ("Component_", "text"), "file_name": ("FileName", "text"), "size": ("FileSize", "number"), "attributes": ("Attributes", "number"), "sequence": ("Sequence", "number")}
MEDIA = {"disk_id": ("DiskId", "number"), "last_sequence": ("LastSequence", "number"), "cabinet": ("Cabinet", "text")}
COMPONENT = {"key": ("Component", "text"), "directory": ("Directory_", "text")}
DIRECTORY = {"key": ("Directory", "text"), "parent": ("Directory_Parent", "text"), "default": ("DefaultDir", "text")}
#: What code page 1252 has in place of control characters.
WINDOWS = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f",
    "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ",
)

COMPRESSED, NONCOMPRESSED = 0x4000, 0x2000


def installed_files(file: DataFrame, media: DataFrame, component: DataFrame, directory: DataFrame) -> DataFrame:
    """(path, key, name, sequence, size, disk_id, cabinet, compressed): what each database installs, named by its directories.

    Files that refer to no component or directory, lie in no single medium's range, or name no safe place leave with their
    whole database; errors() tells which."""
    return placed(file, media, component, directory).where("error is null").drop("error")


def errors(file: DataFrame, media: DataFrame, component: DataFrame, directory: DataFrame) -> DataFrame:
    """(path, error) of the databases that installed_files() leaves out."""
    return placed(file, media, component, directory).where("error is not null").groupBy("path").agg(F.min("error").alias("error"))


def placed(file: DataFrame, media: DataFrame, component: DataFrame, directory: DataFrame) -> DataFrame:
    """All files of all databases, with the error of their database."""
    key = names.folded
    scoped = lambda *c: F.concat_ws("\x00", *c)
    last = joins.lower_bounds(media, "last_sequence", "disk_id", ["path"]).select("path", "disk_id", "lower", "last_sequence", "cabinet")
    parts = names.target_and_source("default")
    nodes = directory.select(
        scoped(F.col("path"), key("key")).alias("key"),
        F.when(F.coalesce("parent", F.lit("")) != "", scoped(F.col("path"), key("parent"))).alias("parent"),
        names.long_name(parts["target"]).alias("name"),
    )
    # The root and `.` add no part.
    named = nodes.withColumn("name", F.when(F.col("parent").isNull() | (F.col("parent") == F.col("key")) | (F.col("name") == "."), F.lit("")).otherwise(F.col("name")))
    paths = trees.paths(named, "key", "parent", "name", deepest=DEEPEST).select(F.col("key").alias("_dir"), F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^/|/$", "").alias("folder"))
    owners = component.select("path", key("key").alias("_component"), key("directory").alias("_directory"))
    joined = file.withColumn("_component", key("component")).join(owners, ["path", "_component"], "left").withColumn("_dir", scoped(F.col("path"), F.col("_directory"))).join(paths, "_dir", "left")
    ranged = joined.alias("f").join(last.alias("m"), (F.col("f.path") == F.col("m.path")) & (F.col("sequence") > F.col("lower")) & (F.col("sequence") <= F.col("last_sequence")), "left").select("f.*", "m.disk_id", "m.cabinet")
    base = names.long_name("file_name")
    full = F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), base)
    one = Window.partitionBy("path", key("key"))
    wrong = (
        F.when(F.col("_directory").isNull(), "file without component")
        .when(F.col("folder").isNull(), "component without directory")
        .when(F.col("disk_id").isNull(), "file in no medium")
        .when(F.count(F.lit(1)).over(one) > 1, "file in two media, or two files of one key")
        .when(all_flags(F.coalesce("attributes", F.lit(0)), COMPRESSED | NONCOMPRESSED), "file both compressed and not")
        .when(~names.safe_path(full), "unsafe path")
    )
    marked = ranged.withColumns({"name": full, "_wrong": wrong}).withColumn("error", F.min("_wrong").over(Window.partitionBy("path")))
    renamed = F.concat(F.lit("__msi/id_"), F.col("key"), F.lit("/"), base)
    unique = sets.rename_collisions(marked, ["path"], "name", ["sequence", "table_order"], renamed, "name_")
    return unique.select("path", "key", F.col("name_").alias("name"), "sequence", F.coalesce("size", F.lit(0)).alias("size"), "disk_id", "cabinet", any_flag(F.coalesce("attributes", F.lit(0)), COMPRESSED).alias("compressed"), "error")
