"""Listings that are programs or configuration: install scripts and ini files, read with windows instead of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions import names
from cargolens.functions.arrays import fold_rows, let
from cargolens.functions.binary import little, take, utf16
from cargolens.operators import windows

# The script's commands that name files, and their size.
SET_OUT_PATH, EXTRACT_FILE, WRITE_UNINSTALLER = 11, 20, 62
COMMAND, PARAMETERS = 28, 6


def commands(headers: DataFrame) -> DataFrame:
    """(path, script_index, opcode, p0 .. p5) from decoded headers (path, header, entries_at, n_entries)."""
    at = lambda i: F.col("entries_at") + COMMAND * i
    one = lambda header, i: F.struct(little(header, at(i), 4).alias("opcode"), *(little(header, at(i) + 4 + 4 * k, 4).alias(f"p{k}") for k in range(PARAMETERS)))
    n = F.least(F.col("n_entries"), F.floor((F.length("header") - F.col("entries_at")) / COMMAND)).cast("int")
    return headers.where(n > 0).select("path", F.posexplode(let(F.col("header"), lambda header: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(header, i)))).alias("script_index", "c")).select("path", "script_index", "c.*")


def script_files(script: DataFrame) -> DataFrame:
    """(path, script_index, pos, name, folder, is_uninstaller) of the files that a script installs, by position, ties in script order.

    script: (path, script_index, opcode, p0 .. p5, text0, text1), the texts that p0 and p1 point to. SetOutPath holds until the
    next one; one that starts with $OUTDIR goes on from the one before: the texts since the last absolute one are joined."""
    order = Window.partitionBy("path").orderBy("script_index").rowsBetween(Window.unboundedPreceding, 0)
    sets_path = (F.col("opcode") == SET_OUT_PATH) & (F.col("p1") != 0)
    relative = F.col("text0").startswith("$OUTDIR")
    marked = script.withColumn("_part", F.when(sets_path, F.when(relative, F.substr("text0", F.lit(len("$OUTDIR") + 1))).otherwise(F.col("text0"))))
    marked = marked.withColumn("_base", F.count(F.when(sets_path & ~relative, 1)).over(order))
    chained = Window.partitionBy("path", "_base").orderBy("script_index").rowsBetween(Window.unboundedPreceding, 0)
    # Before any absolute path the chain starts at the install folder.
    start = F.when(F.col("_base") == 0, F.lit("$INSTDIR")).otherwise(F.lit(""))
    prefix = F.concat(start, F.array_join(F.collect_list("_part").over(chained), ""))
    uninstaller = F.col("opcode") == WRITE_UNINSTALLER
    given = F.when(uninstaller, F.col("text0")).otherwise(F.col("text1"))
    absolute = given.rlike(r"^(\$|[A-Za-z]:|\\\\)")
    placed = marked.withColumn("_prefix", prefix).where(F.col("opcode").isin(EXTRACT_FILE, WRITE_UNINSTALLER))
    listed = placed.select(
        "path",
        "script_index",
        F.when(uninstaller, F.col("p1")).otherwise(F.col("p2")).alias("pos"),
        names.reduced(F.when(absolute, given).otherwise(F.concat("_prefix", F.lit("\\"), given))).alias("name"),
        F.when(~absolute, F.regexp_replace(names.reduced(F.concat("_prefix", F.lit("\\"))), "/$", "")).alias("folder"),
        uninstaller.alias("is_uninstaller"),
    )
    return windows.consecutive_distinct(listed, ["path"], ["pos", "script_index"], ["pos", "name"])


def ini_entries(texts: DataFrame, section: str) -> DataFrame:
    """(path, line, key, value) of a section of ini texts (path, text), its name compared without case."""
    each = texts.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", F.trim(F.regexp_replace("text", "\r$", "")))
    head = F.when(F.col("text").rlike(r"^\[.*\]$"), F.lower("text"))
    filled = windows.forward_fill(each.withColumn("_head", head), ["path"], ["line"], "_head", "_section")
    inside = filled.where((F.col("_section") == f"[{section.lower()}]") & F.col("_head").isNull() & (F.instr("text", "=") > 1))
    return inside.select("path", "line", F.trim(names.before_first("text", "=")).alias("key"), names.after_first("text", "=").alias("value"))


def ini_names(texts: DataFrame) -> DataFrame:
    """(path, index, name): the safe file names that the [Files] section gives by number; a path that repeats a number has none."""
    listed = ini_entries(texts, "Files").where(F.col("key").rlike("^[0-9]{1,9}$")).select("path", F.col("key").cast("long").alias("index"), "value")
    twice = listed.groupBy("path", "index").count().where("count > 1").select("path").distinct()
    file = F.trim(F.regexp_extract(F.regexp_replace(F.regexp_replace("value", r"\?[^?]*$", ""), r"\\", "/"), r"([^/]*)$", 1))
    return listed.join(twice, "path", "left_anti").select("path", "index", file.alias("name")).where(names.safe_name(F.col("name")))


MARK = b"ADVINSTSFX"
PREFIX, MOST_FILES, FORMAT = 64, 4096, 100


def advanced_footers(found: DataFrame) -> DataFrame:
    """(path, footer_offset, mode, n_files, info_offset, data_offset) of files (path, content) with exactly one coherent footer."""
    gaps = F.transform(F.split(F.decode("content", "ISO-8859-1"), MARK.decode()), lambda s: F.length(s).cast("long"))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    marks = F.aggregate(gaps, begin, lambda a, n: F.struct((a["at"] + n + len(MARK)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: F.slice(a["out"], 1, F.size(a["out"]) - 1))
    each = found.where(F.instr(F.decode("content", "ISO-8859-1"), MARK.decode()) > 0).select("path", "content", F.explode(marks).alias("mark")).withColumn("footer_offset", F.col("mark") - PREFIX).where("footer_offset >= 0")
    fields = {n: little("content", F.col("footer_offset") + 4 * k, 4) for k, n in enumerate(("mode", "external", "n_files", "version", "metadata_end", "info_offset", "data_offset"))}
    read = each.select("path", "footer_offset", F.decode(take("content", F.col("footer_offset") + 28, 32), "ISO-8859-1").alias("digest"), *(c.alias(n) for n, c in fields.items()))
    outside = F.when(F.col("mode") == 0, F.col("external") == F.col("footer_offset")).otherwise((F.col("external") >= F.col("info_offset")) & (F.col("external") < F.col("footer_offset")))
    whole = (
        F.col("digest").rlike("^[0-9A-Fa-f]{32}$") & (F.col("mode") <= 1) & (F.col("version") == FORMAT) & F.col("n_files").between(1, MOST_FILES)
        & (F.col("data_offset") < F.col("info_offset")) & (F.col("info_offset") < F.col("footer_offset")) & (F.col("metadata_end") == F.col("footer_offset")) & outside
    )
    single = Window.partitionBy("path")
    return read.where(whole).withColumn("_n", F.count(F.lit(1)).over(single)).where("_n = 1").select("path", "footer_offset", "mode", "n_files", "info_offset", "data_offset")


#: Bounds of a virtual file system's tree.
HEADER, MOST_NODES, DEEPEST, LONGEST = 0x53, 100_000, 1024, 255


def tree_files(boxes: DataFrame) -> DataFrame:
    """(path, record_index, name, size, stored_size, offset) from pre-order trees in boxes (path, tree, data_at): tree starts at its magic.

    One fold over the bytes keeps a stack of children still to come. A tree that is cut, repeats a node, goes too deep or has other
    node types gives no rows. Stored files follow each other from data_at on."""
    limit = F.length("tree")
    top = little("tree", 0x4C, 4)
    none = F.array().cast("array<struct<id:bigint,kind:bigint,name:string,size:bigint,stored_size:bigint>>")
    # No node is shorter than 44 bytes; steps past the end of the walk change nothing.
    most = F.least(F.floor((limit - HEADER) / 44) + 1, F.lit(MOST_NODES)).cast("int")

    def walk(tree: Column) -> Column:
        def read(state: Column, _: Column) -> Column:
            p = state["at"]
            id_, kind, children = (little(tree, p + 4 * k, 4) for k in range(3))
            # Whole units before the first NUL, in hex.
            units = F.regexp_extract(F.hex(take(tree, p + 12, 2 * (LONGEST + 1))), "^((?:(?!0000)[0-9A-F]{4})*+)0000", 1)
            return let(F.struct(id_.alias("id"), kind.alias("kind"), children.alias("children"), units.alias("units")), lambda x: node(state, x))

        def node(state: Column, x: Column) -> Column:
            kind, children, name = x["kind"], x["children"], utf16(F.unhex(x["units"]))
            body = state["at"] + 12 + F.floor(F.length(x["units"]) / 2) + 2
            depth = F.size(state["left"])
            rest = F.concat(F.slice(state["left"], 1, F.greatest(depth - 1, F.lit(0))), F.array(F.element_at(state["left"], -1) - 1))
            left = F.when((kind == 1) & (children > 0), F.concat(rest, F.array(children))).otherwise(rest)
            end = body + F.when(kind == 1, 30).otherwise(58)
            good = state["good"] & (end <= limit) & name.isNotNull() & (F.when(kind == 1, children <= MOST_NODES).otherwise((kind == 2) & (children == 0))) & (F.size(left) <= DEEPEST)
            found = F.struct(x["id"].alias("id"), kind.alias("kind"), name.alias("name"), little(tree, body + 3, 8).alias("size"), little(tree, body + 50, 8).alias("stored_size"))
            after = F.struct(end.cast("bigint").alias("at"), F.filter(left, lambda n: n > 0).alias("left"), F.coalesce(good, F.lit(False)).alias("good"))
            return F.struct(after.alias("state"), F.array(found).alias("rows"))

        step = lambda state, i: F.when(state["good"] & (F.size(state["left"]) > 0), read(state, i)).otherwise(F.struct(state.alias("state"), none.alias("rows")))
        begin = F.struct(F.lit(HEADER).cast("bigint").alias("at"), F.filter(F.array(top), lambda n: n > 0).alias("left"), F.lit(True).alias("good"))
        return fold_rows(most, begin, step, none)

    walked = boxes.where((limit > HEADER) & (top <= MOST_NODES)).select("path", "data_at", let(F.col("tree"), walk).alias("w"))
    ids = F.transform("w.rows", lambda r: r["id"])
    whole = walked.where(F.col("w.state.good") & (F.size("w.state.left") == 0) & (F.size(F.array_distinct(ids)) == F.size(ids)))
    files = F.filter("w.rows", lambda r: r["kind"] == 2)
    listed = whole.select("path", "data_at", F.posexplode(files).alias("record_index", "f")).select("path", "data_at", "record_index", "f.name", "f.size", "f.stored_size")
    placed = windows.prefix_offset(listed, ["path"], ["record_index"], F.col("stored_size"), "_before")
    return placed.select("path", "record_index", "name", "size", "stored_size", (F.col("data_at") + F.col("_before")).alias("offset"))


def block_checksum(data: Column, seed: Column) -> Column:
    """A cabinet block's checksum: little-endian words folded by exclusive or; up to three last bytes count from the high end."""
    n = F.floor(F.length(data) / 4).cast("int")
    words_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    whole = let(data, lambda d: F.aggregate(words_, seed.cast("bigint"), lambda a, i: a.bitwiseXOR(little(d, 4 * i, 4))))
    rest = F.substring(data, 4 * n + 1, F.lit(3))
    tail = F.when(F.length(rest) > 0, F.conv(F.hex(rest), 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return whole.bitwiseXOR(tail)
