"""Which container formats a file has: one SQL expression for each format over its bytes, all in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.binary import find, has_at, inside, little, take

# Signatures of the formats.
NSIS = [b"NullsoftInst", b"Nullsoft.NSIS", b";!@Install@!UTF-8!", b";!@Install@!UTF-16LE", b";!@Install@!"]
INNO = [b"Inno Setup Setup Data", b"Inno Setup: Setup Data"]
AUTOIT = {b"AU3!EA05": "EA05", b"AU3!EA06": "EA06 (unsupported)"}
ARCHIVES = {"7z": b"7z\xbc\xaf\x27\x1c", "rar": b"Rar!", "rar14": b"RE~^", "cab": b"MSCF"}
COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")
#: What the root entry's class says, by its first byte; the bytes after it.
CLASSES = {0x84: "database", 0x86: "patch", 0x82: "transform"}
CLASS_TAIL = bytes.fromhex("100c0000000000c000000000000046")
#: Strings of a self-extractor's own stub, that tell who made it.
STUBS = {"rar": [b'name="WinRAR', b"sfxrar", b"sfxcon"], "cab": [b"wextract", b"IExpress extraction tool"]}
#: The longest stretch after a signature that is searched for a version.
WINDOW = 128


def first_of(content: Column, signatures: list[bytes]) -> Column:
    """Offset of the first signature, in their order, that occurs at all."""
    return F.coalesce(*(find(content, s) for s in signatures))


def text_after(content: Column, offset: Column, size: int = WINDOW) -> Column:
    return F.decode(take(content, offset, size), "ISO-8859-1")


def portable(content: Column) -> Column:
    """Whether the file has a DOS header that leads to a PE signature."""
    at = little(content, 60, 4)
    return has_at(content, 0, b"MZ") & inside(at, F.lit(4), F.length(content)) & (take(content, at, 4) == F.lit(bytearray(b"PE\0\0")))


def sections(content: Column) -> Column:
    """The section table of a PE file: array of (name, virtual_size, rva, raw_size, raw_offset); empty for other files."""
    at = little(content, 60, 4)
    n, start = little(content, at + 6, 2), at + 24 + little(content, at + 20, 2)

    def one(i: Column) -> Column:
        o = start + 40 * i
        name = F.regexp_replace(F.decode(take(content, o, 8), "ISO-8859-1"), "\\x00.*$", "")
        fields = {"virtual_size": 8, "rva": 12, "raw_size": 16, "raw_offset": 20}
        return F.struct(name.alias("name"), *(little(content, o + k, 4).alias(f) for f, k in fields.items()))

    # The loader takes at most 96 sections.
    some = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(96)).cast("int") - 1), one)
    none = F.array().cast("array<struct<name:string,virtual_size:bigint,rva:bigint,raw_size:bigint,raw_offset:bigint>>")
    return F.when(portable(content) & (n > 0), some).otherwise(none)


def one_section(found: Column, name: str) -> Column:
    """The section of that name, null unless there is exactly one."""
    same = F.filter(found, lambda s: s["name"] == name)
    return F.when(F.size(same) == 1, F.get(same, 0))


def overlay(found: Column) -> Column:
    """Where the last section's bytes end."""
    return F.array_max(F.transform(found, lambda s: s["raw_offset"] + s["raw_size"]))


def attributed(content: Column, end: Column, marks: list[bytes]) -> Column:
    """Whether a mark lies in the file's own stub, before its overlay: an appended archive may hold any string."""
    stub = F.substring(content, F.lit(1), end.cast("int"))
    return F.coalesce(*(find(stub, m) for m in marks)).isNotNull()


def root_class(content: Column) -> Column:
    """What a compound file holds, by the class of its root directory entry; null for others."""
    sector = F.call_function("shiftleft", F.lit(1), little(content, 30, 2).cast("int"))
    root = (little(content, 48, 4) + 1) * sector
    kind = little(content, root + 0x50, 1)
    known = has_at(content, 0, COMPOUND) & little(content, 30, 2).between(7, 16) & (take(content, root + 0x51, 15) == F.lit(bytearray(CLASS_TAIL)))
    return F.when(known, F.element_at(F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair)), kind.cast("int")))


def _row(format_: str, valid: Column, offset: Column, version: Column | None = None) -> Column:
    version = F.lit(None).cast("string") if version is None else version
    return F.struct(F.lit(format_).alias("format"), F.coalesce(valid, F.lit(False)).alias("is_valid"), offset.cast("long").alias("offset"), F.nullif(version, F.lit("")).alias("version"))


def detections(found: DataFrame) -> DataFrame:
    """(path, format, is_valid, offset, version) of the formats that each file (path, content) has."""
    c, s = F.col("content"), F.col("sections")
    nsis, inno = first_of(c, NSIS), first_of(c, INNO)
    inno_text = text_after(c, inno)
    inno_version = F.coalesce(F.nullif(F.trim(F.regexp_extract(inno_text, r"\(([^)]*)\)", 1)), F.lit("")), F.regexp_extract(inno_text, r"^Inno Setup:? Setup Data\s*v?([0-9._]+)", 1))
    autoit = [(find(c, m), v) for m, v in AUTOIT.items()]
    evb1, evb2 = one_section(s, ".enigma1"), one_section(s, ".enigma2")
    evb = find(take(c, evb1["raw_offset"], evb1["raw_size"]), b"EVB\0") + evb1["raw_offset"]
    evb_version = little(c, evb + 20, 4)
    gentee = F.coalesce(*(find(c, m) for m in (b"lzge_decode", b"genteert.dll", b"gentee_init")))
    burn = one_section(s, ".wixburn")
    boxed, main = one_section(s, ".bxpck"), one_section(s, ".main")
    end = overlay(s)
    after = lambda magic: find(F.substring(c, end + 1, F.length(c)), magic) + end
    upx = find(F.substring(c, F.lit(1), F.lit(4096)), b"UPX!")
    footer = find(c, b"ADVINSTSFX")
    rows = [
        _row("nsis", nsis.isNotNull(), nsis, F.regexp_extract(text_after(c, nsis, 512), r"v([0-9][0-9a-z.]*)", 1)),
        _row("inno", inno.isNotNull(), inno, inno_version),
        _row("autoit", F.coalesce(*(a for a, _ in autoit)).isNotNull() & (F.length(c) >= 24), F.coalesce(*(a for a, _ in autoit)), F.coalesce(*(F.when(a.isNotNull(), F.lit(v)) for a, v in autoit))),
        _row("enigma", evb.isNotNull() & evb2.isNotNull() & (evb2["raw_offset"] >= evb1["raw_offset"] + evb1["raw_size"]), evb, F.when(evb_version.between(1, 0xFFF), F.concat(F.lit("package v"), evb_version.cast("string")))),
        _row("createinstall", one_section(s, ".gentee").isNotNull() & gentee.isNotNull(), gentee),
        _row("burn", burn.isNotNull(), burn["raw_offset"]),
        _row("boxedapp", boxed.isNotNull() & main.isNotNull() & ((boxed["raw_offset"] + boxed["raw_size"] <= main["raw_offset"]) | (main["raw_offset"] + main["raw_size"] <= boxed["raw_offset"])), boxed["raw_offset"]),
        _row("upx", upx.isNotNull() & (portable(c) | has_at(c, 0, b"\x7fELF")), upx),
        _row("advanced", portable(c) & footer.isNotNull(), footer),
        _row("compound", has_at(c, 0, COMPOUND), F.lit(0), root_class(c)),
        *(_row(f"sfx-{k}", F.size(s) > 0, after(m), F.when(attributed(c, end, STUBS[k]), F.lit("attributed")) if k in STUBS else None) for k, m in ARCHIVES.items()),
    ]
    listed = found.select("path", "content").withColumn("sections", sections(F.col("content"))).select("path", F.explode(F.array(*rows)).alias("d"))
    return listed.select("path", "d.*").where("is_valid and offset is not null")
