"""Texts of install scripts: entries of a header's string block, with escapes for variables, shell folders and language texts.

The block is cut once, at its zero units; a command's number then finds its piece by a window, as it may point into one.
Pieces are handled as hex digits, since escapes hold bytes that are no text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.arrays import running_sums
from cargolens.functions.binary import take, utf8, utf16
from cargolens.operators import windows

# Names of the variables from number 20 on, and of the shell folders by number ("" has no name).
FIRST_VARIABLE = 20
VARIABLES = ["CMDLINE", "INSTDIR", "OUTDIR", "EXEDIR", "LANGUAGE", "TEMP", "PLUGINSDIR", "EXEPATH", "EXEFILE", "HWNDPARENT", "_CLICK", "_OUTDIR"]
SHELL_FOLDERS = [
    "DESKTOP", "INTERNET", "SMPROGRAMS", "CONTROLS", "PRINTERS", "DOCUMENTS", "FAVORITES", "SMSTARTUP", "RECENT", "SENDTO", "BITBUCKET", "STARTMENU", "", "MUSIC",
    "VIDEOS", "", "DESKTOP", "DRIVES", "NETWORK", "NETHOOD", "FONTS", "TEMPLATES", "STARTMENU", "SMPROGRAMS", "SMSTARTUP", "DESKTOP", "APPDATA", "PRINTHOOD",
    "LOCALAPPDATA", "ALTSTARTUP", "ALTSTARTUP", "FAVORITES", "INTERNET_CACHE", "COOKIES", "HISTORY", "APPDATA", "WINDIR", "SYSDIR", "PROGRAM_FILES", "PICTURES",
    "PROFILE", "SYSTEMX86", "PROGRAM_FILESX86", "PROGRAM_FILES_COMMON", "PROGRAM_FILES_COMMONX8", "TEMPLATES", "DOCUMENTS", "ADMINTOOLS", "ADMINTOOLS", "CONNECTIONS",
    "", "", "", "MUSIC", "PICTURES", "VIDEOS", "RESOURCES", "RESOURCES_LOCALIZED", "COMMON_OEM_LINKS", "CDBURN_AREA", "", "COMPUTERSNEARME",
]
REGISTRY = {"ProgramFilesDir": "$PROGRAMFILES", "CommonFilesDir": "$COMMONFILES"}
#: A registry folder's name stands at one of the first 64 units of the block and has at most 256.
REGISTRY_HEAD = 64 + 256


@dataclass(frozen=True)
class Dialect:
    """The hex digits of a unit, and those of the escapes; number: of an escape's two bytes."""

    digits: int
    skip: str
    var: str
    shell: str
    lang: str
    wide_numbers: bool = False

    @property
    def zero(self) -> str:
        return "0" * self.digits

    @property
    def pattern(self) -> str:
        """Escapes, runs of plain units, and an escape that the end cuts off."""
        codes = f"{self.skip}|{self.var}|{self.shell}|{self.lang}"
        unit = f"[0-9A-F]{{{self.digits}}}"
        return f"{self.skip}{unit}|(?:{self.var}|{self.shell}|{self.lang})[0-9A-F]{{4}}|(?:(?!{codes}){unit})++|[0-9A-F]+"


# The escapes of each dialect, in the order of their bytes.
DIALECTS = {
    "ansi2": Dialect(2, skip="FC", var="FD", shell="FE", lang="FF"),
    "ansi3": Dialect(2, skip="04", var="03", shell="02", lang="01"),
    "unicode3": Dialect(4, skip="0400", var="0300", shell="0200", lang="0100"),
    "park": Dialect(4, skip="00E0", var="01E0", shell="02E0", lang="03E0", wide_numbers=True),
}


def _block(dialect: Dialect) -> Column:
    """The hex digits of a header's string block, whole units only."""
    d = dialect.digits
    block = F.hex(take("header", "strings_at", F.greatest(F.col("n_chars"), F.lit(0)) * (d // 2)))
    return F.substring(block, F.lit(1), F.floor(F.length(block) / d).cast("int") * d)


def string_pieces(headers: DataFrame, dialect: Dialect) -> DataFrame:
    """(path, start, piece) of headers (path, header, strings_at, n_chars): hex digits between zero units, and where they start, in units."""
    d = dialect.digits
    cut = F.regexp_extract_all(_block(dialect), F.lit(f"((?:(?!{dialect.zero})[0-9A-F]{{{d}}})*+)(?:{dialect.zero}|$)"), F.lit(1))
    placed = headers.select("path", cut.alias("pieces")).withColumn("ends", running_sums(F.transform("pieces", lambda p: (F.length(p) / d + 1).cast("bigint"))))
    each = placed.select("path", F.explode(F.arrays_zip("pieces", "ends")).alias("p"))
    return each.select("path", (F.col("p.ends") - 1 - F.length("p.pieces") / d).cast("bigint").alias("start"), F.col("p.pieces").alias("piece"))


def _text_hex(text: Column, d: int) -> Column:
    return F.hex(F.encode(text, "ISO-8859-1" if d == 2 else "UTF-16LE"))


def _plain(digits: Column, d: int) -> Column:
    """The text of hex digits; bytes that are no UTF-8 are taken as Latin-1."""
    raw = F.unhex(digits)
    return F.coalesce(utf8(raw), F.decode(raw, "ISO-8859-1")) if d == 2 else utf16(raw)


def _variable(n: Column) -> Column:
    own = FIRST_VARIABLE + len(VARIABLES)
    named = F.get(F.array(*map(F.lit, VARIABLES)), n - FIRST_VARIABLE)
    return F.when(n < 10, F.format_string("$%d", n)).when(n < FIRST_VARIABLE, F.format_string("$R%d", n - 10)).when(n < own, F.concat(F.lit("$"), named)).otherwise(F.format_string("$_%d_", n - own))


def _shell_folder(a: Column, b: Column, head: Column, n_chars: Column, d: int) -> Column:
    name = lambda i: F.nullif(F.get(F.array(*map(F.lit, SHELL_FOLDERS)), i), F.lit(""))
    by_number = F.concat(F.lit("$"), F.coalesce(name(a), name(b), F.format_string("$_ERROR_UNSUPPORTED_SHELL_[%d,%d]", a, b)))
    at = a.bitwiseAND(F.lit(0x3F))
    digits = F.regexp_extract(F.substring(head, at * d + 1, F.lit(256 * d)), f"^((?:(?!{'0' * d})[0-9A-F]{{{d}}})*+)", 1)
    key = F.coalesce(F.decode(F.unhex(digits), "ISO-8859-1") if d == 2 else utf16(F.unhex(digits)), F.lit(""))
    wide = F.when(a.bitwiseAND(F.lit(0x40)) != 0, F.lit("64")).otherwise(F.lit(""))
    known = F.lit(None).cast("string")
    for k, v in REGISTRY.items():
        known = F.when(key == k, F.lit(v)).otherwise(known)
    by_registry = F.coalesce(F.concat(known, wide), F.concat(F.lit("$_ERROR_UNSUPPORTED_VALUE_REGISTRY_"), wide, F.lit("("), key, F.lit(")")))
    return F.when(a < 0x80, by_number).when(at >= n_chars, F.lit("$_ERROR_STR_")).otherwise(by_registry)


def _decoded(digits: Column, head: Column, n_chars: Column, dialect: Dialect) -> Column:
    d = dialect.digits

    def token(m: Column) -> Column:
        code = F.substring(m, 1, d)
        byte = lambda k: F.conv(F.substring(m, d + 1 + 2 * k, 2), 16, 10).cast("int")
        a, b = byte(0), byte(1)
        n = (a + b * 256).bitwiseAND(F.lit(0x7FFF)) if dialect.wide_numbers else a.bitwiseAND(F.lit(0x7F)) + b.bitwiseAND(F.lit(0x7F)) * 128
        text = F.when(code == dialect.var, _variable(n)).when(code == dialect.shell, _shell_folder(a, b, head, n_chars, d)).otherwise(F.format_string("$(LSTR_%d)", n))
        named = code.isin(dialect.var, dialect.shell, dialect.lang)
        return F.when(code == dialect.skip, F.substring(m, d + 1, d)).when(named & (F.length(m) == d + 4), _text_hex(text, d)).when(named, F.lit("")).otherwise(m)

    return _plain(F.array_join(F.transform(F.regexp_extract_all(digits, F.lit(dialect.pattern), F.lit(0)), token), ""), d)


def texts(refs: DataFrame, headers: DataFrame, dialect: Dialect) -> DataFrame:
    """Distinct (path, pos) of refs with text: what an unsigned 32-bit number of a script points to in its header's strings."""
    wanted = refs.select("path", "pos").where("pos IS NOT NULL").distinct()
    language = wanted.where(F.col("pos") >= 2**31).select("path", "pos", F.format_string("$(LSTR_%d)", F.lit(2**32 - 1) - F.col("pos")).alias("text"))
    inside = wanted.where(F.col("pos") < 2**31)
    # Pieces tile their block: the piece of a place is the last one that starts at or before it.
    marks = string_pieces(headers, dialect).select("path", F.col("start").alias("pos"), F.lit(0).alias("wanted"), F.struct("start", "piece").alias("p"))
    marks = marks.unionByName(inside.withColumn("wanted", F.lit(1)), allowMissingColumns=True)
    met = windows.forward_fill(marks, ["path"], ["pos", "wanted"], "p", "at").where("wanted = 1")
    heads = headers.select("path", "n_chars", F.substring(_block(dialect), F.lit(1), F.lit(REGISTRY_HEAD * dialect.digits)).alias("head"))
    rest = F.substr("at.piece", (F.col("pos") - F.col("at.start")).cast("int") * dialect.digits + 1)
    text = F.when(F.coalesce(F.col("pos") < F.col("n_chars"), F.lit(False)), F.coalesce(_decoded(rest, F.col("head"), F.col("n_chars"), dialect), F.lit(""))).otherwise(F.lit("$_ERROR_STR_"))
    met = met.join(heads, "path", "left")
    return language.unionByName(met.select("path", "pos", text.alias("text")))


def with_texts(commands: DataFrame, headers: DataFrame, dialect: Dialect) -> DataFrame:
    """Commands (path, script_index, opcode, p0 .. p5) with text0 and text1, as script_files takes them."""
    refs = commands.select("path", F.explode(F.array("p0", "p1")).alias("pos"))
    found = texts(refs, headers, dialect)
    for k in (0, 1):
        commands = commands.join(found.select("path", F.col("pos").alias(f"p{k}"), F.col("text").alias(f"text{k}")), ["path", f"p{k}"], "left")
    return commands
