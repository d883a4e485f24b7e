"""Script strings, offset tables and chunks built byte by byte."""

import struct
import zlib

import pytest
from cargolens.functions import binary
from cargolens.sources import inno, script_text
from pyspark.sql import functions as F

SCHEMA = "path string, header binary, strings_at int, n_chars int"


def number(n):
    return bytes([n & 0x7F | 0x80, n >> 7 & 0x7F | 0x80])


def decode(spark, name, block, places, n_chars=None):
    d = script_text.DIALECTS[name]
    header = b"HEAD" + block
    headers = spark.createDataFrame([("p", bytearray(header), 4, len(block) * 2 // d.digits if n_chars is None else n_chars)], SCHEMA)
    refs = spark.createDataFrame([("p", p) for p in places], "path string, pos long")
    got = {r.pos: r.text for r in script_text.texts(refs, headers, d).collect()}
    return [got[p] for p in places]


@pytest.mark.parametrize("name, codes", [("ansi2", (252, 253, 254, 255)), ("ansi3", (4, 3, 2, 1))])
def test_ansi_strings(spark, name, codes):
    skip, var, shell, lang = (bytes([c]) for c in codes)
    parts = [b"", b"ProgramFilesDir", b"Other", var + number(21) + b"\\a", skip + skip + b"x" + var + number(3) + var + number(14) + var + number(40), shell + b"\x80" + b"\x80", shell + bytes([0x23, 0x1A]), lang + number(300), b"cut" + var + b"\x81"]
    parts += [shell + bytes([0x80 | 1, 1]), shell + bytes([0xC0 | 1, 1]), shell + bytes([0x80 | 17, 1]), shell + bytes([0x0C, 0x0C])]
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p) + 1)
    got = decode(spark, name, b"\0".join(parts) + b"\0", [*at[:-1], at[3] + 4, 0xFFFFFFFF, 99999])
    same = skip.decode("latin-1")
    assert got == ["", "ProgramFilesDir", "Other", "$INSTDIR\\a", same + "x$3$R4$_8_", "$_ERROR_UNSUPPORTED_VALUE_REGISTRY_()", "$APPDATA", "$(LSTR_300)", "cut", "$PROGRAMFILES", "$PROGRAMFILES64", "$_ERROR_UNSUPPORTED_VALUE_REGISTRY_(Other)", "$$_ERROR_UNSUPPORTED_SHELL_[12,12]", "a", "$(LSTR_0)", "$_ERROR_STR_"]


def test_unicode_strings(spark):
    u = lambda s: s.encode("utf-16-le")
    w = lambda *n: struct.pack(f"<{len(n)}H", *n)
    block = u("é\0") + w(3) + number(22) + u("\\😀\0") + w(4, 3) + u("b\0") + w(1) + number(11270) + u("\0") + w(2, 0x1A25) + u("\0dangling") + w(3)
    assert decode(spark, "unicode3", block, [0, 2, 8, 12, 15, 18]) == ["é", "$OUTDIR\\😀", "\x03b", "$(LSTR_11270)", "$SYSDIR", "dangling"]
    block = w(0xE001, 0x8015) + u("x\0") + w(0xE000, 0xE001, 0) + w(0xE003, 0x8007, 0)
    assert decode(spark, "park", block, [0, 4, 7]) == ["$INSTDIRx", "\ue001", "$(LSTR_7)"]
    assert decode(spark, "unicode3", u("ab\0"), [0, 1, 2, 3, 5], n_chars=5) == ["ab", "b", "", "", "$_ERROR_STR_"]


def table(at, revision, total, exe=900, header=500, data=100, reserved=0):
    head = inno.MARK + struct.pack(">I", revision)
    body = struct.pack("<6I", total, exe, 7, 8, header, data) if revision == 1 else struct.pack("<QQIIQQI", total, exe, 7, 8, header, data, reserved)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def test_offset_tables(spark):
    def file(*parts):
        return bytearray((bytes(50) + b"".join(parts)).ljust(1000, b"\0"))

    bad = bytearray(table(50, 1, 1000))
    bad[30] ^= 1
    made = {
        "one": file(table(50, 1, 1000)), "two": file(table(50, 2, 1000)), "decoys": file(inno.MARK, bytes(bad), table(0, 1, 1000, exe=520), table(0, 2, 1000, reserved=1), table(0, 2, 999)),
        "long": file(table(50, 1, 1001)), "revision": file(table(50, 3, 1000)), "none": file(), "empty": bytearray(), "cut": bytearray(bytes(960) + table(0, 1, 1000)[:40]),
    }
    got = {r.path: (r.table_offset, r.revision, r.total_size, r.header_offset) for r in inno.offset_tables(spark.createDataFrame(list(made.items()), "path string, content binary")).collect()}
    assert got == {"one": (50, 1, 1000, 500), "two": (50, 2, 1000, 500), "decoys": (50 + 12 + 44 + 44 + 64, 2, 999, 500)}


def test_find_all_and_last(spark):
    cases = [b"", b"aa", b"aaaa", b"xaaxaa", b"\xff\n.aa", b"b" * 300 + b"aab" * 200, None]
    got = spark.createDataFrame([(None if b is None else bytearray(b),) for b in cases], "b binary").select("b", binary.find_all("b", b"aa").alias("all"), binary.find_last("b", b"aa").alias("last")).collect()
    for r in got:
        want = None if r.b is None else [i for i in range(len(r.b)) if r.b[i : i + 2] == b"aa"]
        assert (r["all"], r["last"]) == (want, want[-1] if want else None)


def test_chunks_and_bytes(spark):
    cases = [b"", b"x", bytes(range(256)) * 16, bytes(range(256)) * 33]
    chunk = lambda x: struct.pack("<I", zlib.crc32(x)) + x
    rows = [(bytearray(c), bytearray(b"".join(chunk(c[i : i + 4096]) for i in range(0, len(c), 4096)))) for c in cases]
    got = spark.createDataFrame(rows, "plain binary, chunks binary").select("plain", "chunks", binary.chunked("plain").alias("made"), binary.unchunked("chunks").alias("read"), binary.byte_sum("plain").alias("sum"), binary.head_inverted("plain", 300).alias("turned")).collect()
    for r in got:
        assert r.made == r.chunks and r.read == r.plain and r["sum"] == sum(r.plain) and r.turned == bytes(b ^ 255 for b in r.plain[:300]) + r.plain[300:]
    wrong = [b"\0\0\0\0", chunk(b"ab")[:-1], chunk(bytes(4096)) + b"\0\0\0\0", chunk(bytes(4096)) + b"\1"]
    assert [r.x for r in spark.createDataFrame([(bytearray(w),) for w in wrong], "b binary").select(binary.unchunked("b").alias("x")).collect()] == [None] * 4
