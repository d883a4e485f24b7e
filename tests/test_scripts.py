"""Scripts, ini files, footers, trees and checksums built byte by byte."""

import struct

from cargolens.sources import scripts
from pyspark.sql import functions as F


def test_script_files(spark):
    header = b"HEAD" + b"".join(struct.pack("<7I", *c) for c in [(20, 0, 1, 50, 0, 0, 0), (11, 0, 1, 0, 0, 0, 0), (20, 0, 1, 10, 0, 0, 0)])
    got = scripts.commands(spark.createDataFrame([("p", bytearray(header), 4, 9)], "path string, header binary, entries_at int, n_entries int")).collect()
    assert [(r.script_index, r.opcode, r.p2) for r in got] == [(0, 20, 50), (1, 11, 0), (2, 20, 10)]
    rows = [
        (0, 20, 0, 1, 50, None, "a.txt"), (1, 11, 0, 1, 0, "$INSTDIR\\sub", None), (2, 20, 0, 1, 10, None, "b.txt"), (3, 11, 0, 0, 0, "$TEMP", None), (4, 11, 0, 1, 0, "$OUTDIR\\deep", None),
        (5, 20, 0, 1, 10, None, "c.txt"), (6, 20, 0, 1, 10, None, "c.txt"), (7, 20, 0, 1, 5, None, "$SYSDIR\\d.dll"), (8, 62, 0, 70, 0, "un.exe", None),
    ]
    script = spark.createDataFrame([("p", *r) for r in rows], "path string, script_index int, opcode long, p0 long, p1 long, p2 long, text0 string, text1 string")
    got = [(r.script_index, r.pos, r.name, r.folder) for r in scripts.script_files(script).orderBy("pos", "script_index").collect()]
    assert got == [(7, 5, "$SYSDIR/d.dll", None), (2, 10, "sub/b.txt", "sub"), (5, 10, "sub/deep/c.txt", "sub/deep"), (0, 50, "a.txt", ""), (8, 70, "sub/deep/un.exe", "sub/deep")]


def test_ini_names(spark):
    text = "[Other]\n1=x\r\n[FILES]\r\n0=C:\\in\\a.txt?7\r\n 2 = b.bin \nx=1\n=2\n3=CON\n4=dir/\n[End]\n5=z"
    texts = spark.createDataFrame([("ok", text), ("twice", "[files]\n1=a\n1=b")], "path string, text string")
    assert sorted(map(tuple, scripts.ini_names(texts).collect())) == [("ok", 0, "a.txt"), ("ok", 2, "b.bin")]


def footer(at, n=3, digest=b"0123456789abcdefABCDEF0123456789", version=100):
    return struct.pack("<7I", 0, at, n, version, at, 50, 20) + digest + b"\0" * 4 + scripts.MARK


def test_advanced_footers(spark):
    body = b"MZ" + bytes(98)
    made = {"ok": body + footer(100), "version": body + footer(100, version=99), "digest": body + footer(100, digest=b"x" * 32), "two": body + footer(100) + footer(174), "decoy": body + footer(100) + scripts.MARK, "none": body}
    got = scripts.advanced_footers(spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")).collect()
    assert {(r.path, r.footer_offset, r.n_files) for r in got} == {("ok", 100, 3), ("decoy", 100, 3)}


def node(i, kind, children, name, size=0, stored=0):
    head = struct.pack("<III", i, kind, children) + name.encode("utf-16-le") + b"\0\0"
    return head + (bytes(30) if kind == 1 else bytes(3) + struct.pack("<Q", size) + bytes(39) + struct.pack("<Q", stored))


def test_tree_files(spark):
    nodes = [node(1, 1, 2, "dir"), node(2, 2, 0, "é.txt", 5, 4), node(3, 1, 1, "sub"), node(4, 2, 0, "b", 9, 9), node(5, 2, 0, "c", 1, 1)]
    head = b"EVB\0" + bytes(0x48) + struct.pack("<I", 2) + bytes(3)
    made = {"ok": head + b"".join(nodes), "cut": head + b"".join(nodes)[:-9], "same": head + b"".join([*nodes[:4], node(4, 2, 0, "c")]), "kind": head + b"".join([*nodes[:4], node(9, 3, 0, "c")]), "bad": head + nodes[0] + nodes[1].replace("é".encode("utf-16-le"), b"\x00\xd8"), "empty": head[:0x4C] + bytes(7) + b"x"}
    got = scripts.tree_files(spark.createDataFrame([(k, bytearray(v), 1000) for k, v in made.items()], "path string, tree binary, data_at long")).collect()
    assert sorted((r.path, r.record_index, r.name, r.size, r.stored_size, r.offset) for r in got) == [("ok", 0, "é.txt", 5, 4, 1000), ("ok", 1, "b", 9, 9, 1004), ("ok", 2, "c", 1, 1, 1013)]


def test_block_checksum(spark):
    def plain(data, seed):
        while len(data) >= 4:
            seed, data = seed ^ struct.unpack("<I", data[:4])[0], data[4:]
        return seed ^ int.from_bytes(data, "big")

    blocks = [bytes(range(k, k + n)) for n in range(10) for k in (0, 90)]
    got = spark.createDataFrame([(bytearray(b),) for b in blocks], "b binary").select("b", scripts.block_checksum(F.col("b"), F.lit(77)).alias("c")).collect()
    assert all(r.c == plain(bytes(r.b), 77) for r in got)
