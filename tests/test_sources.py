"""Containers built byte by byte: what is read, and what is refused."""

import random
import time
import bz2
import lzma
import struct
import zlib

import pytest
from cargolens.functions import binary, names, staging
from cargolens.operators import aggregates, joins, sets, trees, windows
from cargolens.sources import burn, detect, files, isdf, msi, sinks
from cargolens.streaming import arrivals
from pyspark.sql import functions as F


def archive(entries, cut=None, flip=False):
    head = b"MZ junk Inno Setup Setup Data (5.5.0)\0ISDF" + struct.pack("<IQ", len(entries), 0)
    at = len(head) + sum(22 + len(n.encode()) for n, _ in entries)
    table, body = b"", b""
    for n, d in entries:
        n = n.encode()
        table += struct.pack("<H", len(n)) + n + struct.pack("<QQI", at + len(body), len(d), zlib.crc32(d) ^ flip)
        body += d
    return (head + table + body)[:cut]


def frame(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_isdf_extracts_and_keeps_a_truncated_prefix(spark):
    entries = [("a.txt", b"hello"), ("dé/b.bin", bytes(range(256))), ("", b"")]
    cut = len(archive(entries)) - 256 - 5 - 30
    found = frame(spark, {"ok": archive(entries), "bad": archive(entries, flip=True), "cut": archive(entries, cut), "short": archive(entries)[:-10], "none": b"MZ", "sig": b"Inno Setup Setup Data" + b"x" * 300})
    rows = isdf.payloads(found, isdf.records(found)).collect()
    by = lambda p: {r.original_name: r for r in rows if r.path == p}
    assert {n: bytes(r.data) for n, r in by("ok").items()} == dict(entries) and all(r.crc_ok and r.size_ok for r in by("ok").values())
    assert not any(r.crc_ok for r in by("bad").values())
    assert 0 < len(by("cut")) < 3
    assert [n for n, r in by("short").items() if not r.crc_ok] == ["dé/b.bin"] and not by("short")["dé/b.bin"].size_ok
    assert not by("none") and not by("sig")


def pe(sections, tail=b""):
    head = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, len(sections), 0, 0, 0, 0, 0))
    at = len(head) + 40 * len(sections)
    body = b""
    for name, data in sections:
        head += name.encode().ljust(8, b"\0") + struct.pack("<IIII", len(data), 0x1000, len(data), at + len(body)) + bytes(16)
        body += data
    return bytes(head) + body + tail


def test_detections(spark):
    evb = b"EVB\0" + bytes(16) + struct.pack("<I", 2) + bytes(80)
    made = {
        "nsis": pe([(".text", b"x" * 9)], b"....NullsoftInst v3.08 "),
        "inno": b"??Inno Setup Setup Data (6.2.0) u\0",
        "old": b"Inno Setup: Setup Data v1.3.2_a",
        "au5": bytes(30) + b"AU3!EA05",
        "au6": bytes(30) + b"AU3!EA06",
        "evb": pe([(".enigma1", evb), (".enigma2", b"12")]),
        "evb2": pe([(".enigma1", evb), (".enigma1", evb), (".enigma2", b"12")]),
        "gentee": pe([(".gentee", b"lzge_decode")]),
        "burn": pe([(".wixburn", bytes(48))]),
        "boxed": pe([(".bxpck", b"1"), (".main", b"2")]),
        "upx": pe([("UPX0", b"UPX!\0")]),
        "ai": pe([(".text", b"1")], bytes(64) + b"ADVINSTSFX"),
        "msi": bytes.fromhex("d0cf11e0a1b11ae1") + bytes(99),
        "7z": pe([(".text", b"7z\xbc\xaf\x27\x1c")], b"..7z\xbc\xaf\x27\x1c.."),
        "stub": pe([(".text", b"Rar!")]),
        "empty": b"",
        "text": b"nothing here",
    }
    got = {(r.path, r.format): r for r in detect.detections(frame(spark, made)).collect()}
    assert set(got) == {("nsis", "nsis"), ("inno", "inno"), ("old", "inno"), ("au5", "autoit"), ("au6", "autoit"), ("evb", "enigma"), ("gentee", "createinstall"), ("burn", "burn"), ("boxed", "boxedapp"), ("upx", "upx"), ("ai", "advanced"), ("msi", "compound"), ("7z", "sfx-7z")}
    assert got["nsis", "nsis"].version == "3.08" and got["inno", "inno"].version == "6.2.0" and got["old", "inno"].version == "1.3.2_"
    assert got["evb", "enigma"].version == "package v2" and got["au6", "autoit"].version == "EA06 (unsupported)"
    assert got["7z", "sfx-7z"].offset == made["7z"].rindex(b"7z")


def test_scalar_numbers(spark):
    data = bytes.fromhex("efbeadde0102030405060708ffffffffffffffff")
    row = spark.createDataFrame([(bytearray(data),)], "d binary").select(
        binary.little("d", 0, 4), binary.little("d", 4, 2), binary.little("d", 4, 3), binary.little("d", 4, 8), binary.little("d", 12, 8), binary.little("d", 19, 2), binary.big("d", 0, 4),
        binary.all_zero(F.lit(bytearray(3))), binary.all_zero("d"), binary.align_up(F.lit(17), 16), binary.rotate_left(F.lit(0x81), 1, 8), binary.inside(F.lit(5), F.lit(2**62), F.lit(10)), binary.decimal_text(F.lit("12a")), binary.decimal_text(F.lit("0012")),
        binary.sha1_text(F.lit("zz")), binary.apart(F.lit(0), F.lit(4), F.lit(4), F.lit(1)), binary.apart(F.lit(0), F.lit(5), F.lit(4), F.lit(1)),
    ).first()
    assert list(row) == [0xDEADBEEF, 0x0201, 0x030201, 0x0807060504030201, None, None, 0xEFBEADDE, True, False, 32, 3, False, None, 12, None, True, False]


def test_malformed_text_is_null(spark):
    texts = {"aé😀".encode("utf-16-le"): "aé😀", b"\x00\xd8a\x00": None, b"\x00\xdc": None, b"a": None, b"": ""}
    got = {bytes(r[0]): r[1] for r in spark.createDataFrame([(bytearray(k),) for k in texts], "b binary").select("b", binary.utf16("b")).collect()}
    assert got == texts
    row = spark.range(1).select(binary.utf8(F.lit(bytearray(b"\xff"))), binary.utf8(F.lit(bytearray("é".encode()))), binary.ascii_text(F.lit(bytearray(b"a\x80"))), binary.ascii_text(F.lit(bytearray(b"a")))).first()
    assert list(row) == [None, "é", None, "a"]


def test_signed_cells_of_all_values(spark):
    got = {r[0]: r[1] for r in spark.range(65536).select("id", binary.signed_cell(F.col("id"), 16)).collect()}
    assert got == {i: None if i == 0 else struct.unpack("<h", struct.pack("<H", i ^ 0x8000))[0] for i in range(65536)}


def test_names(spark):
    listed = ["a.txt", "", ".", "..", "con", "CON.txt", "com1", "com10", "x.", "x ", "a:b", "a\\b", "n" * 255, "n" * 256, "é"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in listed], "n string").select("n", names.safe_name("n")).collect()}
    assert {k for k, v in got.items() if v} == {"a.txt", "com10", "n" * 255, "é"}
    row = spark.range(1).select(
        names.long_name(F.lit("SHORT|long|er")), names.long_name(F.lit("one")), names.target_and_source(F.lit("t:s:u")), names.reduced(F.lit("$instdir\\a\\b")), names.or_default(F.lit(""), "file_%04d", F.lit(7)),
        names.volume_name(F.lit("disk%03i.pak"), F.lit(5)), names.utf16_base64(F.lit("YQBiAA==")), names.utf16_base64(F.lit("YQBi")), names.safe_path(F.lit("/".join("a" * 256))), names.safe_path(F.lit("/".join("a" * 257))), names.safe_path(F.lit("a//b")),
    ).first()
    assert row[0] == "long|er" and row[1] == "one" and tuple(row[2]) == ("t", "s:u") and row[3] == "a/b" and row[4] == "file_0007" and row[5] == "disk005.pak" and row[6] == "ab" and row[7] is None and list(row)[8:] == [True, False, False]
    folded = {r[0] for r in spark.createDataFrame([("É",), ("é",), ("é",)], "n string").select(names.folded("n")).collect()}
    assert folded == {"é"}


def database(tables, catalog=None, codepage=65001):
    """Streams of a database: tables {name: (columns {name: is_string}, rows)}."""
    texts = []

    def ref(s):
        if s == "":
            return 0
        if s not in texts:
            texts.append(s)
        return texts.index(s) + 1

    columns = [(ref(t), 0x8000 + i + 1, ref(c), 0x8000 ^ (0xD00 if s else 0x104)) for t, (cols, _) in tables.items() for i, (c, s) in enumerate(cols.items())]
    columns = catalog(columns) if catalog else columns
    streams = {"_Columns": b"".join(struct.pack("<H", r[k]) for k in range(4) for r in columns)}
    for t, (cols, rows) in tables.items():
        streams[t] = b"".join(struct.pack("<H", ref(r[k])) if s else struct.pack("<I", 0 if r[k] is None else (r[k] + 2**31) % 2**32) for k, s in enumerate(cols.values()) for r in rows)
    raw = [s.encode("utf-8" if codepage == 65001 else "cp1252") for s in texts]
    pool = struct.pack("<HH", codepage, 0)
    for x in raw:
        pool += (struct.pack("<HH", 0, len(x) >> 16) if len(x) >> 16 else b"") + struct.pack("<HH", len(x) & 0xFFFF, 1)
    return streams | {"_StringPool": pool, "_StringData": b"".join(raw)}


TABLES = {
    "File": ({"File": True, "Component_": True, "FileName": True, "FileSize": False, "Attributes": False, "Sequence": False}, [("f1", "C1", "A~1|alpha.txt", 5, None, 1), ("f2", "c1", "beta", 7, 0x4000, 2), ("f3", "C2", "ALPHA.txt", None, None, 3), ("f4", "C1", "Alpha.TXT", 1, None, 4)]),
    "Media": ({"DiskId": False, "LastSequence": False, "Cabinet": True}, [(1, 2, "one.cab"), (2, 4, "")]),
    "Component": ({"Component": True, "Directory_": True}, [("C1", "APP"), ("C2", "SUB")]),
    "Directory": ({"Directory": True, "Directory_Parent": True, "DefaultDir": True}, [("TARGETDIR", "", "SourceDir"), ("APP", "TARGETDIR", "A|App:src"), ("SUB", "app", "Sub"), ("DOT", "SUB", ".")]),
}


def streams_of(spark, made):
    return spark.createDataFrame([(p, n, bytearray(d)) for p, s in made.items() for n, d in s.items()], "path string, name string, data binary")


def read(spark, made):
    catalog, cells = msi.tables(streams_of(spark, made))
    return catalog, [msi.relation(cells, n, f) for n, f in (("File", msi.FILE), ("Media", msi.MEDIA), ("Component", msi.COMPONENT), ("Directory", msi.DIRECTORY))]


def changed(table, row, **values):
    columns, rows = TABLES[table]
    rows = [tuple(values.get(c, x) for c, x in zip(columns, r, strict=True)) if i == row else r for i, r in enumerate(rows)]
    return TABLES | {table: (columns, rows)}


def test_msi_installed_files(spark):
    made = {
        "ok": database(TABLES),
        "orphan": database(changed("File", 1, Component_="C9")),
        "nowhere": database(changed("Component", 1, Directory_="GONE")),
        "cycle": database(changed("Directory", 1, Directory_Parent="SUB")),
        "range": database(changed("Media", 1, LastSequence=3)),
        "both": database(changed("File", 0, Attributes=0x6000)),
        "unsafe": database(changed("File", 0, FileName="..")),
        "twice": database(changed("File", 1, File="F1")),
    }
    _, relations = read(spark, made)
    placed = msi.placed(*relations).collect()
    got = sorted((r.path, r.key, r.name, r.disk_id, r.cabinet, r.size, r.compressed) for r in placed if r.error is None)
    assert got == [
        ("ok", "f1", "App/alpha.txt", 1, "one.cab", 5, False), ("ok", "f2", "App/beta", 1, "one.cab", 7, True), ("ok", "f3", "App/Sub/ALPHA.txt", 2, "", 0, False), ("ok", "f4", "__msi/id_f4/Alpha.TXT", 2, "", 1, False),
    ]
    errors = {r.path: r.error for r in placed if r.error}
    assert set(errors) == set(made) - {"ok"} and errors["orphan"] == "file without component"


def test_msi_strings_and_catalog(spark):
    long = "L" * 70_000
    tables = {"T": ({"A": True, "N": False}, [(long, 1), ("", -2), ("“x”", 2**31 - 1)])}
    made = {"utf8": database(tables), "ansi": database(tables, codepage=1252), "gap": database(tables, lambda c: [c[0], (c[1][0], 0x8003, *c[1][2:])]), "same": database(tables, lambda c: [c[0], (*c[1][:2], c[0][2], c[1][3])])}
    catalog, cells = msi.tables(streams_of(spark, made))
    assert {(r.path, r.error) for r in catalog.where("error is not null").collect()} >= {("gap", "column numbers are not 1 to n"), ("same", "two columns of one name")}
    got = sorted((r.path, r.table_order, r.a, r.n) for r in msi.relation(cells, "t", {"a": ("a", "text"), "n": ("n", "number")}).collect())
    assert got == sorted((p, i, *r) for p in ("utf8", "ansi") for i, r in enumerate(tables["T"][1]))


def test_msi_stream_names(spark):
    alphabet = msi.ALPHABET
    encode = lambda s: "䡀" + "".join(chr(0x3800 + alphabet.index(a) + 64 * alphabet.index(b)) for a, b in zip(s[::2], s[1::2], strict=False)) + (chr(0x4800 + alphabet.index(s[-1])) if len(s) % 2 else "")
    got = [r[0] for r in spark.createDataFrame([(encode("_Columns"),), (encode("Media"),), ("\x05Sum",)], "n string").select(msi.stream_name(F.col("n"))).collect()]
    assert got == ["_Columns", "Media", "\x05Sum"]


MANIFEST = """<BurnManifest><UX><Payload Id="u1" FilePath="wix.dll" SourcePath="u1"/></UX>
<Container Id="WixAttachedContainer" FileSize="10" Hash="{0}" FilePath="x.exe" Attached="yes"/>
<Payload Id="p1" FilePath="a.msi" SourcePath="a1" FileSize="5" Hash="{0}" Container="WixAttachedContainer" Packaging="embedded"/>
<Payload Id="p2" FilePath="A.msi" SourcePath="a2" FileSize="6" Hash="{0}" Container="WixAttachedContainer" Packaging="embedded"/>
<Payload Id="p3" FilePath="a.burn-2.msi" SourcePath="a3" FileSize="7" Hash="{0}" Container="WixAttachedContainer" Packaging="embedded"/>
<Chain><MsiPackage Id="M"><PayloadRef Id="p1"/><PayloadRef Id="p2"/></MsiPackage><ExePackage Id="E"><PayloadRef Id="p2"/></ExePackage></Chain></BurnManifest>""".format("ab" * 20)


def test_burn_manifest(spark):
    docs = spark.createDataFrame([("ok", MANIFEST), ("ref", MANIFEST.replace('PayloadRef Id="p1"', 'PayloadRef Id="p9"')), ("dtd", "<!DOCTYPE x [<!ENTITY a 'b'>]>" + MANIFEST), ("up", MANIFEST.replace("a.burn-2.msi", "../x"))], "path string, xml string")
    parsed = burn.parsed(docs)
    got = {r.payload_id: r for r in burn.payloads(parsed).where("path = 'ok'").collect()}
    assert {k: r.public_path for k, r in got.items()} == {"u1": "wix.dll", "p1": "a.msi", "p2": "A.burn-3.msi", "p3": "a.burn-2.msi"}
    assert got["p1"].package_id == "M" and got["p2"].package_id in ("M", "E") and got["p3"].package_id is None and got["p1"].file_size == 5 and bytes(got["p1"].sha1) == b"\xab" * 20
    cab = [(p, "WixAttachedContainer", i, n, s) for p in ("ok", "ref", "up") for i, (n, s) in enumerate([("a1", 5), ("a2", 6), ("a3", 7)])]
    entries = spark.createDataFrame(cab, "path string, container string, ordinal int, name string, size long")
    errors = {r.path: r.error for r in burn.faults(parsed, entries).collect()}
    assert errors == {"ref": "reference without payload", "dtd": "document type refused", "up": "unsafe path"}
    assert "ok" in {r.path for r in burn.faults(parsed, entries.where("ordinal > 0")).collect()}


def test_siblings_and_volumes(spark):
    found = spark.createDataFrame([("/d/A.cab",), ("/d/b.CAB",), ("/d/B.cab",), ("/e/a.cab",), ("/d/x/y.bin",)], "path string")
    wanted = spark.createDataFrame([(1, "/d", "a.CAB"), (2, "/d", "b.cab"), (3, "/f", "a.cab")], "id int, directory string, sibling string")
    assert {r.id: r.sibling_path for r in files.sibling(wanted, found, ["id"]).collect()} == {1: "/d/A.cab", 2: None, 3: None}
    below = spark.createDataFrame([(1, "/d", "x/y.bin"), (2, "/d/x", "../A.cab")], "id int, root string, relative string")
    assert {r.id: r.descendant_path for r in files.descendant(below, found).collect()} == {1: "/d/x/y.bin", 2: None}
    vols = [("ok", 1, "g", b"HHab"), ("ok", 2, "g", b"HHcd"), ("gap", 1, "g", b"HHa"), ("gap", 3, "g", b"HHb"), ("mix", 1, "g", b"HHa"), ("mix", 2, "h", b"HHb")]
    got = {r.name: r for r in files.joined_volumes(spark.createDataFrame([(n, v, g, bytearray(d)) for n, v, g, d in vols], "name string, volume int, package_id string, data binary"), ["name"], 2).collect()}
    assert bytes(got["ok"].data) == b"abcd" and got["gap"].error and got["mix"].error and got["gap"].data is None
    names_ = files.volume_names(spark.createDataFrame([("disk%02i.pak", 3)], "pattern string, volumes int")).select("volume_name").collect()
    assert [r[0] for r in names_] == ["disk01.pak", "disk02.pak", "disk03.pak"]


def test_sinks(spark, tmp_path):
    data = b"payload " * 50
    coded = {"store": data, "zlib": zlib.compress(data), "deflate": zlib.compress(data, wbits=-15), "bzip2": bz2.compress(data), "lzma": lzma.compress(data, lzma.FORMAT_ALONE)}
    rows = [(m, m, bytearray(d), len(data), zlib.crc32(data), "aa", None) for m, d in coded.items()] + [("cut", "zlib", bytearray(coded["zlib"][:-6]), len(data), None, None, None), ("odd", "ppmd", bytearray(b"x"), 1, None, None, None), ("crc", "store", bytearray(data), len(data), 1, None, None)]
    frame_ = spark.createDataFrame(rows, "format string, method string, raw binary, uncompressed_size long, result_crc long, checksum string, checksum_type string").withColumn("checksum", F.when(F.col("checksum") == "aa", F.lit(__import__("hashlib").sha1(data).hexdigest().upper()))).withColumn("checksum_type", F.when(F.col("checksum").isNotNull(), "SHA1"))
    out = sinks.verified(frame_.withColumn("data", sinks.decoded("method", "raw")))
    assert {r.format: r.error for r in out.collect()} == dict.fromkeys(coded) | {"cut": "not decoded", "odd": "not decoded", "crc": "CRC differs"}
    sinks.write(out, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(coded)
    assert sinks.decode_bytes("zlib", coded["zlib"], most=10) is None and sinks.decode_bytes("store", data, most=10) is None


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.exe").write_bytes(archive([("a", b"x")]))
    (tmp_path / "in/b.exe").write_bytes(bytes(30) + b"AU3!EA05")
    stream = arrivals.detected(arrivals.arriving(spark, f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    q.awaitTermination(120)
    assert {r.format for r in spark.sql("select format from arrived").collect()} == {"inno", "autoit"}
    assert arrivals.counts(arrivals.arriving(spark, f"{tmp_path}/in")).isStreaming
    assert files.files(spark, f"{tmp_path}/in").count() == 2


def test_trees(spark):
    nodes = [("r", None, "root"), ("a", "r", "a"), ("b", "a", "b"), ("x", "y", "x"), ("y", "x", "y"), ("z", "gone", "z"), ("s", "s", "self")] + [(f"n{i}", f"n{i - 1}" if i else None, "n") for i in range(300)]
    got = {r.key: (r.path, r.depth) for r in trees.paths(spark.createDataFrame(nodes, "k string, p string, n string"), "k", "p", "n").collect()}
    assert got["b"] == ("root/a/b", 2) and got["s"] == ("self", 0) and got["x"] == got["y"] == got["z"] == (None, None)
    assert got["n256"][1] == 256 and got["n257"] == (None, None)


def test_wide_range_join_equals_plain(spark):
    bounds = spark.range(1, 40).select(F.col("id").alias("o"), (F.col("id") * F.col("id")).alias("last"))
    items = spark.range(-5, 1700).select(F.col("id").alias("v"))
    plain = joins.range_join(items, bounds, "v", "last", "o")
    old = joins.FEW_BOUNDS
    try:
        joins.FEW_BOUNDS = 1
        wide = joins.range_join(items, bounds, "v", "last", "o")
    finally:
        joins.FEW_BOUNDS = old
    key = lambda f: sorted((r.v, r.o) for r in f.collect())
    assert key(plain) == key(wide) and len(key(plain)) == 39 * 39


def test_checked_join_fails_on_orphans(spark):
    child, parent = spark.createDataFrame([(1, 9)], "a int, fk int"), spark.createDataFrame([(1,)], "pk int")
    with pytest.raises(Exception, match="fk without pk"):
        joins.checked_join(child, parent, "fk", "pk").collect()


def test_small_checks(spark):
    rows = spark.createDataFrame([("f", 0, 5, 100), ("f", 5, 9, 100), ("f", 20, 30, 100), ("g", 3, 4, 10)], "path string, s int, e int, size int")
    assert {(r.path, r.s): r.gap for r in windows.gap_to_next(rows, ["path"], "s", "e", "size").collect()} == {("f", 0): 0, ("f", 5): 11, ("f", 20): 70, ("g", 3): 6}
    listed = spark.createDataFrame([("p", i, n) for i, n in enumerate(["a.x", "a.x", "A.x", "a.c-2.x", "b", "a.c-3.x", "a.x"])], "path string, i int, n string")
    got = [r.u for r in sets.suffix_collisions(listed, ["path"], "n", ["i"], ".c-", "u").orderBy("i").collect()]
    assert len({x.lower() for x in got}) == 7 and got[0] == "a.x" and got[3] == "a.c-2.x"
    assert trees.roots(spark.createDataFrame([("p", "a", None), ("p", "b", "a"), ("p", "c", "c")], "path string, k string, up string"), ["path"], "k", "up").first().roots == 2
    assert aggregates.dependency_violations(spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, None)], "k int, v int"), ["k"], ["v"]).collect()[0].k == 2


def test_staged_tables_are_cleared(spark):
    staged = staging.table(spark.range(5), "five")
    assert staged.count() == 5
    staging.clear(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        staging.table(spark.range(5), "five").count()
        staged.count()


def test_root_class_and_attribution(spark):
    def compound(first, tail=detect.CLASS_TAIL):
        head = bytearray(512)
        head[:8], head[30:32], head[48:52] = detect.COMPOUND, struct.pack("<H", 9), struct.pack("<I", 1)
        root = bytearray(512)
        root[0x50], root[0x51:0x60] = first, tail
        return bytes(head) + bytes(512) + bytes(root)

    rows = [("database", compound(0x84)), ("patch", compound(0x86)), ("transform", compound(0x82)), ("other", compound(0x85)), ("tail", compound(0x84, bytes(15))), ("cut", compound(0x84)[:1100]), ("none", b"x" * 2000)]
    got = {r.path: r.c for r in spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").select("path", detect.root_class(F.col("content")).alias("c")).collect()}
    assert got == {p: p if p in ("database", "patch", "transform") else None for p, _ in rows}
    marks = [(1, b"stub sfxrar Rar!", 11), (2, b"stub Rar! sfxrar", 5), (3, b"", 0)]
    got = spark.createDataFrame([(i, bytearray(c), e) for i, c, e in marks], "i int, content binary, e int").select("i", detect.attributed(F.col("content"), F.col("e"), detect.STUBS["rar"]).alias("a"))
    assert {r.i: r.a for r in got.collect()} == {1: True, 2: False, 3: False}


def test_burn_records_are_rebased_and_described(spark):
    listed = spark.createDataFrame(
        [
            ("b", "c1", "attached", 10, 20, "MsiPackage", "p1", "a.txt", "a.txt"),
            ("b", "c1", "attached", 90, 20, None, None, "b.burn-2.txt", "b.txt"),
            ("b", None, "ux", 0, 5, None, None, "u", "u"),
            ("b", "c1", "attached", 0, 100, "ExePackage", "", "e", None),
        ],
        "path string, container string, container_type string, stream_offset long, stream_size long, package_type string, package_id string, public_path string, file_path string",
    )
    outer = spark.createDataFrame([("b", "c1", 1000, 100)], "path string, container string, outer_offset long, outer_size long")
    got = {r.public_path: (r.stream_offset, r.info) for r in burn.described(listed, outer).collect()}
    assert got == {
        "a.txt": (1010, "WiX Burn MsiPackage package (p1)"),
        "b.burn-2.txt": (None, "WiX Burn attached payload; manifest path: b.txt"),
        "u": (None, "WiX Burn UX payload"),
        "e": (1000, "WiX Burn ExePackage package; manifest path: "),
    }


def test_range_join_paths_agree(spark, monkeypatch):
    rng = random.Random(3)
    edges = sorted(rng.sample(range(1, 2000), 150))
    bounds = spark.createDataFrame([(i, x) for i, x in enumerate(edges)], "i int, last long")
    values = [(k, rng.randrange(-5, 2100)) for k in range(400)]
    items = spark.createDataFrame(values, "k int, v long").repartition(3)
    want = sorted((k, next((i for i, x in enumerate(edges) if v <= x), None) if v > 0 else None) for k, v in values)
    for few in (10_000, 10):
        monkeypatch.setattr(joins, "FEW_BOUNDS", few)
        left = joins.range_join(items, bounds, "v", "last", "i", how="left")
        assert left.columns == ["k", "v", "i", "last", "lower"]
        assert sorted((r.k, r.i) for r in left.collect()) == want
        assert sorted((r.k, r.i) for r in joins.range_join(items, bounds, "v", "last", "i").collect()) == [w for w in want if w[1] is not None]


def test_readers_take_large_containers(spark):
    n = 20_000
    names_ = [f"n{i}.txt".encode() for i in range(n)]
    start, data, listed = len(isdf.SIGNATURE) + 16 + sum(len(x) + 22 for x in names_), b"", b""
    for i, x in enumerate(names_):
        d = b"x" * 50 + str(i).encode()
        listed += struct.pack("<H", len(x)) + x + struct.pack("<QQI", start + len(data), len(d), zlib.crc32(d))
        data += d
    found = spark.createDataFrame([("a", bytearray(isdf.SIGNATURE + isdf.MARK + struct.pack("<IQ", n, start) + listed + data))], "path string, content binary")
    pool = struct.pack("<HH", 65001, 0) + b"".join(struct.pack("<HH", len(str(i)), 1) for i in range(60_000))
    streams = spark.createDataFrame([("a", "_StringPool", bytearray(pool)), ("a", "_StringData", bytearray("".join(map(str, range(60_000))).encode()))], "path string, name string, data binary")
    began = time.perf_counter()
    assert isdf.payloads(found, isdf.records(found)).where("crc_ok and size_ok").count() == n
    assert msi.string_pool(streams).where("value = cast(string_id - 1 as string)").count() == 60_000
    assert time.perf_counter() - began < 60
