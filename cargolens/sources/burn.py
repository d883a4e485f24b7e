"""Bootstrapper manifests: payloads, containers and packages from XML, matched with the entries of the attached cabinets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions import names
from cargolens.functions.binary import decimal_text, inside, sha1_text
from cargolens.operators import joins, sets

_REF = "array<struct<_Id:string>>"
_PACKAGE = f"array<struct<_Id:string, PayloadRef:{_REF}>>"
PACKAGES = ("ExePackage", "MsiPackage", "MspPackage", "MsuPackage", "BundlePackage")
MANIFEST = f"""UX struct<Payload:array<struct<_Id:string,_FilePath:string,_SourcePath:string>>>,
Container array<struct<_Id:string,_FileSize:string,_Hash:string,_FilePath:string,_Attached:string>>,
Payload array<struct<_Id:string,_FilePath:string,_SourcePath:string,_FileSize:string,_Hash:string,_Container:string,_Packaging:string>>,
Chain struct<{", ".join(f"{p}:{_PACKAGE}" for p in PACKAGES)}>"""


def parsed(manifests: DataFrame) -> DataFrame:
    """(path, m, error) from manifests (path, xml). Documents with a type declaration are refused unread: entities can grow without bound."""
    refused = F.upper("xml").rlike("<!(DOCTYPE|ENTITY)")
    m = F.from_xml(F.when(~refused, F.col("xml")), MANIFEST, {"mode": "PERMISSIVE"})
    return manifests.select("path", m.alias("m"), F.when(refused, "document type refused").when(m.isNull(), "no manifest").alias("error"))


def payloads(documents: DataFrame) -> DataFrame:
    """(path, source_order, ordinal, container_type, payload_id, source_path, file_path, file_size, sha1, container, package_id,
    package_type, public_path) of parsed manifests: first those of the user interface, then those of the attached containers.

    A payload belongs to the package that refers to it first in the document."""
    ux = documents.select("path", F.posexplode("m.UX.Payload").alias("ordinal", "p"))
    ux = ux.select("path", "ordinal", F.lit("ux").alias("container_type"), F.col("p._Id").alias("payload_id"), F.col("p._SourcePath").alias("source_path"), F.col("p._FilePath").alias("file_path"), F.lit(None).cast("bigint").alias("file_size"), F.lit(None).cast("binary").alias("sha1"), F.lit(None).cast("string").alias("container"))
    own = documents.select("path", F.posexplode("m.Payload").alias("ordinal", "p"))
    own = own.select("path", "ordinal", F.lit("attached").alias("container_type"), F.col("p._Id").alias("payload_id"), F.col("p._SourcePath").alias("source_path"), F.col("p._FilePath").alias("file_path"), decimal_text("p._FileSize").alias("file_size"), sha1_text("p._Hash").alias("sha1"), F.col("p._Container").alias("container"))
    first = joins.first_wins(references(documents), ["path", "payload_id"], ["place", "ref"])
    listed = sets.ordered_union(ux, own).join(first.select("path", "payload_id", "package_id", "package_type"), ["path", "payload_id"], "left")
    return sets.suffix_collisions(listed, ["path"], "file_path", ["source_order", "ordinal"], ".burn-", "public_path")


def described(listed: DataFrame, containers: DataFrame) -> DataFrame:
    """Payload records with their place in the outer file and an info text, from payloads with (stream_offset, stream_size) in their
    container and containers (path, container, outer_offset, outer_size). A stream that leaves its container has a null place."""
    at = listed.join(containers, ["path", "container"], "left")
    start = F.when(inside("stream_offset", "stream_size", "outer_size"), F.expr("try_add(stream_offset, outer_offset)"))
    kind = F.when(F.col("container_type") == "ux", "WiX Burn UX payload").otherwise("WiX Burn attached payload")
    package = F.concat(F.lit("WiX Burn "), F.col("package_type"), F.lit(" package"), F.coalesce(F.concat(F.lit(" ("), F.nullif("package_id", F.lit("")), F.lit(")")), F.lit("")))
    moved = F.when(~F.col("public_path").eqNullSafe(F.col("file_path")), F.concat(F.lit("; manifest path: "), F.coalesce("file_path", F.lit("")))).otherwise("")
    info = F.concat(F.when(F.coalesce("package_type", F.lit("")) != "", package).otherwise(kind), moved)
    return at.withColumns({"stream_offset": start, "info": info}).drop("outer_offset", "outer_size")


def references(documents: DataFrame) -> DataFrame:
    """(path, package_type, place, package_id, ref, payload_id): every reference of a package to a payload."""
    out = None
    for k, kind in enumerate(PACKAGES):
        one = documents.select("path", F.posexplode(F.col(f"m.Chain.{kind}")).alias("i", "g")).select("path", F.lit(kind).alias("package_type"), (F.col("i") * len(PACKAGES) + k).alias("place"), F.col("g._Id").alias("package_id"), F.posexplode("g.PayloadRef").alias("ref", "r"))
        one = one.select("path", "package_type", "place", "package_id", "ref", F.col("r._Id").alias("payload_id"))
        out = one if out is None else out.unionByName(one)
    return out


def faults(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, error) of manifests that don't fit themselves or the entries (path, container, ordinal, name, size) of their cabinets."""
    listed = payloads(documents).where("container_type = 'attached'")
    containers = documents.select("path", F.explode("m.Container").alias("c")).select("path", F.col("c._Id").alias("container"))
    dangling = references(documents).join(listed.select("path", "payload_id"), ["path", "payload_id"], "left_anti").select("path", F.lit("reference without payload").alias("error"))
    homeless = listed.join(containers, ["path", "container"], "left_anti").select("path", F.lit("payload without container").alias("error"))
    twice = sets.duplicates(listed, F.struct("path", "payload_id"), "k").select("k.path", F.lit("two payloads of one id").alias("error"))
    unsafe = listed.where(~F.coalesce(names.safe_path(F.replace("file_path", F.lit("\\"), F.lit("/"))), F.lit(False))).select("path", F.lit("unsafe path").alias("error"))
    place = F.row_number().over(Window.partitionBy("path", "container").orderBy("ordinal")) - 1
    want = listed.withColumn("place", place).select("path", "container", F.col("source_path").alias("name"), "file_size", "place")
    both = want.join(entries, ["path", "container", "name"], "full_outer")
    differ = both.where(F.col("place").isNull() | entries["ordinal"].isNull() | (F.col("place") != entries["ordinal"]) | (F.col("file_size") != F.col("size")))
    parts = [documents.where("error is not null").select("path", "error"), dangling, homeless, twice, unsafe, differ.select("path", F.lit("entries differ from payloads").alias("error"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("path").agg(F.min("error").alias("error"))
