"""Names and paths inside containers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cargolens.functions.binary import utf16

#: Device names that Windows reserves, and characters that no name may have.
RESERVED = r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
FORBIDDEN = r"""[. ]$|[<>:"\\|?*]"""
LONGEST_NAME, MOST_PARTS = 255, 256


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def before_first(name, separator: str) -> Column:
    """Text before the first separator; all of it where there is none."""
    return F.substring_index(_c(name), separator, 1)


def after_first(name, separator: str) -> Column:
    """Text after the first separator; all of it where there is none."""
    at = F.instr(_c(name), separator)
    return F.when(at > 0, F.substr(_c(name), at + len(separator))).otherwise(_c(name))


def long_name(name) -> Column:
    """The long one of a `short|long` pair."""
    return after_first(name, "|")


def target_and_source(name) -> Column:
    """A `target:source` directory as a struct; without a separator both are the same."""
    return F.struct(before_first(name, ":").alias("target"), after_first(name, ":").alias("source"))


def safe_name(name) -> Column:
    """A single path part that every Windows file system takes as it is."""
    n = _c(name)
    return F.length(n).between(1, LONGEST_NAME) & ~n.isin(".", "..") & ~n.rlike(FORBIDDEN) & ~F.lower(n).rlike(RESERVED)


def safe_path(path) -> Column:
    """A relative path of safe parts."""
    parts = F.split(_c(path), "/")
    return (F.size(parts) <= MOST_PARTS) & F.forall(parts, safe_name)


def reduced(name) -> Column:
    """A script's path below its install folder, with forward slashes."""
    return F.replace(F.regexp_replace(_c(name), r"(?i)^\$INSTDIR\\", ""), F.lit("\\"), F.lit("/"))


def or_default(name, pattern: str, index) -> Column:
    """The name, or where it is null or empty one from its index."""
    return F.coalesce(F.nullif(_c(name), F.lit("")), F.format_string(pattern, _c(index)))


def version_text(name, pattern: str) -> Column:
    return F.regexp_extract(_c(name), pattern, 1)


def version(*parts) -> Column:
    """Up to four numbers of a version as a struct, which compares as versions do; absent ones are 0."""
    whole = [*(_c(p) if isinstance(p, str | Column) else F.lit(p) for p in parts), *[F.lit(0)] * (4 - len(parts))]
    return F.struct(*(p.cast("bigint").alias(n) for p, n in zip(whole, ("major", "minor", "patch", "revision"), strict=True)))


# The record type that a name's extension asks for.
RECORD_TYPES = {".msi": 1, ".cab": 7, ".ini": 0}


def type_agrees(name, record_type) -> Column:
    """Whether a record's type is the one of its name's extension; other extensions have none."""
    out = F.lit(False)
    for extension, number in RECORD_TYPES.items():
        out = F.when(F.lower(_c(name)).endswith(extension), _c(record_type) == number).otherwise(out)
    return out


def volume_name(pattern, index) -> Column:
    """The name of a numbered volume; the pattern has %i, %Ni or %0Ni."""
    java = F.regexp_replace(_c(pattern), r"%(0?[0-9]*)i", "%$1d")
    return F.call_function("format_string", java, _c(index))


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Names that differ in case or composition only have the same key; Spark has no normalisation of its own."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s.casefold()))


def utf16_base64(name) -> Column:
    """A base64 text of UTF-16LE, null unless it is the canonical one."""
    n = _c(name)
    raw = F.try_to_binary(n, F.lit("base64"))
    even = F.octet_length(raw) % 2 == 0
    return F.when(even & (F.base64(raw) == n), utf16(raw))
