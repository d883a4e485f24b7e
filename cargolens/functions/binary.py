"""Numbers, flags and ranges in bytes, as columns. Offsets count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.functions.arrays import let, running_sums


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def take(data, offset, size) -> Column:
    """Bytes from offset on."""
    return F.substring(_c(data), _c(offset) + 1 if not isinstance(offset, int) else F.lit(offset + 1), _c(size) if not isinstance(size, int) else F.lit(size))


def little(data, offset, size: int) -> Column:
    """An unsigned little-endian number of up to 8 bytes, null beyond the data and from 2^63 on."""
    at = lambda k: take(data, (_c(offset) if not isinstance(offset, int) else F.lit(offset)) + k, 1)
    whole = F.hex(F.concat(*(at(k) for k in range(size - 1, -1, -1))))
    return F.when(F.length(whole) == 2 * size, F.conv(whole, 16, 10).cast("decimal(20,0)").try_cast("bigint"))


def big(data, offset, size: int) -> Column:
    """An unsigned big-endian number."""
    whole = F.hex(take(data, offset, size))
    return F.when(F.length(whole) == 2 * size, F.conv(whole, 16, 10).cast("decimal(20,0)").try_cast("bigint"))


def signed_cell(raw: Column, bits: int) -> Column:
    """A database cell with its sign bit flipped; 0 is null."""
    half = 1 << (bits - 1)
    flipped = raw.bitwiseXOR(F.lit(half).cast("bigint"))
    return F.when(raw != 0, F.when(flipped >= half, flipped - 2 * half).otherwise(flipped))


def any_flag(value, mask: int) -> Column:
    return _c(value).bitwiseAND(F.lit(mask)) != 0


def all_flags(value, mask: int) -> Column:
    return _c(value).bitwiseAND(F.lit(mask)) == mask


def inside(offset, size, total) -> Column:
    """Whether a range lies in the file, without a sum that can overflow."""
    o, s, n = _c(offset), _c(size), _c(total)
    return (o >= 0) & (s >= 0) & (o <= n) & (s <= n - o)


def apart(start_a, size_a, start_b, size_b) -> Column:
    """Whether two ranges share no byte."""
    return (_c(start_a) + _c(size_a) <= _c(start_b)) | (_c(start_b) + _c(size_b) <= _c(start_a))


def align_up(value, to: int) -> Column:
    return F.floor((_c(value) + to - 1) / to).cast("bigint") * to


def rotate_left(value, by: int, bits: int) -> Column:
    """Rotation within the low bits of a number."""
    v = _c(value)
    return F.shiftleft(v, by).bitwiseOR(F.shiftrightunsigned(v, bits - by)).bitwiseAND(F.lit((1 << bits) - 1))


def all_zero(data) -> Column:
    return F.hex(_c(data)).rlike("^0*$")


def find(data, needle: bytes) -> Column:
    """Offset of the first occurrence, null if there is none."""
    return F.nullif(F.position(F.lit(bytearray(needle)), _c(data)), F.lit(0)) - 1


def _pattern(needle: bytes) -> str:
    return "".join(f"\\x{b:02x}" for b in needle)


def find_all(data, needle: bytes) -> Column:
    """Offsets of all occurrences, overlapping ones too: what a split before each of them leaves adds up to their places."""
    s = F.decode(_c(data), "ISO-8859-1")
    ahead = f"(?={_pattern(needle)})"
    parts = F.transform(F.split(s, ahead), lambda p: F.length(p).cast("bigint"))
    # The first part starts at an occurrence only if the data do.
    starts = let(running_sums(parts), lambda ends: F.concat(F.when(has_at(data, 0, needle), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.slice(ends, 1, F.size(ends) - 1)))
    return F.when(F.length(_c(data)) > 0, starts).otherwise(F.when(_c(data).isNotNull(), F.array().cast("array<bigint>")))


def find_last(data, needle: bytes) -> Column:
    """Offset of the last occurrence, null if there is none."""
    s = F.reverse(F.decode(_c(data), "ISO-8859-1"))
    at = F.nullif(F.position(F.lit(needle[::-1].decode("latin-1")), s), F.lit(0))
    return F.length(_c(data)) - (at - 1) - len(needle)


def byte_sum(data) -> Column:
    """The sum of the bytes."""
    digits = F.regexp_extract_all(F.hex(_c(data)), F.lit("(..)"), F.lit(1))
    return F.aggregate(F.transform(digits, lambda x: F.conv(x, 16, 10).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def head_inverted(data, n: int) -> Column:
    """The data with all bits of the first n bytes turned; hex digits are turned one by one."""
    turned = F.translate(F.hex(take(data, 0, n)), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(F.unhex(turned), F.substr(_c(data), F.lit(n + 1)))


def chunked(data, size: int = 4096) -> Column:
    """The data in chunks, each behind its CRC-32."""
    n = F.ceil(F.length(_c(data)) / size).cast("int")
    crc = lambda x: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(F.crc32(x)), 8, "0"), k, 2) for k in (7, 5, 3, 1))))
    parts = let(_c(data), lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(take(d, i * size, size), lambda x: F.hex(F.concat(crc(x), x)))))
    return F.when(n > 0, F.unhex(F.array_join(parts, ""))).otherwise(_c(data))


def unchunked(data, size: int = 4096) -> Column:
    """The data of chunks without their CRC-32, null if one of them is wrong or a chunk has no data."""
    n = F.ceil(F.length(_c(data)) / (size + 4)).cast("int")
    good = lambda x: F.when((F.length(x) > 4) & (little(x, 0, 4) == F.crc32(F.substr(x, F.lit(5)))), F.hex(F.substr(x, F.lit(5))))
    parts = let(_c(data), lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(take(d, i * (size + 4), size + 4), good)))
    whole = let(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.unhex(F.array_join(p, ""))))
    return F.when(n > 0, whole).otherwise(_c(data))


def has_at(data, offset, magic: bytes) -> Column:
    return take(data, offset, len(magic)) == F.lit(bytearray(magic))


def decimal_text(text) -> Column:
    """A strict unsigned decimal number."""
    t = _c(text)
    return F.when(t.rlike("^[0-9]{1,19}$"), t.try_cast("bigint"))


def sha1_text(text) -> Column:
    """A digest of 20 bytes from its hex text."""
    t = _c(text)
    return F.when(t.rlike("^[0-9A-Fa-f]{40}$"), F.unhex(t))


#: In hex, two bytes to a unit: no surrogate, or a pair of them.
UTF16 = "^(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+$"


def utf16(data) -> Column:
    """Text of little-endian UTF-16, null where it is malformed: decode() would fail the query."""
    d = _c(data)
    return F.when(F.hex(d).rlike(UTF16), F.decode(d, "UTF-16LE"))


def utf8(data) -> Column:
    """Text of UTF-8, null where it is malformed."""
    return F.try_validate_utf8(_c(data).cast("string"))


def ascii_text(data) -> Column:
    """Text of bytes below 128, null where there are others."""
    d = _c(data)
    return F.when(F.hex(d).rlike("^(?:[0-7][0-9A-F])*+$"), F.decode(d, "US-ASCII"))
