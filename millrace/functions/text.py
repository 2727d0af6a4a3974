"""Text forms, hashes and other scalar kernels, as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "<nil>"


def plain_number(value: Column) -> Column:
    """A double in the shortest form: exponents only below 1e-4 and from 1e21 on, two digits at least."""
    s = value.cast("string")
    mantissa = F.substring_index(s, "E", 1)
    exponent = F.substring_index(s, "E", -1).try_cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.substring_index(mantissa, ".", 1), "^-", "")
    fraction = F.regexp_replace(F.substring_index(mantissa, ".", -1), "^0$", "")
    trimmed = F.regexp_replace(s, r"\.0$", "")
    digits = F.concat(whole, fraction)
    padded = F.concat(digits, F.repeat(F.lit("0"), F.greatest(exponent + 1 - F.length(digits), F.lit(0))))
    big = F.concat(sign, padded.substr(F.lit(1), exponent + 1), F.when(F.length(padded) > exponent + 1, F.concat(F.lit("."), padded.substr(exponent + 2, F.length(padded)))).otherwise(F.lit("")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(sign, whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    named = F.when(F.isnan(value), F.lit("NaN")).when(s == "Infinity", F.lit("+Inf")).when(s == "-Infinity", F.lit("-Inf"))
    shown = F.when(~s.contains("E"), trimmed).when(exponent.between(0, 20), big).when(exponent.between(-4, -1), small).otherwise(scientific)
    return F.coalesce(named, shown)


def rfc3339(value: Column) -> Column:
    """UTC with as many digits of a second as are not zero."""
    t = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))


def text_form(value: Column, kind: T.DataType, is_any: bool = False) -> Column:
    """The text that hashing, sharding and table splitting see; null has a text too."""
    if is_any:
        return F.coalesce(value.cast("string"), F.lit("null"))
    if isinstance(kind, T.BinaryType):
        text = F.decode(value, "UTF-8")
    elif isinstance(kind, T.DateType):
        text = F.date_format(value, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = rfc3339(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = plain_number(value)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(value), F.lit("null"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lower-case hex of HMAC-SHA256 by SQL functions; the two pads are made here, once."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    inside = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, inside), 256)


def crc_shard(texts: list[Column], shards: int) -> Column:
    """CRC-32 of the texts joined by dots, modulo the number of shards."""
    return F.pmod(F.crc32(F.concat_ws(".", *texts)), F.lit(shards)).cast("string")


def fnv32a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of UTF-8 bytes, as a long."""
    data = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(data) > 0, F.sequence(F.lit(0), (F.length(data) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(data.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        return (h.bitwiseXOR(byte) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(at, F.lit(2166136261).cast("bigint"), step)


def unescape_tskv(text: Column) -> Column:
    r"""``\\ \n \r \t \=`` undone; with any other escape the text stays as it is."""
    def between(part: Column) -> Column:  # escaped backslashes are cut out first, so no mark has to stand for them
        for escape, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\=", "=")):
            part = F.replace(part, F.lit(escape), F.lit(char))
        return part

    done = F.array_join(F.transform(F.split(text, r"\\\\", -1), between), "\\")
    return F.when(text.rlike(r"^(?:[^\\]|\\[\\nrt=])*$"), done).otherwise(text)


def table_name(text: Column) -> Column:
    """Slashes and at signs as underscores."""
    return F.translate(text, "/@", "__")


def go_template(replacement: str) -> str:
    """``$1`` and ``${1}`` as Java has them; ``$1x`` names a group that doesn't exist, which is empty."""
    import re

    def one(m: re.Match) -> str:
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else ("${%s}" % name if m[1] else "")

    return re.sub(r"\$\{(\w+)\}|\$(\w+)", one, replacement.replace("\\", "\\\\"))
