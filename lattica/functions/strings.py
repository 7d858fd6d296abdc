"""Fixed-size strings, paths and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"
NULL_TERMINATED, NULL_PADDED, SPACE_PADDED = 0, 1, 2


def decode_fixed(text: Column, padding: int) -> Column:
    """A fixed-size string without its padding: up to the first NUL, without trailing NULs, or without trailing spaces."""
    if padding == NULL_TERMINATED:
        return F.substring_index(text, NUL, 1)
    if padding == NULL_PADDED:
        return F.regexp_replace(text, "\u0000+$", "")
    if padding == SPACE_PADDED:
        return F.regexp_replace(text, " +$", "")
    raise ValueError(f"unknown padding {padding}")


def decode_member(text: Column, padding: int) -> Column:
    """As in a compound member, where space padding also takes trailing NULs."""
    return F.regexp_replace(text, "[ \u0000]+$", "") if padding == SPACE_PADDED else decode_fixed(text, padding)


def encode_fixed(text: Column, size: int) -> Column:
    """Bytes of a string cut to, or padded with NULs to, a size. The cut is by bytes and may split a character."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    return F.substring(F.rpad(data, size, F.lit(b"\x00")), 1, size)


def parent_path(path: Column) -> Column:
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def valid_object_path(path: Column) -> Column:
    """Absolute, not the root, no empty component, no trailing slash."""
    return F.coalesce(path.startswith("/") & (path != "/") & ~path.contains("//") & ~path.endswith("/"), F.lit(False))


def valid_soft_target(path: Column) -> Column:
    """Absolute or relative, not empty, up to 65,535 bytes; it may dangle."""
    return F.coalesce((path != "") & (F.octet_length(path) <= 65_535) & ~path.contains(NUL), F.lit(False))


def valid_external_file(name: Column) -> Column:
    """Not empty and never going up: no component is ``..``."""
    return F.coalesce((name != "") & ~name.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~name.contains(NUL), F.lit(False))


def _decimal(n: Column, bits: int, places: int) -> Column:
    """n / 2^bits with some decimals; the exact value is rounded, ties to the even digit."""
    n, scale, unit = n.cast("long"), 10**places, 1 << bits
    scaled = n.bitwiseAND(F.lit(unit - 1)) * scale
    digits, rest = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit(unit - 1))
    up = (rest > unit // 2) | ((rest == unit // 2) & (digits % 2 == 1))
    value = F.shiftright(n, bits) * scale + digits + up.cast("long")
    return F.concat(F.floor(value / F.lit(scale)).cast("string"), F.lit("."), F.lpad((value % scale).cast("string"), places, "0"))


def format_bytes(n: Column) -> Column:
    """Binary units: one decimal, two for the largest; bytes as they are."""
    return (
        F.when(n >= 1 << 30, F.concat(_decimal(n, 30, 2), F.lit(" GB")))
        .when(n >= 1 << 20, F.concat(_decimal(n, 20, 1), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(_decimal(n, 10, 1), F.lit(" KB")))
        .otherwise(F.format_string("%d B", n))
    )


def dataset_info(kind: Column, size: Column, dims: Column) -> Column:
    """One line about a dataset: class, element size, shape."""
    shape = F.when(F.size(dims) == 0, F.lit("scalar")).otherwise(F.concat(F.size(dims).cast("string"), F.lit("D array ["), F.array_join(F.transform(dims, lambda d: d.cast("string")), " x "), F.lit("]")))
    return F.concat(F.lit("Dataset: "), kind, F.lit(" (size="), size.cast("string"), F.lit(" bytes), "), shape)


def hex_rows(data: Column, offset: int = 0, length: int | None = None, width: int = 16) -> Column:
    """array of (at, hex, ascii): a dump of bytes in rows."""
    part = F.substr(data, F.lit(offset + 1), F.lit(length)) if length is not None else F.substr(data, F.lit(offset + 1))
    n = F.octet_length(part)
    at = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))

    def row(k: Column) -> Column:
        piece = F.substr(part, k * width + 1, F.lit(width))
        shown = F.regexp_replace(F.decode(piece, "ISO-8859-1"), "[^ -~]", ".")
        return F.struct((k * width + offset).cast("long").alias("at"), F.lower(F.hex(piece)).alias("hex"), shown.alias("ascii"))

    return F.transform(at, row)
