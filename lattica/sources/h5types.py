"""Datatypes of the array file format: parsing, encoding, numpy layouts and Spark types."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T

from lattica.functions.lowfloat import E4M3, E5M2, bf16_decode, f8_decode

FIXED, FLOAT, TIME, STRING, BITFIELD, OPAQUE, COMPOUND, REFERENCE, ENUM, VLEN, ARRAY = range(11)
CLASS_NAMES = ["integer", "float", "time", "string", "bitfield", "opaque", "compound", "reference", "enum", "vlen", "array"]


class FormatError(ValueError):
    """Bytes that don't follow the format, or a part of it that is not supported."""


@dataclass(frozen=True)
class H5Type:
    kind: int
    size: int
    big: bool = False
    signed: bool = True
    padding: int = 0
    utf8: bool = False
    exponent: int = 0  # bits, of floats
    mantissa: int = 0
    tag: str = ""
    members: tuple[tuple[str, int, "H5Type"], ...] = ()  # name, offset, type
    base: "H5Type | None" = None
    names: tuple[tuple[str, int], ...] = ()  # of enums
    dims: tuple[int, ...] = ()
    text: bool = False  # a variable-length string
    region: bool = False

    @property
    def label(self) -> str:
        return "vlen string" if self.text else CLASS_NAMES[self.kind]


def _name(data: bytes, at: int, padded: bool) -> tuple[str, int]:
    end = data.index(b"\0", at)
    stop = at + -(-(end + 1 - at) // 8) * 8 if padded else end + 1
    return data[at:end].decode("utf-8", "replace"), stop


def parse_type(data: bytes, at: int = 0) -> tuple[H5Type, int]:
    """The type at a place, and where it ends."""
    if len(data) < at + 8:
        raise FormatError("a datatype ends early")
    version, kind = data[at] >> 4, data[at] & 15
    bits = int.from_bytes(data[at + 1 : at + 4], "little")
    (size,) = struct.unpack_from("<I", data, at + 4)
    p = at + 8
    if kind in (FIXED, BITFIELD):
        return H5Type(kind, size, big=bool(bits & 1), signed=bool(bits & 8)), p + 4
    if kind == FLOAT:
        return H5Type(kind, size, big=bool(bits & 1), exponent=data[p + 5], mantissa=data[p + 7]), p + 12
    if kind == TIME:
        return H5Type(kind, size, big=bool(bits & 1)), p + 2
    if kind == STRING:
        return H5Type(kind, size, padding=bits & 15, utf8=bool(bits >> 4 & 15)), p
    if kind == OPAQUE:
        length = bits & 255
        return H5Type(kind, size, tag=data[p : p + length].split(b"\0")[0].decode("utf-8", "replace")), p + -(-length // 8) * 8
    if kind == REFERENCE:
        return H5Type(kind, size, region=bits & 15 == 1), p
    if kind == VLEN:
        base, end = parse_type(data, p)
        return H5Type(kind, size, base=base, text=bits & 15 == 1, padding=bits >> 4 & 15, utf8=bool(bits >> 8 & 15)), end
    if kind == ARRAY:
        rank = data[p]
        p += 1 if version >= 3 else 4
        dims = struct.unpack_from(f"<{rank}I", data, p)
        p += 4 * rank * (1 if version >= 3 else 2)
        base, end = parse_type(data, p)
        return H5Type(kind, size, base=base, dims=dims), end
    if kind == ENUM:
        base, p = parse_type(data, p)
        n, names = bits & 0xFFFF, []
        for _ in range(n):
            name, p = _name(data, p, version < 3)
            names.append(name)
        order = "big" if base.big else "little"
        codes = [int.from_bytes(data[p + k * base.size : p + (k + 1) * base.size], order, signed=base.signed) for k in range(n)]
        return H5Type(kind, size, big=base.big, base=base, names=tuple(zip(names, codes, strict=True))), p + n * base.size
    if kind == COMPOUND:
        width = max(1, (size.bit_length() + 7) // 8)
        members = []
        for _ in range(bits & 0xFFFF):
            name, p = _name(data, p, version < 3)
            if version >= 3:
                offset = int.from_bytes(data[p : p + width], "little")
                p += width
            else:
                (offset,) = struct.unpack_from("<I", data, p)
                p += 4
            dims: tuple[int, ...] = ()
            if version == 1:
                dims = struct.unpack_from("<4I", data, p + 12)[: data[p]]
                p += 28
            t, p = parse_type(data, p)
            if dims:
                t = H5Type(ARRAY, t.size * int(np.prod(dims)), base=t, dims=tuple(dims))
            members.append((name, offset, t))
        return H5Type(kind, size, members=tuple(members)), p
    raise FormatError(f"datatype class {kind} is not supported")


def encode_type(t: H5Type) -> bytes:
    """Version 3 of the message for structs, enums and arrays, version 1 for the others."""

    def head(version: int, bits: int) -> bytes:
        return bytes([version << 4 | t.kind]) + bits.to_bytes(3, "little") + struct.pack("<I", t.size)

    if t.kind in (FIXED, BITFIELD):
        return head(1, int(t.big) | (8 if t.signed else 0)) + struct.pack("<HH", 0, 8 * t.size)
    if t.kind == FLOAT:
        e, m = t.exponent, t.mantissa
        return head(1, int(t.big) | 0x20 | (8 * t.size - 1) << 8) + struct.pack("<HHBBBBI", 0, 8 * t.size, m, e, 0, m, (1 << (e - 1)) - 1)
    if t.kind == STRING:
        return head(1, t.padding | int(t.utf8) << 4)
    if t.kind == OPAQUE:
        raw = t.tag.encode()
        raw = raw.ljust(-(-(len(raw) + 1) // 8) * 8, b"\0")
        return head(1, len(raw)) + raw
    if t.kind == REFERENCE:
        return head(1, int(t.region))
    if t.kind == VLEN:
        return head(1, int(t.text) | t.padding << 4 | int(t.utf8) << 8) + encode_type(t.base)
    if t.kind == ARRAY:
        return head(3, 0) + bytes([len(t.dims)]) + struct.pack(f"<{len(t.dims)}I", *t.dims) + encode_type(t.base)
    if t.kind == ENUM:
        order = "big" if t.base.big else "little"
        return head(3, len(t.names)) + encode_type(t.base) + b"".join(n.encode() + b"\0" for n, _ in t.names) + b"".join(c.to_bytes(t.base.size, order, signed=t.base.signed) for _, c in t.names)
    if t.kind == COMPOUND:
        width = max(1, (t.size.bit_length() + 7) // 8)
        return head(3, len(t.members)) + b"".join(n.encode() + b"\0" + o.to_bytes(width, "little") + encode_type(m) for n, o, m in t.members)
    raise FormatError(f"a {t.label} can't be written")


def integer(bits: int, signed: bool = True, big: bool = False) -> H5Type:
    return H5Type(FIXED, bits // 8, big=big, signed=signed)


FLOATS = {"float16": (2, 5, 10), "float32": (4, 8, 23), "float64": (8, 11, 52), "bfloat16": (2, 8, 7), "float8_e4m3": (1, 4, 3), "float8_e5m2": (1, 5, 2)}


def floating(name: str, big: bool = False) -> H5Type:
    size, e, m = FLOATS[name]
    return H5Type(FLOAT, size, big=big, exponent=e, mantissa=m)


def fixed_string(size: int, padding: int = 1, utf8: bool = True) -> H5Type:
    if size < 1:
        raise ValueError("a fixed string needs a size")
    return H5Type(STRING, size, padding=padding, utf8=utf8)


def vlen(base: H5Type) -> H5Type:
    return H5Type(VLEN, 16, base=base)


VLEN_STRING = H5Type(VLEN, 16, base=H5Type(STRING, 1, utf8=True), text=True, utf8=True)


def array_of(base: H5Type, dims: tuple[int, ...]) -> H5Type:
    if not dims or any(d < 1 for d in dims):
        raise ValueError("an array type needs positive sizes")
    return H5Type(ARRAY, base.size * int(np.prod(dims)), base=base, dims=tuple(dims))


def enum_of(base: H5Type, names: dict[str, int]) -> H5Type:
    if not names:
        raise ValueError("an enum needs members")
    return H5Type(ENUM, base.size, big=base.big, base=base, names=tuple(names.items()))


def opaque(size: int, tag: str = "") -> H5Type:
    return H5Type(OPAQUE, size, tag=tag)


OBJECT_REFERENCE, REGION_REFERENCE = H5Type(REFERENCE, 8), H5Type(REFERENCE, 12, region=True)


def compound(members: dict[str, H5Type]) -> H5Type:
    """Members packed without gaps."""
    out, at = [], 0
    for name, t in members.items():
        out.append((name, at, t))
        at += t.size
    if not out:
        raise ValueError("a compound needs members")
    return H5Type(COMPOUND, at, members=tuple(out))


def type_of(name: str) -> H5Type:
    """A type by its short name: int8 … uint64, the floats, ``string:N``, ``vlen_string``, ``vlen:NAME``, ``array:NAME:AxB``, ``opaque:N``, references."""
    head, _, rest = name.partition(":")
    if head in FLOATS:
        return floating(head)
    if head.lstrip("u").startswith("int"):
        return integer(int(head.lstrip("uint")), signed=not head.startswith("u"))
    if head == "string":
        return fixed_string(int(rest))
    if head == "vlen_string":
        return VLEN_STRING
    if head == "vlen":
        return vlen(type_of(rest))
    if head == "opaque":
        return opaque(int(rest))
    if head == "array":
        base, _, dims = rest.rpartition(":")
        return array_of(type_of(base), tuple(int(d) for d in dims.split("x")))
    if head in ("object_reference", "region_reference"):
        return OBJECT_REFERENCE if head == "object_reference" else REGION_REFERENCE
    raise ValueError(f"unknown type {name}")


def numpy_type(t: H5Type) -> np.dtype:
    """The layout of one element; what numpy has no number for stays bytes."""
    order = ">" if t.big else "<"
    if t.kind == FIXED and t.size in (1, 2, 4, 8):
        return np.dtype(f"{order}{'i' if t.signed else 'u'}{t.size}")
    if t.kind == FLOAT and (t.size, t.exponent) in ((2, 5), (4, 8), (8, 11)):
        return np.dtype(f"{order}f{t.size}")
    if t.kind == FLOAT and t.size in (1, 2):
        return np.dtype(f"{order}u{t.size}")
    if t.kind == ENUM:
        return numpy_type(t.base)
    if t.kind == ARRAY:
        return np.dtype((numpy_type(t.base), t.dims))
    if t.kind == COMPOUND:
        return np.dtype({"names": [m[0] for m in t.members], "formats": [numpy_type(m[2]) for m in t.members], "offsets": [m[1] for m in t.members], "itemsize": t.size})
    return np.dtype(f"V{t.size}")


def spark_type(t: H5Type, compat: bool = False) -> T.DataType:
    """compat: all numbers become double, as in readers that know one number type."""
    if t.kind in (FIXED, FLOAT) and compat:
        return T.DoubleType()
    if t.kind == FIXED:
        if t.signed:
            return {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}[t.size]
        return {1: T.ShortType(), 2: T.IntegerType(), 4: T.LongType(), 8: T.DecimalType(20, 0)}[t.size]
    if t.kind == FLOAT:
        return T.DoubleType() if t.size == 8 else T.FloatType()
    if t.kind == STRING or t.text:
        return T.StringType()
    if t.kind == ENUM:
        return spark_type(t.base)
    if t.kind == COMPOUND:
        return T.StructType([T.StructField(n, spark_type(m, compat)) for n, _, m in t.members])
    if t.kind == VLEN:
        return T.ArrayType(spark_type(t.base, compat))
    if t.kind == ARRAY:
        out = spark_type(t.base, compat)
        for _ in t.dims:
            out = T.ArrayType(out)
        return out
    if t.kind in (OPAQUE, REFERENCE, BITFIELD):
        return T.BinaryType() if t.kind != REFERENCE or t.region else T.LongType()
    raise FormatError(f"a {t.label} has no Spark type")


def decode_string(raw: bytes, padding: int, member: bool = False) -> str:
    if padding == 0:
        raw = raw.split(b"\0", 1)[0]
    elif padding == 1:
        raw = raw.rstrip(b"\0")
    else:
        raw = raw.rstrip(b" \0") if member else raw.rstrip(b" ")
    return raw.decode("utf-8", "replace")


@dataclass
class Values:
    """Elements of a type as Python or numpy values; the heap resolves variable-length ones."""

    heap: object = None
    compat: bool = False
    known: dict = field(default_factory=dict)

    def of(self, t: H5Type, raw: np.ndarray, member: bool = False):
        """raw: an array of :func:`numpy_type`. A numpy array where numbers are, else a list."""
        if t.kind == FLOAT and raw.dtype.kind == "u":
            raw = raw.astype(raw.dtype.newbyteorder("="))
            raw = bf16_decode(raw) if (t.size, t.exponent) == (2, 8) else f8_decode(raw, E4M3 if t.exponent == 4 else E5M2, "ocp")
        if t.kind in (FIXED, FLOAT, ENUM):
            out = raw.astype(raw.dtype.newbyteorder("="))
            if self.compat and t.kind != ENUM:
                return out.astype(np.float64)
            if out.dtype == np.uint64:
                return [Decimal(int(x)) for x in out]
            if out.dtype.kind == "u":
                return out.astype({1: np.int16, 2: np.int32, 4: np.int64}[t.size])
            return out.astype(np.float32) if out.dtype == np.float16 else out
        if t.kind == STRING:
            return [decode_string(x.tobytes(), t.padding, member) for x in raw]
        if t.kind == REFERENCE and not t.region:
            return [int.from_bytes(x.tobytes(), "little") for x in raw]
        if t.kind in (OPAQUE, REFERENCE, BITFIELD):
            return [x.tobytes() for x in raw]
        if t.kind == COMPOUND:
            parts = [list(self.of(m, raw[n], True)) for n, _, m in t.members]
            names = [n for n, _, _ in t.members]
            return [dict(zip(names, row, strict=True)) for row in zip(*parts, strict=True)]
        if t.kind == ARRAY:
            n = len(raw)
            flat = self.of(t.base, raw.reshape(-1))
            flat = flat.tolist() if isinstance(flat, np.ndarray) else list(flat)
            for d in reversed(t.dims):
                flat = [flat[k : k + d] for k in range(0, len(flat), d)]
            return flat if n else []
        if t.kind == VLEN:
            return [self._vlen(t, x.tobytes()) for x in raw]
        raise FormatError(f"a {t.label} can't be read")

    def _vlen(self, t: H5Type, raw: bytes):
        n, address, index = struct.unpack("<IQI", raw)
        data = self.heap(address, index) if n and address not in (0, (1 << 64) - 1) else b""
        if t.text:
            return data[:n].rstrip(b"\0").decode("utf-8", "replace")
        out = self.of(t.base, np.frombuffer(data[: n * t.base.size], dtype=numpy_type(t.base)))
        return out.tolist() if isinstance(out, np.ndarray) else out


