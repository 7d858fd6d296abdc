"""Byte codecs of the chunk pipeline: numpy and zlib inside, Arrow-batched columns outside."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFLATE, SHUFFLE, FLETCHER32, SZIP, NBIT, SCALE_OFFSET, BZIP2, LZF = 1, 2, 3, 4, 5, 6, 307, 32000
NAMES = {DEFLATE: "deflate", SHUFFLE: "shuffle", FLETCHER32: "fletcher32", SZIP: "szip", NBIT: "nbit", SCALE_OFFSET: "scaleoffset", BZIP2: "bzip2", LZF: "lzf"}


class CodecError(ValueError):
    """Bytes that a codec can't take."""


def shuffle(data: bytes, size: int) -> bytes:
    """All first bytes of the elements, then all second ones, and so on; bytes after the last whole element stay."""
    n = len(data) // size * size if size > 1 else 0
    return np.frombuffer(data[:n], np.uint8).reshape(-1, size).T.tobytes() + data[n:] if n else data


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size * size if size > 1 else 0
    return np.frombuffer(data[:n], np.uint8).reshape(size, -1).T.tobytes() + data[n:] if n else data


def fletcher32(data: bytes) -> int:
    """The checksum over big-endian 16-bit words as the file format stores it; an odd last byte is the high half of a word."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    n = len(words)
    one = int(words.sum()) % 65535
    two = 0
    for at in range(0, n, 1 << 20):
        part = words[at : at + (1 << 20)]
        two += int((part * np.arange(n - at, n - at - len(part), -1, dtype=np.uint64) % 65535).sum())
    # Sums folded to sixteen bits leave 65535 for a multiple that is not zero.
    fold = lambda s, any_: s % 65535 or (65535 if any_ else 0)
    some = bool(words.any())
    return fold(two, some) << 16 | fold(one, some)


def add_fletcher32(data: bytes) -> bytes:
    return data + fletcher32(data).to_bytes(4, "little")


def strip_fletcher32(data: bytes, verify: bool = True) -> bytes:
    if len(data) < 4:
        raise CodecError("too short for a checksum")
    body, sum_ = data[:-4], int.from_bytes(data[-4:], "little")
    if verify and sum_ != (own := fletcher32(body)) and sum_ != ((own & 0xFF00FF) << 8 | own >> 8 & 0xFF00FF):  # old writers swapped the bytes of each half
        raise CodecError("the checksum differs")
    return body


def lzf_decompress(data: bytes, size: int | None = None) -> bytes:
    """Control byte under 32: so many literals and one; else a copy, its length in the top three bits (seven: one more byte) and its distance in the rest."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        control = data[at]
        at += 1
        if control < 32:
            if at + control + 1 > n:
                raise CodecError("literals end early")
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            if at >= n:
                raise CodecError("a copy ends early")
            length += data[at]
            at += 1
        if at >= n:
            raise CodecError("a copy ends early")
        start = len(out) - ((control & 31) << 8 | data[at]) - 1
        at += 1
        if start < 0:
            raise CodecError("a copy starts before the data")
        for k in range(length + 2):
            out.append(out[start + k])
    if size is not None and len(out) != size:
        raise CodecError(f"{len(out)} bytes, not {size}")
    return bytes(out)


def lzf_compress(data: bytes) -> bytes:
    """Greedy matches of three bytes or more within 8 KiB, found by a table of the last place of each three bytes."""
    out, pending, seen, at, n = bytearray(), bytearray(), {}, 0, len(data)

    def flush() -> None:
        for k in range(0, len(pending), 32):
            part = pending[k : k + 32]
            out.append(len(part) - 1)
            out.extend(part)
        pending.clear()

    while at < n:
        key = data[at : at + 3]
        before = seen.get(key) if len(key) == 3 else None
        seen[key] = at
        if before is None or at - before > 8192:
            pending.append(data[at])
            at += 1
            continue
        length = 3
        while length < 264 and at + length < n and data[before + length] == data[at + length]:
            length += 1
        flush()
        distance = at - before - 1
        short = length - 2
        out += bytes([short << 5 | distance >> 8, distance & 255]) if short < 7 else bytes([7 << 5 | distance >> 8, short - 7, distance & 255])
        at += length
    flush()
    return bytes(out)


def lookup3(data: bytes, start: int = 0) -> int:
    """Jenkins' public hash of bytes, by little-endian words: the format's metadata checksum and name hash."""
    m = 0xFFFFFFFF
    rot = lambda x, k: (x << k | x >> (32 - k)) & m
    a = b = c = (0xDEADBEEF + len(data) + start) & m
    at, left = 0, len(data)
    while left > 12:
        x, y, z = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (0, 4, 8))
        a, b, c = (a + x) & m, (b + y) & m, (c + z) & m
        for k in (4, 6, 8, 16, 19, 4):
            a = ((a - c) & m) ^ rot(c, k)
            c = (c + b) & m
            a, b, c = b, c, a
        at, left = at + 12, left - 12
    if not left:
        return c
    tail = data[at:].ljust(12, b"\0")
    a, b, c = ((v + int.from_bytes(tail[k : k + 4], "little")) & m for v, k in ((a, 0), (b, 4), (c, 8)))
    for k in (14, 11, 25, 16, 4, 14, 24):
        c = ((c ^ b) - rot(b, k)) & m
        a, b, c = b, c, a
    # Seven steps turn the three words round seven times, so the one changed last stands second.
    return b


def decode(data: bytes, filters: Sequence[tuple[int, Sequence[int]]], mask: int = 0, verify: bool = True) -> bytes:
    """Undo a pipeline of (filter id, client values), last first; filters whose bit is set in the mask were left out."""
    for k in range(len(filters) - 1, -1, -1):
        kind, values = filters[k]
        if mask >> k & 1:
            continue
        if kind == DEFLATE:
            data = zlib.decompress(data)
        elif kind == SHUFFLE:
            data = unshuffle(data, values[0])
        elif kind == FLETCHER32:
            data = strip_fletcher32(data, verify)
        elif kind == BZIP2:
            data = bz2.decompress(data)
        elif kind == LZF:
            data = lzf_decompress(data)
        else:
            raise CodecError(f"filter {NAMES.get(kind, kind)} is not supported")
    return data


def encode(data: bytes, filters: Sequence[tuple[int, Sequence[int]]]) -> bytes:
    for kind, values in filters:
        if kind == DEFLATE:
            data = zlib.compress(data, values[0] if values else 6)
        elif kind == SHUFFLE:
            data = shuffle(data, values[0])
        elif kind == FLETCHER32:
            data = add_fletcher32(data)
        elif kind == BZIP2:
            data = bz2.compress(data, values[0] if values else 9)
        elif kind == LZF:
            data = lzf_compress(data)
        else:
            raise CodecError(f"filter {NAMES.get(kind, kind)} is not supported")
    return data


def _bytes_column(kind: str, f):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(bytes(v)) for v in x], dtype=object)

    return run


def encoded(data: Column, filters: Sequence[tuple[int, Sequence[int]]]) -> Column:
    return _bytes_column("binary", lambda v: encode(v, filters))(data)


def decoded(data: Column, filters: Sequence[tuple[int, Sequence[int]]]) -> Column:
    return _bytes_column("binary", lambda v: decode(v, filters))(data)


def lookup3_of(data: Column) -> Column:
    return _bytes_column("bigint", lookup3)(data)


def fletcher32_of(data: Column) -> Column:
    return _bytes_column("bigint", fletcher32)(data)


def fletcher32_expr(data: Column) -> Column:
    """The same checksum in the JVM: both sums have closed forms over the words."""
    n = F.ceil(F.octet_length(data) / 2).cast("int")
    at = lambda k: F.coalesce(F.conv(F.hex(F.substr(data, k, F.lit(1))), 16, 10).cast("long"), F.lit(0))
    word = lambda k: at(2 * k + 1) * 256 + F.when(2 * k + 2 <= F.octet_length(data), at(2 * k + 2)).otherwise(0)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    words = F.transform(places, word)
    sums = F.aggregate(words, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, w: F.struct(((s["a"] + w) % 65535).alias("a"), ((s["b"] + s["a"] + w) % 65535).alias("b")))
    some = F.exists(words, lambda w: w > 0)
    fold = lambda s: F.when((s == 0) & some, F.lit(65535)).otherwise(s).cast("long")
    return F.shiftleft(fold(sums["b"]), 16) + fold(sums["a"])
