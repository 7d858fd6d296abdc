"""Low-precision floats and their bytes, vectorised over numpy arrays and as Arrow-batched columns.

bfloat16 rounds to nearest, ties to even. The 8-bit formats come in two modes. ``reference`` treats the top
exponent as not finite in both formats, clamps a mantissa that rounds over, and so has codes that decode to
NaN or infinity for large finite inputs; ``ocp`` follows the open 8-bit float specification.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format8:
    exponent_bits: int
    mantissa_bits: int
    bias: int


E4M3, E5M2 = Format8(4, 3, 7), Format8(5, 2, 15)


def bf16_encode(x: np.ndarray) -> np.ndarray:
    """Codes of float32 values; NaN becomes the quiet NaN 0x7FC0."""
    bits = np.ascontiguousarray(x, dtype=np.float32).view(np.uint32)
    rounded = ((bits.astype(np.uint64) + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(x), np.uint16(0x7FC0), rounded)


def bf16_decode(codes: np.ndarray) -> np.ndarray:
    return (np.asarray(codes, dtype=np.uint32) << 16).view(np.float32)


def bf16_to_bytes(codes: np.ndarray) -> bytes:
    return np.asarray(codes, dtype="<u2").tobytes()


def bf16_from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2")


def f8_table(f: Format8, mode: str = "reference") -> np.ndarray:
    """The values of all 256 codes."""
    codes = np.arange(256)
    sign = np.where(codes >> 7, -1.0, 1.0)
    e, m = (codes >> f.mantissa_bits) & ((1 << f.exponent_bits) - 1), codes & ((1 << f.mantissa_bits) - 1)
    scale = float(1 << f.mantissa_bits)
    value = np.where(e == 0, m / scale * 2.0 ** (1 - f.bias), (1 + m / scale) * 2.0 ** (e - float(f.bias)))
    top, full = e == (1 << f.exponent_bits) - 1, m == (1 << f.mantissa_bits) - 1
    if f is E4M3 and mode == "ocp":
        value = np.where(top & full, np.nan, value)
    elif f is E4M3:
        value = np.where(top, np.where(full, np.inf, np.nan), value)
    else:
        value = np.where(top, np.where(m == 0, np.inf, np.nan), value)
    return (sign * value).astype(np.float32)


def f8_decode(codes: np.ndarray, f: Format8, mode: str = "reference") -> np.ndarray:
    return f8_table(f, mode)[np.asarray(codes, dtype=np.uint8)]


def f8_encode(x: np.ndarray, f: Format8) -> np.ndarray:
    """Open-specification codes: nearest finite value, ties to even; what is over the largest becomes it (E4M3) or infinity (E5M2)."""
    x = np.asarray(x, dtype=np.float64)
    table = f8_table(f, "ocp").astype(np.float64)
    finite = np.flatnonzero(np.isfinite(table[:128]))
    values = table[:128][finite]
    a = np.abs(x)
    hi = np.clip(np.searchsorted(values, np.nan_to_num(a, nan=0.0, posinf=values[-1])), 0, len(values) - 1)
    lo = np.maximum(hi - 1, 0)
    below, above = np.abs(a - values[lo]), np.abs(values[hi] - a)
    pick = np.where((below < above) | ((below == above) & (finite[lo] % 2 == 0)), finite[lo], finite[hi])
    if f is E5M2:
        step = values[-1] - values[-2]
        pick = np.where(a >= values[-1] + step / 2, 0x7C, pick)
    pick = np.where(np.isnan(x), 0x7F, pick)
    return (pick | np.where(np.signbit(x), 0x80, 0)).astype(np.uint8)


def _series(kind: str, f):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy()))

    return run


def bf16_code(x: Column) -> Column:
    return _series("int", lambda a: bf16_encode(a.astype(np.float32)).astype(np.int32))(x)


def bf16_value(code: Column) -> Column:
    return _series("float", bf16_decode)(code)


def f8_code(x: Column, f: Format8) -> Column:
    return _series("int", lambda a: f8_encode(a, f).astype(np.int32))(x)


def f8_value(code: Column, f: Format8, mode: str = "reference") -> Column:
    """Decoding is a lookup in a literal table of 256 values, inside the JVM."""
    values = [float(v) for v in f8_table(f, mode)]
    return F.element_at(F.array(*[F.lit(v).cast("float") for v in values]), (code + 1).cast("int"))
