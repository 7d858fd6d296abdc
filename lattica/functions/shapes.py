"""Index arithmetic over N-d shapes as Column expressions; row-major, the last dimension fastest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT_CHUNK_BYTES = 1 << 30
LIMIT_ATTRIBUTE_BYTES = 64 << 20
LIMIT_STRING_BYTES = 16 << 20
LIMIT_SELECTION_ELEMENTS = 1_000_000_000


def strides(dims: Sequence[int]) -> list[int]:
    """Elements to go on by one step in each dimension."""
    out = [1] * len(dims)
    for k in range(len(dims) - 2, -1, -1):
        out[k] = out[k + 1] * dims[k + 1]
    return out


def safe_product(values: Sequence[int], bits: int = 64) -> int:
    """The product, or an error where it does not fit an unsigned integer of so many bits."""
    out = 1
    for v in values:
        if v < 0:
            raise ValueError("a size is negative")
        out *= v
        if out >= 1 << bits:
            raise OverflowError(f"the product of {list(values)} is over {bits} bits")
    return out


def total_elements(dims: Column) -> Column:
    """Product of an array of sizes; a scalar (no dimensions) has one element, a null dataspace none."""
    return F.when(dims.isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x.cast("long")))


def checked_multiply(a: Column, b: Column) -> Column:
    """The product of longs; null where it overflows."""
    return F.try_multiply(a.cast("long"), b.cast("long"))


def chunk_counts(dims: Sequence[int], chunks: Sequence[int]) -> list[int]:
    return [-(-d // c) for d, c in zip(dims, chunks, strict=True)]


def linear_offset(coords: Sequence[Column], dims: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for c, s in zip(coords, strides(dims), strict=True):
        out = out + c.cast("long") * s
    return out


def delinearise(offset: Column, dims: Sequence[int]) -> list[Column]:
    """Coordinates of a linear offset."""
    return [F.pmod(F.floor(offset / F.lit(s)), F.lit(d)).cast("long") if s > 1 else F.pmod(offset, F.lit(d)).cast("long") for s, d in zip(strides(dims), dims, strict=True)]


def chunk_of(coord: Column, size: int) -> Column:
    """Which chunk along a dimension a coordinate lies in."""
    return F.floor(coord / F.lit(size)).cast("long")


def clamped(chunk: Column, size: int, dim: int) -> Column:
    """Elements of a chunk along a dimension: the last one may be cut."""
    return F.least(F.lit(size).cast("long"), F.lit(dim).cast("long") - chunk * size)
