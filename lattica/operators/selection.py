"""Selections of N-d arrays in coordinate form: columns i0, i1, … and value.

A selection becomes plain predicates. Each dimension gives a bounding range, which sources can push down
and prune by, and, if it strides, a residual on the remainder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.shapes import LIMIT_SELECTION_ELEMENTS, safe_product


def axis(k: int) -> str:
    return f"i{k}"


@dataclass(frozen=True)
class Hyperslab:
    """Blocks of ``block`` elements, ``count`` of them, ``stride`` apart, from ``start``; in each dimension."""

    start: tuple[int, ...]
    count: tuple[int, ...]
    stride: tuple[int, ...]
    block: tuple[int, ...]

    @classmethod
    def of(cls, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, block: Sequence[int] | None = None) -> Hyperslab:
        ones = (1,) * len(start)
        return cls(tuple(start), tuple(count), tuple(stride or ones), tuple(block or ones))

    def checked(self, dims: Sequence[int]) -> Hyperslab:
        """Itself, or an error: ranks must agree, counts, strides and blocks be positive, blocks not overlap, and all lie in the array."""
        if not len(self.start) == len(self.count) == len(self.stride) == len(self.block) == len(dims):
            raise ValueError(f"the selection's rank is not that of the array, {len(dims)}")
        for k, (s, c, t, b, d) in enumerate(zip(self.start, self.count, self.stride, self.block, dims, strict=True)):
            if s < 0:
                raise ValueError(f"dimension {k}: start is negative")
            if c < 1 or t < 1 or b < 1:
                raise ValueError(f"dimension {k}: count, stride and block must be positive")
            if c > 1 and b > t:
                raise ValueError(f"dimension {k}: blocks of {b} overlap at a stride of {t}")
            if s + (c - 1) * t + b > d:
                raise ValueError(f"dimension {k}: the selection ends at {s + (c - 1) * t + b}, the array at {d}")
        if safe_product(self.shape) > LIMIT_SELECTION_ELEMENTS:
            raise ValueError("the selection has too many elements")
        return self

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(c * b for c, b in zip(self.count, self.block, strict=True))

    @property
    def size(self) -> int:
        return safe_product(self.shape)

    def predicate(self, axes: Sequence[str] | None = None) -> Column:
        out = F.lit(True)
        for k, (s, c, t, b) in enumerate(zip(self.start, self.count, self.stride, self.block, strict=True)):
            i = F.col((axes or [axis(n) for n in range(len(self.start))])[k])
            out = out & (i >= s) & (i < s + (c - 1) * t + b)
            if c > 1 and b < t:
                out = out & (((i - s) % t) < b)
        return out

    def output_coords(self, axes: Sequence[str] | None = None) -> list[Column]:
        out = []
        for k, (s, c, t, b) in enumerate(zip(self.start, self.count, self.stride, self.block, strict=True)):
            rel = F.col((axes or [axis(n) for n in range(len(self.start))])[k]) - s
            # A single block may be longer than the stride.
            out.append((F.floor(rel / F.lit(t)) * b + rel % t if c > 1 else rel).cast("long"))
        return out

    def output_index(self, axes: Sequence[str] | None = None) -> Column:
        """Where an element stands in the row-major result."""
        out = F.lit(0).cast("long")
        for c, d in zip(self.output_coords(axes), self.shape, strict=True):
            out = out * d + c
        return out


def hyperslab(df: DataFrame, selection: Hyperslab, dims: Sequence[int], index: str | None = "out_idx", axes: Sequence[str] | None = None) -> DataFrame:
    """The selected elements, with their place in the result."""
    selection.checked(dims)
    out = df.where(selection.predicate(axes))
    return out.withColumn(index, selection.output_index(axes)) if index else out


def slice_nd(df: DataFrame, start: Sequence[int], count: Sequence[int], dims: Sequence[int]) -> DataFrame:
    """A dense box. A count of zero selects nothing; a box that leaves the array is an error."""
    if not len(start) == len(count) == len(dims):
        raise ValueError(f"the slice's rank is not that of the array, {len(dims)}")
    for k, (s, c, d) in enumerate(zip(start, count, dims, strict=True)):
        if s < 0 or c < 0 or s + c > d:
            raise ValueError(f"dimension {k}: {s} + {c} leaves 0 .. {d}")
    out = F.lit(True)
    for k, (s, c) in enumerate(zip(start, count, strict=True)):
        out = out & (F.col(axis(k)) >= s) & (F.col(axis(k)) < s + c)
    return df.where(out)


def chunk_ranges(selection: Hyperslab, chunks: Sequence[int]) -> list[tuple[int, int]]:
    """By dimension, the first and last chunk that the selection's bounds touch."""
    return [(s // k, (s + (c - 1) * t + b - 1) // k) for s, c, t, b, k in zip(selection.start, selection.count, selection.stride, selection.block, chunks, strict=True)]
