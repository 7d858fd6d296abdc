"""Forms of an N-d array: coordinates, rows of arrays, chunks; and changes of its grid and extent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.shapes import chunk_counts, chunk_of, clamped, delinearise, safe_product

from .selection import Hyperslab, axis, chunk_ranges


def to_long(df: DataFrame, row: str, values: str, *keep: str) -> DataFrame:
    """Coordinates of a table with an array in each row: i0 is the row's number, i1 the place in the array."""
    return df.select(F.col(row).alias("i0"), *keep, F.posexplode(values).alias("i1", "value"))


def to_rows(df: DataFrame, n: int, values: str = "values") -> DataFrame:
    """Rows of arrays of coordinates: the last of n dimensions becomes an array, in order. A row's array is bounded by that dimension."""
    keys = [axis(k) for k in range(n - 1)]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(axis(n - 1)).alias("i"), F.col("value").alias("v")))).alias("x")).select(*keys, F.col("x.v").alias(values))


def with_chunks(df: DataFrame, chunks: Sequence[int]) -> DataFrame:
    """Coordinates with the chunk (c0, c1, …) that each lies in."""
    return df.withColumns({f"c{k}": chunk_of(F.col(axis(k)), c) for k, c in enumerate(chunks)})


def to_chunks(df: DataFrame, dims: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """One row per allocated chunk: its coordinates, first element, shape (cut at the edges) and values in row-major order."""
    n = len(dims)
    c = [f"c{k}" for k in range(n)]
    order = [F.col(axis(k)).alias(f"o{k}") for k in range(n)]
    grouped = with_chunks(df, chunks).groupBy(*c).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("value").alias("v")))).alias("x"))
    return grouped.select(
        *c,
        F.array(*[F.col(f"c{k}") * s for k, s in enumerate(chunks)]).alias("offset"),
        F.array(*[clamped(F.col(f"c{k}"), s, d) for k, (s, d) in enumerate(zip(chunks, dims, strict=True))]).alias("shape"),
        F.col("x.v").alias("data"),
    )


def from_chunks(chunked: DataFrame, n: int) -> DataFrame:
    """Coordinates of chunk rows."""
    x = chunked.select("offset", "shape", F.posexplode("data").alias("p", "value"))
    coords, rest = [None] * n, F.col("p").cast("long")
    for k in range(n - 1, -1, -1):
        size = F.element_at("shape", k + 1)
        coords[k] = (F.element_at("offset", k + 1) + rest % size).cast("long").alias(axis(k))
        rest = F.floor(rest / size)
    return x.select(*coords, "value")


def grid(spark: SparkSession, dims: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """All chunk coordinates of an array, generated in parallel."""
    counts = chunk_counts(dims, chunks)
    ids = spark.range(safe_product(counts))
    return ids.select(*[c.alias(f"c{k}") for k, c in enumerate(delinearise(F.col("id"), counts))])


def overlapping_chunks(spark: SparkSession, selection: Hyperslab, dims: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """The chunks that a selection touches: generated from its bounds, then those that only its gaps touch are left out."""
    selection.checked(dims)
    ranges = chunk_ranges(selection, chunks)
    counts = [b - a + 1 for a, b in ranges]
    ids = spark.range(safe_product(counts))
    out = ids.select(*[(c + a).alias(f"c{k}") for k, (c, (a, _)) in enumerate(zip(delinearise(F.col("id"), counts), ranges, strict=True))])
    for k, (s, c, t, b, size) in enumerate(zip(selection.start, selection.count, selection.stride, selection.block, chunks, strict=True)):
        lo, hi = F.col(f"c{k}") * size, F.col(f"c{k}") * size + size - 1
        first = F.greatest(F.ceil((lo - s - b + 1) / F.lit(t)), F.lit(0))  # the first block that ends at or after lo
        out = out.where((first < c) & (first * t + s <= hi))
    return out


def fill_sparse(points: DataFrame, cells: DataFrame, n: int, fill: Column) -> DataFrame:
    """All cells of a grid with the value where there is one, and the fill value where its chunk was never written."""
    keys = [axis(k) for k in range(n)]
    return cells.join(points, keys, "left").select(*keys, F.coalesce("value", fill).alias("value"))


def resize(df: DataFrame, dims: Sequence[int], new_dims: Sequence[int], max_dims: Sequence[int | None] | None = None, fill: float = 0.0) -> DataFrame:
    """Coordinates after a change of extent: what lies outside goes; the new part is filled."""
    if len(dims) != len(new_dims):
        raise ValueError("a resize can't change the rank")
    for k, d in enumerate(new_dims):
        if d < 1 or (max_dims and max_dims[k] is not None and d > max_dims[k]):
            raise ValueError(f"dimension {k}: {d} is not allowed")
    keep = F.lit(True)
    for k, d in enumerate(new_dims):
        keep = keep & (F.col(axis(k)) < d)
    kept = df.where(keep).select(*[F.col(axis(k)).cast("long").alias(axis(k)) for k in range(len(dims))], "value")
    added = new_cells(df.sparkSession, dims, new_dims)
    return kept if added is None else kept.union(added.select("*", F.lit(fill).cast(df.schema["value"].dataType).alias("value")))


def new_cells(spark: SparkSession, dims: Sequence[int], new_dims: Sequence[int]) -> DataFrame | None:
    """Cells of the new extent that the old one lacks: a box for each dimension that grows, generated and disjoint."""
    out = None
    for k, (old, new) in enumerate(zip(dims, new_dims, strict=True)):
        if new <= old:
            continue
        # In dimensions before k the old part only, in k the new part, after k the whole new extent.
        sizes = [min(a, b) for a, b in zip(dims[:k], new_dims[:k], strict=True)] + [new - old] + list(new_dims[k + 1 :])
        coords = delinearise(F.col("id"), sizes)
        box = spark.range(safe_product(sizes)).select(*[(c + (old if j == k else 0)).alias(axis(j)) for j, c in enumerate(coords)])
        out = box if out is None else out.union(box)
    return out
