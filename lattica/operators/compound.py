"""Structs, enums, variable-length and fixed arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(**members: Column) -> Column:
    """A compound value of named members, in order."""
    return F.struct(*[c.alias(n) for n, c in members.items()])


def packed_offsets(sizes: Mapping[str, int]) -> dict[str, int]:
    """Byte offsets of members without gaps."""
    out, at = {}, 0
    for name, size in sizes.items():
        out[name] = at
        at += size
    return out


def enum_code(name: Column, codes: Mapping[str, int]) -> Column:
    """The code of a name; null if it is not a member."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), name)


def enum_name(code: Column, codes: Mapping[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in codes.items() for x in (v, k)]), code)


def ragged(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str = "values") -> DataFrame:
    """Variable-length sequences by key, in an order that takes the value last."""
    cols = [F.col(o).alias(f"o{k}") for k, o in enumerate(order)]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols, F.col(value).alias("v")))).alias("x")).select(*keys, F.col("x.v").alias(out))


def reshape(values: Column, rows: int, cols: int) -> Column:
    """A fixed array as rows of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(values, r * cols + 1, F.lit(cols)))
