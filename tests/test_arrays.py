"""Selections and layouts against numpy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import shapes
from lattica.operators import layout
from lattica.operators.selection import Hyperslab, chunk_ranges, hyperslab, slice_nd


def cube(spark, dims):
    coords = shapes.delinearise(F.col("id"), dims)
    return spark.range(int(np.prod(dims))).select(*[c.alias(f"i{k}") for k, c in enumerate(coords)], F.col("id").cast("double").alias("value"))


def taken(array, s):
    picks = [np.concatenate([np.arange(a + k * t, a + k * t + b) for k in range(c)]) for a, c, t, b in zip(s.start, s.count, s.stride, s.block, strict=True)]
    return array[np.ix_(*picks)].reshape(-1)


@st.composite
def selections(draw):
    dims = draw(st.lists(st.integers(1, 9), min_size=1, max_size=3))
    parts = []
    for d in dims:
        block = draw(st.integers(1, d))
        stride = draw(st.integers(block, d + 2))
        start = draw(st.integers(0, d - block))
        count = draw(st.integers(1, (d - start - block) // stride + 1))
        parts.append((start, count, stride, block))
    return dims, Hyperslab.of(*zip(*parts, strict=True))


@given(selections())
@settings(max_examples=25, deadline=None)
def test_hyperslab_is_numpys(spark, case):
    dims, s = case
    rows = hyperslab(cube(spark, dims), s, dims).collect()
    got = [r["value"] for r in sorted(rows, key=lambda r: r["out_idx"])]
    want = taken(np.arange(np.prod(dims), dtype=float).reshape(dims), s)
    assert got == want.tolist() and sorted(r["out_idx"] for r in rows) == list(range(s.size))


@given(selections(), st.integers(1, 4))
@settings(max_examples=15, deadline=None)
def test_overlapping_chunks(spark, case, size):
    dims, s = case
    chunks = [min(size, d) for d in dims]
    got = {tuple(r) for r in layout.overlapping_chunks(spark, s, dims, chunks).collect()}
    picks = np.stack(np.unravel_index(taken(np.arange(np.prod(dims)).reshape(dims), s), dims), axis=1)
    assert got == {tuple(int(x) // c for x, c in zip(p, chunks, strict=True)) for p in picks}
    assert all(all(a <= x <= b for x, (a, b) in zip(c, chunk_ranges(s, chunks), strict=True)) for c in got)


def test_four_dimensions(spark):
    dims = (4, 6, 8, 10)
    values = lambda s: [int(r["value"]) for r in hyperslab(cube(spark, dims), s, dims).orderBy("out_idx").collect()]
    zero = (0, 0, 0, 0)
    assert values(Hyperslab.of(zero, (2,) * 4, (2,) * 4)) == [0, 2, 20, 22, 160, 162, 180, 182, 960, 962, 980, 982, 1120, 1122, 1140, 1142]
    block = values(Hyperslab.of(zero, (1,) * 4, (1,) * 4, (2,) * 4))
    assert block == [0, 1, 10, 11, 80, 81, 90, 91, 480, 481, 490, 491, 560, 561, 570, 571] == values(Hyperslab.of(zero, (2,) * 4))
    assert values(Hyperslab.of(zero, (2, 2, 1, 1), (2, 2, 1, 1), (1, 2, 4, 4))) == values(Hyperslab.of(zero, (2, 2, 4, 4), (2, 2, 1, 1), (1, 2, 1, 1)))


@pytest.mark.parametrize("bad", [((0,), (1, 1)), ((0, 0), (0, 1)), ((-1, 0), (1, 1)), ((5, 0), (2, 1)), ((0, 0), (2, 1), (1, 1), (2, 1))])
def test_selections_that_are_refused(bad):
    with pytest.raises(ValueError):
        Hyperslab.of(*bad).checked((6, 6))


def test_slices(spark):
    a = cube(spark, (10, 8))
    assert sorted(int(r["value"]) for r in slice_nd(a, (3, 0), (4, 8), (10, 8)).collect()) == list(range(24, 56))
    assert slice_nd(a, (3, 0), (0, 8), (10, 8)).count() == 0
    with pytest.raises(ValueError):
        slice_nd(a, (8, 0), (4, 8), (10, 8))


def test_chunks_there_and_back(spark):
    dims = (25, 35)
    a = cube(spark, dims)
    c = layout.to_chunks(a, dims, (10, 10))
    assert c.count() == 12 and c.where("shape[0] < 10 or shape[1] < 10").count() == 6
    back = layout.from_chunks(c, 2)
    assert back.exceptAll(a).count() == 0 and back.count() == 875
    rows = layout.to_rows(back, 2).orderBy("i0").collect()
    assert rows[3]["values"] == [float(x) for x in range(105, 140)]


def test_resize(spark):
    a = cube(spark, (3, 2))
    got = {(r["i0"], r["i1"]): r["value"] for r in layout.resize(a, (3, 2), (2, 4), (None, None)).collect()}
    assert got == {(i, j): float(i * 2 + j) if j < 2 else 0.0 for i in range(2) for j in range(4)}
    with pytest.raises(ValueError):
        layout.resize(a, (3, 2), (3, 9), (None, 8))
    with pytest.raises(ValueError):
        layout.resize(a, (3, 2), (3,))


def test_safe_products():
    assert shapes.safe_product([3, 4, 5]) == 60
    with pytest.raises(OverflowError):
        shapes.safe_product([1 << 40, 1 << 40])
    with pytest.raises(ValueError):
        shapes.safe_product([-1])


@pytest.mark.parametrize("name", ["bf16_round_trip", "f8_round_trip"])
def test_round_trips_take_all_rows(spark, tmp_path, name):
    from lattica.plans import registry, value_queries  # noqa: F401

    n = 1203
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(-2.0)).cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["i0"], r["i1"]) for r in got) == [(a, b) for a in range(n) for b in range(2)]
    columns = ["value"] if name[0] == "b" else ["e4m3", "e5m2"]
    assert all(r[c] == (0.5, -2.0)[r["i1"]] for r in got for c in columns)
