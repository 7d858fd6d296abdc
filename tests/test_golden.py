"""Arrays whose values are known, written to files and read back through selections: the facts are stated, not computed by the code under test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators.layout import resize
from lattica.operators.selection import Hyperslab
from lattica.sources import h5types as t
from lattica.sources.h5array import ChunkIterator, register, scan, write_chunks
from lattica.sources.h5read import Reader, opener
from lattica.sources.h5write import Writer, filter_list


def values(df):
    return [r["value"] for r in df.orderBy("out_idx").collect()]


@pytest.fixture(scope="module")
def cube(tmp_path_factory):
    """A 4 x 6 x 8 x 10 array of its linear index, contiguous and in chunks."""
    path = str(tmp_path_factory.mktemp("golden") / "cube.h5")
    a = np.arange(4 * 6 * 8 * 10, dtype=np.uint32).reshape(4, 6, 8, 10)
    with Writer(path) as w:
        w.dataset("/plain", a, t.integer(32, signed=False))
        w.dataset("/chunked", a, t.integer(32, signed=False), chunks=(3, 2, 5, 4), filters=filter_list(4, 6, True, True))
    return path


STRIDED = [0, 2, 20, 22, 160, 162, 180, 182, 960, 962, 980, 982, 1120, 1122, 1140, 1142]
BLOCKS = [0, 1, 10, 11, 80, 81, 90, 91, 480, 481, 490, 491, 560, 561, 570, 571]


@pytest.mark.parametrize("dataset", ["/plain", "/chunked"])
def test_strides_counts_and_blocks_in_four_dimensions(spark, cube, dataset):
    take = lambda *s: values(scan(spark, cube, dataset, Hyperslab.of(*s)))
    zero, one, two = (0,) * 4, (1,) * 4, (2,) * 4
    assert take(zero, two, two, one) == STRIDED
    assert take(zero, one, one, two) == BLOCKS
    # A count of two single elements is a block of two; and the same along some dimensions only.
    assert take(zero, two, one, one) == BLOCKS
    assert take(zero, (2, 2, 1, 1), (2, 2, 1, 1), (1, 2, 4, 4)) == take(zero, (2, 2, 4, 4), (2, 2, 1, 1), (1, 2, 1, 1))
    # With one block, its size may be over the stride.
    assert take((1, 0, 0, 0), one, one, (3, 1, 1, 2)) == [480, 481, 960, 961, 1440, 1441]


@pytest.mark.parametrize("dims", [(60,), (4, 15), (3, 4, 5), (2, 3, 2, 5)])
def test_indexes_of_a_part(spark, tmp_path, dims):
    path = str(tmp_path / "part.h5")
    a = np.arange(60, dtype=np.int32).reshape(dims)
    with Writer(path) as w:
        w.dataset("/a", a, t.integer(32))
    lo, n = tuple(d // 3 for d in dims), tuple(max(1, d // 2) for d in dims)
    got = values(scan(spark, path, "/a", Hyperslab.of(lo, n)))
    assert got == a[tuple(slice(x, x + y) for x, y in zip(lo, n, strict=True))].reshape(-1).tolist()


def test_stamps(spark, tmp_path):
    """8 x 6 of a repeated stamp of three by three."""
    path = str(tmp_path / "stamp.h5")
    a = np.tile(np.array([[0, 1, 0], [1, 1, 0], [0, 0, 0]], dtype=np.int32), (3, 2))[:8]
    with Writer(path) as w:
        w.dataset("/DS1", a, t.integer(32), chunks=(4, 4))
    corner = values(scan(spark, path, "/DS1", Hyperslab.of((0, 0), (3, 2), (3, 3), (2, 2))))
    assert corner == [0, 1, 0, 1, 1, 1, 1, 1] * 3
    total = scan(spark, path, "/DS1").agg(F.sum("value").alias("s"), F.count("*").alias("n")).first()
    assert (total["s"], total["n"]) == (18, 48)


def test_fill_values_and_extension(spark, tmp_path):
    """7 x 4 of i * j - i in a 10 x 6 array: the rest is the fill value; and 4 x 7 extended to 6 x 10."""
    path = str(tmp_path / "fill.h5")
    rows = [[i * j - i for j in range(4)] + [99, 99] if i < 7 else [99] * 6 for i in range(10)]
    with Writer(path) as w:
        w.layout("/DS1", t.integer(32), (10, 6), chunks=(4, 4), max_dims=(None, None), fill=(99).to_bytes(4, "little"))
        part = np.array(rows, dtype=np.int32)
        for k in ((0, 0), (1, 0)):
            w.chunk("/DS1", k, np.ascontiguousarray(part[4 * k[0] : 4 * k[0] + 4, :4]).view("V4"))
    got = {(r["i0"], r["i1"]): r["value"] for r in scan(spark, path, "/DS1").collect()}
    assert [[got[i, j] for j in range(6)] for i in range(10)] == rows
    assert rows[0] == [0, 0, 0, 0, 99, 99] and rows[6] == [-6, 0, 6, 12, 99, 99]
    old = spark.range(28).select(F.floor(F.col("id") / 7).alias("i0"), (F.col("id") % 7).alias("i1"), (F.floor(F.col("id") / 7) * (F.col("id") % 7) - F.floor(F.col("id") / 7)).cast("int").alias("value"))
    grown = {(r["i0"], r["i1"]): r["value"] for r in resize(old, (4, 7), (6, 10), (None, None)).collect()}
    assert len(grown) == 60 and grown[3, 6] == 15 and grown[5, 9] == grown[0, 7] == 0


def test_byte_order_and_low_precision(spark, tmp_path):
    path = str(tmp_path / "order.h5")
    ints = [i * j - j for i in range(4) for j in range(7)]
    ramp = np.array([16 - r + 0.5 * c for r in range(8) for c in range(16)], dtype=np.float32)
    with Writer(path) as w:
        w.dataset("/big", np.array(ints).reshape(4, 7), t.integer(64, big=True))
        w.dataset("/floats", np.array([i / (j + 0.5) + j for i in range(4) for j in range(7)]).reshape(4, 7), t.floating("float64", big=True))
        for name, big in (("/little16", False), ("/big16", True)):
            codes = (ramp.view(np.uint32) >> 16).astype(">u2" if big else "<u2")
            w.dataset(name, codes.tobytes(), t.floating("bfloat16", big=big), dims=(8, 16))
    got = lambda d: [r["value"] for r in scan(spark, path, d).orderBy("i0", "i1").collect()]
    assert got("/big") == ints
    assert got("/floats")[:3] == [0.0, 1.0, 2.0] and got("/floats")[7] == 2.0
    assert got("/little16") == got("/big16") == ramp.tolist()
    assert [got("/big16")[16 * r] for r in range(8)] == [16, 15, 14, 13, 12, 11, 10, 9]


@pytest.mark.parametrize("filters", [filter_list(4, shuffle=True), filter_list(4, fletcher32=True), filter_list(4, gzip=9), filter_list(4, 9, True, True), filter_list(4, lzf=True)])
def test_filters(spark, tmp_path, filters):
    path = str(tmp_path / "filters.h5")
    with Writer(path) as w:
        w.dataset("/d", np.arange(200, dtype=np.int32).reshape(20, 10), t.integer(32), chunks=(10, 5), filters=filters)
    assert values(scan(spark, path, "/d", Hyperslab.of((0, 0), (20, 10)))) == list(range(200))


def test_strings_enums_and_opaque(spark, tmp_path):
    path = str(tmp_path / "other.h5")
    words = ["Parting", "is such", "sweet", "sorrow."]
    with Writer(path) as w:
        w.dataset("/space", words, t.fixed_string(7, padding=2), dims=(4,))
        w.dataset("/vlen", words, t.VLEN_STRING, dims=(4,))
        w.dataset("/cut", ["truncated", "x"], t.fixed_string(5), dims=(2,))
        phases = ["SOLID", "LIQUID", "GAS", "PLASMA"]
        w.dataset("/phase", [phases[i * j % 4] for i in range(4) for j in range(7)], t.enum_of(t.integer(16, big=True), {n: k for k, n in enumerate(phases)}), dims=(4, 7))
        w.dataset("/blob", [f"OPAQUE{k}".encode() for k in range(4)], t.opaque(7, "Character array"), dims=(4,))
        w.dataset("/runs", [[3, 2, 1], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]], t.vlen(t.integer(32)), dims=(2,))
        w.dataset("/grid", [[[i * (j + 1) for j in range(5)] for _ in range(3)] for i in range(4)], t.array_of(t.integer(64), (3, 5)), dims=(4,))
    got = lambda d: [r["value"] for r in scan(spark, path, d).orderBy("i0").collect()]
    assert got("/space") == got("/vlen") == words
    assert got("/cut") == ["trunc", "x"]
    assert [r["value"] for r in scan(spark, path, "/phase").orderBy("i0", "i1").collect()] == [i * j % 4 for i in range(4) for j in range(7)]
    assert got("/blob") == [b"OPAQUE0", b"OPAQUE1", b"OPAQUE2", b"OPAQUE3"]
    assert got("/runs") == [[3, 2, 1], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]]
    assert got("/grid")[2] == [[2, 4, 6, 8, 10]] * 3


def test_members_that_are_not_asked_for_are_not_decoded(spark, tmp_path):
    path = str(tmp_path / "fields.h5")
    with Writer(path) as w:
        w.dataset("/d", [{"id": k, "text": f"t{k}", "x": k / 2} for k in range(5)], t.compound({"id": t.integer(32), "text": t.VLEN_STRING, "x": t.floating("float32")}), dims=(5,))
    some = scan(spark, path, "/d", fields="id,x")
    assert some.schema["value"].dataType.names == ["id", "x"] and [tuple(r["value"]) for r in some.orderBy("i0").collect()] == [(k, k / 2) for k in range(5)]
    for bad in ("nope", "id,nope"):
        with pytest.raises(Exception, match="members"):
            scan(spark, path, "/d", fields=bad).collect()


def test_chunk_iteration_starts_anew_and_is_cancelled(spark, cube):
    seen = []
    it = ChunkIterator(spark, cube, "/chunked", lambda done, total: seen.append((done, total)))
    first = next(it)["chunk"]
    next(it)
    it.reset()
    assert next(it)["chunk"] == first and it.done == 1 and seen == [(1, it.total), (2, it.total), (1, it.total)]
    assert it.total == 2 * 3 * 2 * 3 and len(list(it)) == it.total - 1
    it.reset()
    next(it)
    it.cancel()
    assert list(it) == []
    with pytest.raises(RuntimeError):
        it.reset()


def test_writes_of_frames(spark, tmp_path):
    """Null values and missing rows, nested members, errors, and appending to a file that has the dataset."""
    register(spark)
    path = str(tmp_path / "frames.h5")
    put = lambda df, d, n, mode="append", **o: df.write.format("h5array").options(dataset=d, dims=str(n), **o).mode(mode).save(path)
    put(spark.createDataFrame([(0, "a"), (2, None)], "i0 long, value string"), "/g/text", 4, "overwrite")
    put(spark.createDataFrame([(1, (1, None, [2.5])), (0, None)], "i0 long, value struct<a:int,b:string,c:array<double>>"), "/g/rows", 3)
    put(spark.createDataFrame([(0, bytearray(b"\x00\x01"))], "i0 long, value binary"), "/bytes", 2)
    put(spark.createDataFrame([(k, k * k) for k in range(5)], "i0 long, value long"), "/squares", 6)
    got = lambda d: [r["value"] for r in scan(spark, path, d).orderBy("i0").collect()]
    assert got("/g/text") == ["a", "", "", ""]
    assert [tuple(v) for v in got("/g/rows")] == [(0, "", []), (1, "", [2.5]), (0, "", [])]
    assert got("/bytes") == [[0, 1], []] and got("/squares") == [0, 1, 4, 9, 16, 0]
    for df, d in ((spark.createDataFrame([(9, 1)], "i0 long, value long"), "/new"), (spark.createDataFrame([(0, 1)], "i0 long, value long"), "/squares")):
        with pytest.raises(Exception, match="outside|squares"):
            put(df, d, 6)
    r = Reader(opener(path))
    assert sorted(p for p, _, _ in r.walk()) == ["/bytes", "/g", "/g/rows", "/g/text", "/squares"]


def test_chunks_that_tasks_encode(spark, tmp_path):
    """Edge chunks, chunks without a row, null values, another byte order, and a dataset added to a file."""
    path = str(tmp_path / "chunks.h5")
    df = spark.range(23 * 17).select((F.col("id") / 17).cast("long").alias("i0"), (F.col("id") % 17).alias("i1"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("value")).where("not (i0 < 4 and i1 < 5)")
    write_chunks(df, path, "/a/b", [23, 17], [4, 5], "int32", gzip=6, shuffle=True, fletcher32=True)
    write_chunks(df.withColumn("value", F.col("value") / 2), path, "/c", [23, 17], [10, 17], "float64", mode="append")
    want = {(k // 17, k % 17): k if k % 5 and not (k // 17 < 4 and k % 17 < 5) else 0 for k in range(23 * 17)}
    assert {(r["i0"], r["i1"]): r["value"] for r in scan(spark, path, "/a/b").collect()} == want
    assert {(r["i0"], r["i1"]): r["value"] for r in scan(spark, path, "/c").collect()} == {k: v / 2 for k, v in want.items()}
    r = Reader(opener(path))
    assert len(r.chunks(r.dataset(r.find("/a/b")))) == 6 * 4 - 1
