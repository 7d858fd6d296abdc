"""Codecs, the file format and the data source."""

import bz2
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import codecs, lowfloat
from lattica.operators.selection import Hyperslab
from lattica.sources import h5types as t
from lattica.sources.h5array import chunk_iterator, register, scan
from lattica.sources.h5read import FormatError, Reader, opener
from lattica.sources.h5write import Writer, filter_list


@given(st.binary(max_size=400), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_codecs_there_and_back(data, size):
    assert codecs.unshuffle(codecs.shuffle(data, size), size) == data
    assert codecs.lzf_decompress(codecs.lzf_compress(data)) == data
    assert codecs.strip_fletcher32(codecs.add_fletcher32(data)) == data
    pipe = [(codecs.SHUFFLE, (size,)), (codecs.DEFLATE, (6,)), (codecs.FLETCHER32, ())]
    assert codecs.decode(codecs.encode(data, pipe), pipe) == data


def test_codec_facts():
    assert codecs.lookup3(b"") == 0xDEADBEEF and codecs.lookup3(b"Four score and seven years ago") == 0x17770551
    assert codecs.decode(bz2.compress(b"abc"), [(codecs.BZIP2, ())]) == b"abc"
    assert codecs.decode(zlib.compress(b"abc"), [(codecs.SHUFFLE, (4,)), (codecs.DEFLATE, ())], mask=1) == b"abc"
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"x", [(codecs.SZIP, ())])
    with pytest.raises(codecs.CodecError):
        codecs.strip_fletcher32(b"abcd" + b"\1\2\3\4")
    assert codecs.lzf_decompress(b"\x00a\x20\x00") == b"aaaa"


def test_low_precision_floats():
    x = np.array([1.0, -2.5, 0.0, 1e30, np.inf, np.nan, 1.00390625, 1.01171875], dtype=np.float32)
    code = lowfloat.bf16_encode(x)
    assert [hex(c) for c in code[:3]] == ["0x3f80", "0xc020", "0x0"] and code[5] == 0x7FC0
    assert lowfloat.bf16_decode(code)[6] == 1.0 and lowfloat.bf16_decode(code)[7] == np.float32(1.015625)  # ties to even
    assert (lowfloat.bf16_from_bytes(lowfloat.bf16_to_bytes(code)) == code).all()
    for f in (lowfloat.E4M3, lowfloat.E5M2):
        values = lowfloat.f8_table(f, "ocp")
        finite = np.isfinite(values)
        assert (lowfloat.f8_decode(lowfloat.f8_encode(values[finite], f), f, "ocp") == values[finite]).all()
    assert lowfloat.f8_decode(lowfloat.f8_encode(np.array([1e9, -1e9]), lowfloat.E4M3), lowfloat.E4M3, "ocp").tolist() == [448.0, -448.0]
    assert np.isinf(lowfloat.f8_decode(lowfloat.f8_encode(np.array([1e9]), lowfloat.E5M2), lowfloat.E5M2, "ocp"))
    assert np.isnan(lowfloat.f8_table(lowfloat.E4M3)[0x78]) and np.isinf(lowfloat.f8_table(lowfloat.E4M3)[0x7F])


A = np.arange(25 * 35, dtype=np.int32).reshape(25, 35)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("h5") / "a.h5")
    with Writer(p) as w:
        w.group("/g")
        w.group("/g/sub")
        w.dataset("/g/c", A, t.type_of("int32"), chunks=(10, 10), filters=filter_list(4, gzip=6, shuffle=True, fletcher32=True), max_dims=(None, None))
        w.dataset("/g/many", A, t.type_of("int32"), chunks=(1, 2), filters=filter_list(4, lzf=True))
        w.dataset("/f", np.arange(24.0).reshape(2, 3, 4), t.type_of("float64"))
        w.dataset("/sparse", A, t.type_of("int32"), chunks=(10, 10), skip=[(0, 1), (2, 3)], fill=(99).to_bytes(4, "little"))
        for name in ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float16", "float32", "float64"):
            dtype = np.dtype(name)
            edge = [np.iinfo(dtype).min, np.iinfo(dtype).max, 1] if dtype.kind in "iu" else [-1.5, 0.0, 2.0]
            w.dataset(f"/{name}", np.array(edge, dtype=dtype), t.type_of(name))
        w.dataset("/big", np.arange(6), t.integer(64, big=True))
        w.dataset("/s", ["hello", "", "truncated words"], t.fixed_string(9))
        w.dataset("/padded", ["a", "b  "], t.fixed_string(5, padding=2))
        w.dataset("/vs", ["a", "", "long " * 2000, "é"], t.VLEN_STRING)
        w.dataset("/vi", [[1, 2], [], [3, 4, 5]], t.type_of("vlen:int32"), dims=(3,))
        w.dataset("/array", [[[1, 2], [3, 4]], [[5, 6], [7, 8]]], t.array_of(t.integer(16), (2, 2)), dims=(2,))
        w.dataset("/enum", ["GAS", "SOLID"], t.enum_of(t.integer(16, big=True), {"SOLID": 0, "GAS": 2}))
        w.dataset("/opaque", [b"1234567"], t.opaque(7, "blob"))
        w.dataset("/ref", [5, 6], t.OBJECT_REFERENCE, dims=(2,))
        w.dataset("/region", [b"123456789012"], t.REGION_REFERENCE, dims=(1,))
        w.dataset("/bf16", np.array([0x3F80, 0x4000], dtype=np.uint16).tobytes(), t.type_of("bfloat16"), dims=(2,))
        w.dataset("/struct", [{"id": 1, "p": {"x": 1.5}, "s": "ab"}, {"id": 2, "p": {"x": 3}, "s": "cde"}], t.compound({"id": t.integer(32, signed=False), "p": t.compound({"x": t.floating("float32")}), "s": t.fixed_string(4)}), dims=(2,))
        w.named_type("/type", t.integer(32))
        w.hard_link("/g/again", "/f")
        w.hard_link("/g/up", "/g")
        w.soft_link("/soft", "/g/c")
        w.soft_link("/nowhere", "/none")
        w.external_link("/ext", "other.h5", "/x")
        for k in range(12):
            w.attribute("/g", f"a{k:02}", k * 1.5)
        w.attribute("/g", "a00", 7)  # in place of the first
        w.attribute("/f", "names", ["x", "yy"])
        w.attribute("/f", "codes", np.array([1, 2, 250], dtype=np.uint8))
        w.group("/empty")
        w.group("/gone")
        w.delete("/gone")
    return p


def values(r, name):
    d = r.dataset(r.find(name))
    out = r.values().of(d.type, r.array(name).reshape(-1, *t.numpy_type(d.type).shape))
    return out.tolist() if isinstance(out, np.ndarray) else out


def test_reading(path):
    r = Reader(opener(path))
    assert (r.array("/g/c") == A).all() and (r.array("/g/many") == A).all() and (r.array("/soft") == A).all()
    want = A.copy()
    want[0:10, 10:20] = want[20:, 30:] = 99
    assert (r.array("/sparse") == want).all()
    for name in ("int8", "uint16", "int64", "uint64"):
        info = np.iinfo(name)
        assert [int(v) for v in values(r, f"/{name}")] == [info.min, info.max, 1]
    assert values(r, "/float16") == [-1.5, 0.0, 2.0] and values(r, "/big") == list(range(6))
    assert values(r, "/s") == ["hello", "", "truncated"] and values(r, "/padded") == ["a", "b"]
    assert values(r, "/vs") == ["a", "", "long " * 2000, "é"] and values(r, "/vi") == [[1, 2], [], [3, 4, 5]]
    assert values(r, "/array") == [[[1, 2], [3, 4]], [[5, 6], [7, 8]]] and values(r, "/enum") == [2, 0]
    assert values(r, "/opaque") == [b"1234567"] and values(r, "/ref") == [5, 6] and values(r, "/bf16") == [1.0, 2.0]
    assert values(r, "/struct") == [{"id": 1, "p": {"x": 1.5}, "s": "ab"}, {"id": 2, "p": {"x": 3.0}, "s": "cde"}]
    attributes = {a.name: r.attribute_value(a) for a in r.attributes(r.find("/g"))}
    assert len(attributes) == 12 and attributes["a00"] == 7 and attributes["a11"] == 16.5
    assert {a.name: r.attribute_value(a) for a in r.attributes(r.find("/f"))} == {"names": ["x", "yy"], "codes": [1, 2, 250]}
    paths = [p for p, _, _ in r.walk()]
    assert paths == sorted(paths, key=lambda p: [x.encode() for x in p.split("/")]) and "/g/up" in paths and "/g/up/c" not in paths and "/gone" not in paths
    with pytest.raises(KeyError):
        r.find("/none")
    with pytest.raises(KeyError):
        r.find("/nowhere")


def test_damage_is_found(path, tmp_path):
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1
    bad = tmp_path / "bad.h5"
    bad.write_bytes(data)
    with pytest.raises(FormatError):
        Reader(opener(str(bad)))
    (tmp_path / "no.h5").write_bytes(b"x" * 100)
    with pytest.raises(FormatError):
        Reader(opener(str(tmp_path / "no.h5")))


def old_file(path):
    """By hand, from the published format: superblock 0, a version 1 header, a symbol table, a local heap."""
    u = (1 << 64) - 1
    data = struct.pack("<3d", 1.5, 2.5, 3.5)
    heap_text = b"\0" * 8 + b"one\0".ljust(8, b"\0")
    at = {"root": 96, "heap": 200, "text": 240, "tree": 300, "node": 900, "set": 1300, "data": 1600}
    message = lambda kind, body: struct.pack("<HHBBBB", kind, len(body), 0, 0, 0, 0) + body
    header = lambda parts: struct.pack("<BBHII", 1, 0, len(parts), 1, sum(map(len, parts))) + b"\0" * 4 + b"".join(parts)
    out = bytearray(1700)
    put = lambda where, b: out.__setitem__(slice(where, where + len(b)), b)
    put(0, b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, u, 1700, u) + struct.pack("<QQII", 0, at["root"], 1, 0) + struct.pack("<QQ", at["tree"], at["heap"]))
    put(at["root"], header([message(17, struct.pack("<QQ", at["tree"], at["heap"]))]))
    put(at["heap"], b"HEAP" + b"\0" * 4 + struct.pack("<QQQ", len(heap_text), 1, at["text"]))
    put(at["text"], heap_text)
    put(at["tree"], b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, u, u) + struct.pack("<QQQ", 0, at["node"], 8))
    put(at["node"], b"SNOD" + struct.pack("<BBH", 1, 0, 1) + struct.pack("<QQII", 8, at["set"], 0, 0) + b"\0" * 16)
    kind = bytes([0x11, 0x20, 63, 0]) + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023)
    space = struct.pack("<BBB5xQ", 1, 1, 0, 3)
    layout = struct.pack("<BBQQ", 3, 1, at["data"], 24)
    attr_space = struct.pack("<BBB5x", 1, 0, 0)
    attribute = struct.pack("<BBHHH", 1, 0, 2, len(kind), len(attr_space)) + b"u\0".ljust(8, b"\0") + kind.ljust(24, b"\0") + attr_space + struct.pack("<d", 9.5)
    put(at["set"], header([message(3, kind), message(1, space), message(8, layout + b"\0" * 6), message(12, attribute)]))
    put(at["data"], data)
    path.write_bytes(out)


def test_old_layout(tmp_path):
    old_file(tmp_path / "old.h5")
    r = Reader(opener(str(tmp_path / "old.h5")))
    assert r.version == 0 and [x.name for x in r.links(r.header(r.root))] == ["one"]
    assert r.array("/one").tolist() == [1.5, 2.5, 3.5]
    (a,) = r.attributes(r.find("/one"))
    assert (a.name, r.attribute_value(a)) == ("u", 9.5)


def test_a_revised_copy(path, tmp_path):
    new = str(tmp_path / "new.h5")
    w = Writer.revise(path, new)
    w.attribute("/f", "codes", 5)
    w.delete_attribute("/g", "a01")
    w.dataset("/g/sub/more", [1, 2], t.integer(16), dims=(2,))
    w.resize("/g/c", (12, 35))
    w.delete("/big")
    w.close()
    r, old = Reader(opener(new)), Reader(opener(path))
    assert (r.array("/g/c") == A[:12]).all() and (r.array("/sparse") == old.array("/sparse")).all()
    for name in ("/vs", "/vi", "/struct", "/enum", "/uint64", "/bf16", "/opaque"):
        assert values(r, name) == values(old, name)
    assert {p for p, _, _ in r.walk()} == {p for p, _, _ in old.walk()} - {"/big"} | {"/g/sub/more"}
    assert {a.name: r.attribute_value(a) for a in r.attributes(r.find("/f"))} == {"names": ["x", "yy"], "codes": 5}
    assert len(r.attributes(r.find("/g"))) == 11


def dense_file(path):
    """By hand, from the published format: a group whose links are in a fractal heap, found by a version 2 index of two levels; one attribute likewise."""
    u, sum_ = (1 << 64) - 1, lambda b: b + struct.pack("<I", codecs.lookup3(b))
    out = bytearray(b"\0" * 48)

    def put(b):
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(b)
        return len(out) - len(b)

    def header(parts):
        body = b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in parts)
        return put(sum_(b"OHDR\x02\x02" + struct.pack("<I", len(body)) + body))

    def heap(objects, rows):
        """Objects in direct blocks of 512 bytes: one block as the root, or four to a row below an indirect block."""
        front = 5 + 8 + 4
        blocks, ids = [bytearray(front)], []
        for o in objects:
            if rows and len(blocks[-1]) + len(o) > 512:
                blocks.append(bytearray(front))
            ids.append(bytes([0]) + struct.pack("<I", 512 * (len(blocks) - 1) + len(blocks[-1])) + struct.pack("<H", len(o)))
            blocks[-1] += o
        places = [put(bytes(b).ljust(512, b"\0")) for b in blocks]
        for k, p in enumerate(places):
            out[p : p + 17] = b"FHDB\0" + struct.pack("<QI", 0, 512 * k)
        root = put(b"FHIB\0" + struct.pack("<QI", 0, 0) + b"".join(struct.pack("<Q", p) for p in places + [u] * (4 * rows - len(places)))) if rows else places[0]
        head = b"FRHP\0" + struct.pack("<HHBI", 7, 0, 0, 400) + struct.pack("<QQQQQQQQ", 0, u, 0, u, 0, 0, 0, len(objects)) + struct.pack("<QQQQ", 0, 0, 0, 0)
        head += struct.pack("<HQQHHQH", 4, 512, 512, 32, 1, root, rows)
        return put(sum_(head)), ids

    def tree(kind, records, split):
        size, node = len(records[0]), 160
        leaf = lambda rs: put(sum_(b"BTLF\0" + bytes([kind]) + b"".join(rs)).ljust(node, b"\0"))
        if split:
            k = len(records) // 2
            a, b = leaf(records[:k]), leaf(records[k + 1 :])
            root, n = put((b"BTIN\0" + bytes([kind]) + records[k] + struct.pack("<QB", a, k) + struct.pack("<QB", b, len(records) - k - 1)).ljust(node, b"\0")), 1
        else:
            root, n = leaf(records), len(records)
        return put(sum_(b"BTHD\0" + bytes([kind]) + struct.pack("<IHHBBQHQ", node, size, int(split), 100, 40, root, n, len(records))))

    kind, space = t.encode_type(t.integer(32)), bytes([2, 1, 0, 1]) + struct.pack("<Q", 3)
    names = [f"v{k:02}" for k in range(16)]
    sets = [header([(3, kind), (1, space), (8, bytes([3, 1]) + struct.pack("<QQ", put(struct.pack("<3i", k, k + 1, k + 2)), 12))]) for k in range(16)]
    links = [bytes([1, 0, len(n)]) + n.encode() + struct.pack("<Q", a) + b" " * 60 for n, a in zip(names, sets, strict=True)]
    at, ids = heap(links, 1)
    records = sorted(struct.pack("<I", codecs.lookup3(n.encode())) + i for n, i in zip(names, ids, strict=True))
    index = tree(5, records, True)
    attribute = struct.pack("<BBHHHB", 3, 0, 2, len(kind), 4, 0) + b"x\0" + kind + bytes([2, 0, 0, 0]) + struct.pack("<i", -4)
    heap2, ids2 = heap([attribute], 0)
    index2 = tree(8, [ids2[0].ljust(8, b"\0") + b"\0" + struct.pack("<II", 0, codecs.lookup3(b"x"))], False)
    root = header([(2, struct.pack("<BBQQ", 0, 0, at, index)), (21, struct.pack("<BBQQ", 0, 0, heap2, index2))])
    head = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, u, len(out), root)
    out[:48] = sum_(head)
    path.write_bytes(out)


def test_indexed_links_and_attributes(tmp_path):
    dense_file(tmp_path / "dense.h5")
    r = Reader(opener(str(tmp_path / "dense.h5")))
    assert [p for p, _, _ in r.walk()] == [f"/v{k:02}" for k in range(16)]
    assert r.array("/v07").tolist() == [7, 8, 9] and r.array("/v15").tolist() == [15, 16, 17]
    (a,) = r.attributes(r.header(r.root))
    assert (a.name, r.attribute_value(a)) == ("x", -4)


def test_refusals(tmp_path):
    w = Writer(str(tmp_path / "w.h5"))
    for call in (
        lambda: w.dataset("x", [1], t.integer(32)), lambda: w.dataset("/x", np.zeros((0,)), t.integer(32)),
        lambda: w.dataset("/x", [1, 2], t.integer(32), dims=(2,), chunks=(3,)), lambda: w.dataset("/x", [1, 2], t.integer(32), dims=(2,), filters=filter_list(4, gzip=1)),
        lambda: filter_list(4, gzip=10), lambda: w.dataset("/x", [1, 2, 3], t.integer(32), dims=(2,)), lambda: w.attribute("/", "e", []), lambda: w.external_link("/e", "../x.h5", "/a"),
        lambda: w.soft_link("/s", ""), lambda: t.fixed_string(0), lambda: t.array_of(t.integer(8), ()), lambda: t.enum_of(t.integer(8), {}), lambda: w.group("/a//b"),
    ):
        with pytest.raises(ValueError):
            call()
    w.group("/g")
    w.group("/g/h")
    with pytest.raises(ValueError):
        w.delete("/g")
    with pytest.raises(KeyError):
        w.group("/none/x")
    with pytest.raises(ValueError):
        w.group("/g")
    w.delete("/g/h")
    w.delete("/g")
    w.dataset("/r", np.arange(10.0), t.type_of("float64"), chunks=(3,), max_dims=(None,))
    w.resize("/r", (7,))
    with pytest.raises(ValueError):
        w.resize("/r", (0,))
    w.close()
    assert Reader(opener(str(tmp_path / "w.h5"))).array("/r").tolist() == list(range(7))
    with pytest.raises(FileExistsError):
        Writer(str(tmp_path / "w.h5"), "x")


def test_data_source(spark, path):
    register(spark)
    read = lambda **o: spark.read.format("h5array").options(path=path, **o).load()
    s = Hyperslab.of((3, 1), (5, 4), (4, 9), (2, 3))
    rows = scan(spark, path, "/g/c", s).orderBy("out_idx").collect()
    picks = [np.concatenate([np.arange(a + k * st_, a + k * st_ + b) for k in range(c)]) for a, c, st_, b in zip(s.start, s.count, s.stride, s.block, strict=True)]
    assert [r["value"] for r in rows] == A[np.ix_(*picks)].reshape(-1).tolist()
    assert scan(spark, path, "/g/c", partition_bytes="500").agg(F.sum("value")).first()[0] == A.sum()
    assert scan(spark, path, "/f", compat="true").where("i2 = 3").agg(F.sum("value")).first()[0] == sum(range(3, 24, 4))
    assert read(dataset="/f", form="rows").where("i0 = 1 and i1 = 2").first()["values"] == [20.0, 21.0, 22.0, 23.0]
    assert read(dataset="/struct").select("value.p.x").collect()[0][0] == 1.5
    assert [r["value"] for r in read(dataset="/uint64").orderBy("i0").collect()][1] == 2**64 - 1
    assert read(table="superblock").first()["version"] == 2
    assert read(table="objects").where("kind = 'datatype'").count() == 1
    assert {r["link_type"] for r in read(table="links").collect()} == {"hard", "soft", "external"}
    assert read(table="attributes").where("path = '/g'").count() == 12
    assert read(table="objects").where("path = '/g/c'").first()["info"] == "Dataset: integer (size=4 bytes), 2D array [25 x 35]"
    seen = []
    chunks = list(chunk_iterator(spark, path, "/sparse", lambda done, total: seen.append((done, total))))
    assert len(chunks) == 10 and seen[-1] == (10, 10) and [r["chunk"] for r in chunks] == sorted(r["chunk"] for r in chunks)
    with pytest.raises(Exception, match="not chunked"):
        read(dataset="/f", form="chunks").count()


def test_writing_from_spark(spark, tmp_path):
    register(spark)
    df = spark.range(1000).select((F.col("id") / 40).cast("long").alias("i0"), (F.col("id") % 40).alias("i1"), F.col("id").cast("double").alias("value"))
    target = str(tmp_path / "b.h5")
    write = lambda mode, frame=df: frame.repartition(3).write.format("h5array").options(dataset="/a/b", dims="25,40", dtype="float32", chunks="10,16", gzip="4", shuffle="true").mode(mode).save(target)
    write("overwrite")
    back = scan(spark, target, "/a/b")
    assert back.where("value <> i0 * 40 + i1").count() == 0 and back.count() == 1000
    with pytest.raises(Exception, match="FileExists"):
        write("append")
    with pytest.raises(Exception, match="outside"):
        write("overwrite", df.withColumn("i1", F.col("i1") + 1))


@pytest.mark.parametrize("n", [1, 8, 9, 20, 300, 3000])
def test_many_links_and_attributes(tmp_path, n):
    """Indexes of one to three levels, heaps of one block and of several rows."""
    names = [f"name {k} {'x' * (k % 40)}é" for k in range(n)]
    with Writer(str(tmp_path / "many.h5")) as w:
        w.group("/g")
        w.dataset("/d", [7], t.integer(16), dims=(1,))
        for k, name in enumerate(names):
            if k % 3 == 0:
                w.soft_link(f"/g/{name}", f"/target {k}")
            elif k % 3 == 1:
                w.hard_link(f"/g/{name}", "/d")
            else:
                w.external_link(f"/g/{name}", "other.h5", f"/x{k}")
            w.attribute("/d", name, [k, k + 1])
    r = Reader(opener(str(tmp_path / "many.h5")))
    links = r.links(r.find("/g"))
    assert [x.name for x in links] == sorted(names, key=str.encode)
    by = {x.name: x for x in links}
    for k, name in enumerate(names):
        assert (by[name].kind, by[name].path) == (("soft", f"/target {k}"), ("hard", None), ("external", f"/x{k}"))[k % 3]
    assert {a.name: r.attribute_value(a) for a in r.attributes(r.find("/d"))} == {name: [k, k + 1] for k, name in enumerate(names)}
    if n > 1:
        assert r.array(f"/g/{names[1]}").tolist() == [7]
    hashes = [int.from_bytes(x[:4], "little") for i in r.find("/g").of(2) if n > 8 for x in r.tree_records(struct.unpack_from("<Q", i, 10)[0])]
    assert hashes == sorted(hashes) and len(hashes) == (n if n > 8 else 0)


@pytest.mark.parametrize("n", [0, 5, 9, 700])
def test_old_files_are_written(tmp_path, n):
    old, new = str(tmp_path / "old.h5"), str(tmp_path / "new.h5")
    with Writer(old, superblock=0) as w:
        w.group("/g")
        w.group("/g/sub")
        w.dataset("/g/sub/c", A, t.integer(32), chunks=(10, 10), filters=filter_list(4, 6, True, True))
        w.dataset("/text", ["a", "bcd"], t.VLEN_STRING, dims=(2,))
        w.hard_link("/again", "/g/sub/c")
        w.soft_link("/soft", "/g/sub/c")
        for k in range(n):
            w.dataset(f"/g/n{k}", [k], t.integer(32), dims=(1,))
            w.attribute("/g", f"a{k}", k)
        with pytest.raises(ValueError):
            w.external_link("/e", "f.h5", "/x")
    r = Reader(opener(old))
    assert r.version == 0 and (r.array("/soft") == A).all() and (r.array("/again") == A).all() and values(r, "/text") == ["a", "bcd"]
    assert [x.name for x in r.links(r.find("/g"))] == sorted([f"n{k}" for k in range(n)] + ["sub"])
    assert all(r.array(f"/g/n{k}").tolist() == [k] for k in range(0, n, 50))
    assert {a.name: r.attribute_value(a) for a in r.attributes(r.find("/g"))} == {f"a{k}": k for k in range(n)}
    Writer.revise(old, new).close()
    back = Reader(opener(new))
    assert back.version == 2 and {p for p, _, _ in back.walk()} == {p for p, _, _ in r.walk()} and (back.array("/soft") == A).all()


def test_raw_bytes(tmp_path):
    path = str(tmp_path / "raw.h5")
    with Writer(path) as w:
        w.dataset("/d", [0, 0, 0], t.integer(16), dims=(3,))
        w.dataset("/s", ["a"], t.VLEN_STRING, dims=(1,))
        w.raw("/d", struct.pack("<3h", 5, -6, 7))
        for bad in (("/d", b"123"), ("/s", b"\0" * 16)):
            with pytest.raises(ValueError):
                w.raw(*bad)
    assert Reader(opener(path)).array("/d").tolist() == [5, -6, 7]


def test_dump(spark, tmp_path, capsys):
    from lattica import dump

    file = tmp_path / "some.bin"
    file.write_bytes(bytes(range(60, 100)))
    assert dump.main(["-offset", "4", "-length", "18", str(file)]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "00000004  40 41 42 43 44 45 46 47 48 49 4a 4b 4c 4d 4e 4f  @ABCDEFGHIJKLMNO"
    assert out[1].startswith("00000014  50 51 ") and out[1].endswith("PQ") and len(out) == 2
    with pytest.raises(SystemExit):
        dump.main(["-offset", "-1", str(file)])


def test_heap_beyond_its_direct_blocks(tmp_path):
    """Links of over 458,752 bytes in all: the heap's larger blocks are tables of blocks; each object is found."""
    from lattica.sources import h5index
    from lattica.sources.h5read import Fractal

    path, names = str(tmp_path / "many.h5"), [f"link-{k:06}" for k in range(16_000)]
    with Writer(path) as w:
        w.group("/g")
        for n in names:
            w.soft_link(f"/g/{n}", "/a target/of a link/" + n[::-1])
    assert [(p, x.path) for p, x, _ in Reader(opener(path)).walk() if x.kind == "soft"] == [(f"/g/{n}", "/a target/of a link/" + n[::-1]) for n in names]
    # Objects of all lengths, up to several nested tables.
    objects = [bytes([k % 251]) * (1 + 37 * k % 487) for k in range(30_000)]
    with open(tmp_path / "heap", "w+b") as f:
        def append(data):
            f.seek(0, 2)
            at = f.tell()
            f.write(data)
            return at

        def put(at, data):
            f.seek(at)
            f.write(data)

        append(b"\0" * 8)
        heap, ids = h5index.write_heap(append, put, objects, 7)

        def read(at, n):
            f.seek(at)
            return f.read(n)

        r = Reader(opener(path))
        r.read = read
        fractal = Fractal(r, heap)
        assert [fractal.get(i) for i in ids] == objects and fractal.most == 1 << 16 and fractal.rows > 9


@pytest.mark.parametrize(("options", "kind"), [({}, "array<double>"), ({"chunks": "1000", "gzip": "1"}, "array<double>"), ({}, "string"), ({}, "binary"), ({}, "array<struct<a:int,b:double>>")])
def test_sequences_are_written_in_parts(spark, tmp_path, options, kind):
    """The commit of sequences holds a batch of them at a time; places without a row, nulls and empty ones are empty."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    from lattica.sources.h5array import ArrayWriter

    n = 100_000
    one = {"array<double>": lambda k: [k / 2] * (k % 7), "string": lambda k: "é" * (k % 7), "binary": lambda k: b"x" * (k % 7), "array<struct<a:int,b:double>>": lambda k: [{"a": k, "b": 0.5}] * (k % 3)}[kind]
    value = lambda k: None if k % 11 == 0 else one(k) if k != 5 else one(6) * 2_000  # noqa: E731 (one of over a collection)
    schema = _parse_datatype_string(f"i0 bigint, value {kind}")
    path = str(tmp_path / "sequences.h5")
    w = ArrayWriter({"path": path, "dataset": "/s", "dims": str(n)} | options, schema, True)
    batches = [pa.RecordBatch.from_arrays([pa.array(places), pa.array([value(k) for k in places], to_arrow_schema(schema).field(1).type)], schema=to_arrow_schema(schema)) for places in (list(range(a, n - 10, 16)) for a in range(16))]
    messages = [w.write(iter([b.slice(0, 2_000), b.slice(2_000)])) for b in batches]
    tracemalloc.start()
    w.commit(messages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    r = Reader(opener(path))
    d = r.dataset(r.find("/s"))
    got = list(r.values().of(d.type, r.box(d, (0,), (n,))))
    plain = lambda x: bytes(x) if kind == "binary" else x
    assert [plain(x) for x in got] == [(value(k) if k < n - 10 else None) or one(0) for k in range(n)]
    assert most < 10 << 20
