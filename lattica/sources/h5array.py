"""The ``h5array`` data source: catalogs and arrays of a file as DataFrames, and arrays written to one.

Reading: option ``path``; ``table`` is objects, links, attributes, named_types or superblock, or ``dataset`` names an
array. ``form``: long (i0, i1, …, value), rows (the last dimension as an array) or chunks (allocated chunks
with coordinates, offset, shape and data). ``compat``: all numbers as double. ``fields`` ("a,b") are the members of
a compound that are decoded; the others are not. ``bounds`` ("lo:hi,lo:hi,…", hi not
included) limits what is read: chunks and byte ranges outside are not touched; :func:`scan` sets it from a
selection. (Filters that Spark pushes into a Python source stay with the DataFrame they were pushed from, and
would prune its other queries too; so bounds are explicit.)

Writing: rows (i0, i1, …, value) with options ``dataset``, ``dims`` and, if wanted, ``dtype``, ``chunks``, ``gzip``,
``shuffle``, ``fletcher32``. Without a ``dtype`` the value's Spark type gives it: numbers, strings (``vlen_string``),
binary, arrays (sequences) and structs of these (compounds). ``enum`` ("name=code,…") writes codes of named values.
Mode overwrite makes the file anew; append adds the dataset to a copy of the file, which then replaces it.
Tasks write their elements to part files beside the target; the commit places them and writes the file, so that
step is one process whose time grows with the file. Elements without a row are zero, empty or null members.
Sequences and strings are put into heap collections by the tasks: the commit places these whole, one part after the other,
and has a batch of elements in memory at a time. (Sequences of these, and structs with such members, are held whole by the commit.)
Numbers in chunks are better written by :func:`write_chunks`: tasks make whole chunks and apply the filters, and
the commit only puts their bytes one after the other and adds the index.
"""

from __future__ import annotations

import json
import mmap
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.functions.codecs import encode
from lattica.functions.shapes import chunk_counts, safe_product, strides
from lattica.operators.layout import with_chunks
from lattica.operators.selection import Hyperslab, hyperslab

from .h5read import Chunk, Dataset, Reader, opener
from .h5types import ENUM, FIXED, FLOAT, VLEN, VLEN_STRING, H5Type, compound, enum_of, floating, integer, numpy_type, parse_type, spark_type, type_of, vlen
from .h5write import Collections, Writer, filter_list, refers, sequence_bytes

TARGET_BYTES = 32 << 20
TABLES = {
    "superblock": "version int, offset_size int, length_size int, base bigint, end_of_file bigint, root bigint",
    "objects": "path string, kind string, address bigint, dtype string, dims array<bigint>, max_dims array<bigint>, layout string, chunk_dims array<bigint>, filters array<int>, info string, error string",
    "links": "path string, parent string, name string, link_type string, target bigint, target_path string, target_file string",
    "attributes": "path string, name string, dtype string, dims array<bigint>, value string, error string",
    "named_types": "path string, address bigint, dtype string, size int, signed boolean, big_endian boolean, members array<struct<name:string,offset:int,dtype:string,size:int>>, names map<string,bigint>",
}


@dataclass
class Part(InputPartition):
    lo: tuple[int, ...]
    hi: tuple[int, ...]
    chunks: tuple[Chunk, ...] | None = None

    def __init__(self, lo, hi, chunks=None):
        super().__init__((lo, hi))
        self.lo, self.hi, self.chunks = tuple(lo), tuple(hi), None if chunks is None else tuple(chunks)


class H5ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "h5array"

    def _reader(self) -> Reader:
        return Reader(opener(self.options["path"]), self.options.get("verify", "true") == "true")

    def _compat(self) -> bool:
        return self.options.get("compat", "false") == "true"

    def schema(self) -> T.StructType | str:
        table = self.options.get("table")
        if table:
            return TABLES[table]
        r = self._reader()
        d = self._dataset(r)
        return array_schema(d, self.options.get("form", "long"), self._compat())

    def _dataset(self, r: Reader) -> Dataset:
        d, fields = r.dataset(r.find(self.options["dataset"])), self.options.get("fields")
        if not fields:
            return d
        wanted, have = fields.split(","), [m[0] for m in d.type.members]
        if not have or not set(wanted) <= set(have):
            raise ValueError(f"the members are {have}, not {wanted}")
        # The elements keep their size; members that are left out have no place in the numpy type.
        return replace(d, type=replace(d.type, members=tuple(m for m in d.type.members if m[0] in wanted)))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if self.options.get("table"):
            return CatalogReader(self.options["path"], self.options["table"], schema)
        r = self._reader()
        return ArrayReader(self.options["path"], self._dataset(r), self.options.get("form", "long"), self._compat(), schema, int(self.options.get("partition_bytes", TARGET_BYTES)), self.options.get("bounds"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(dict(self.options), schema, overwrite)


def array_schema(d: Dataset, form: str, compat: bool) -> T.StructType:
    value, n = spark_type(d.type, compat), len(d.space.dims)
    axes = [T.StructField(f"i{k}", T.LongType(), False) for k in range(n)]
    if form == "long":
        return T.StructType([*axes, T.StructField("value", value)])
    if form == "rows":
        if not n:
            raise ValueError("a scalar has no rows")
        return T.StructType([*axes[:-1], T.StructField("values", T.ArrayType(value))])
    if form == "chunks":
        if d.layout != "chunked":
            raise ValueError("the dataset is not chunked")
        longs = T.ArrayType(T.LongType())
        return T.StructType([T.StructField("chunk", longs), T.StructField("offset", longs), T.StructField("shape", longs), T.StructField("data", T.ArrayType(value))])
    raise ValueError(f"unknown form {form}")


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, d: Dataset, form: str, compat: bool, schema: T.StructType, target: int, bounds: str | None = None):
        self.path, self.d, self.form, self.compat, self.target = path, d, form, compat, target
        self.schema = schema
        self.lo, self.hi = [0] * len(d.space.dims), list(d.space.dims)
        if bounds:
            pairs = [x.split(":") for x in bounds.split(",")]
            if len(pairs) != len(self.lo):
                raise ValueError("bounds don't have the dataset's rank")
            self.lo = [max(0, int(a)) for a, _ in pairs]
            self.hi = [min(int(b), n) for (_, b), n in zip(pairs, self.hi, strict=True)]

    def partitions(self) -> list[Part]:
        d, lo, hi = self.d, self.lo, self.hi
        if any(a >= b for a, b in zip(lo, hi, strict=True)) or d.space.null:
            return []
        if not d.space.dims:
            return [Part((), ())]
        if d.layout != "chunked":
            row = max(1, safe_product([b - a for a, b in zip(lo[1:], hi[1:], strict=True)]) * d.type.size)
            step = max(1, self.target // row)
            return [Part((a, *lo[1:]), (min(a + step, hi[0]), *hi[1:])) for a in range(lo[0], hi[0], step)]
        chunks = Reader(opener(self.path)).chunks(d)
        size = safe_product(d.chunk_dims) * d.type.size
        if self.form == "chunks":
            step = max(1, self.target // size)
            chunks = [c for c in chunks if all(k * s < b and (k + 1) * s > a for k, s, a, b in zip(c.coords, d.chunk_dims, lo, hi, strict=True))]
            return [Part(lo, hi, chunks[k : k + step]) for k in range(0, len(chunks), step)]
        # Bands of whole chunk rows of the first dimension, with the chunks that the bounds meet: missing ones are filled.
        inside = [c for c in chunks if all(k * s < b and (k + 1) * s > a for k, s, a, b in zip(c.coords, d.chunk_dims, lo, hi, strict=True))]
        rows: dict[int, list[Chunk]] = {}
        for c in inside:
            rows.setdefault(c.coords[0], []).append(c)
        across = safe_product([-(-(b - a) // s) + 1 for a, b, s in zip(lo[1:], hi[1:], d.chunk_dims[1:], strict=True)])
        band = max(1, self.target // (size * across))
        first, last = lo[0] // d.chunk_dims[0], (hi[0] - 1) // d.chunk_dims[0]
        out = []
        for k in range(first, last + 1, band):
            a, b = max(lo[0], k * d.chunk_dims[0]), min(hi[0], (k + band) * d.chunk_dims[0])
            out.append(Part((a, *lo[1:]), (b, *hi[1:]), [c for j in range(k, k + band) for c in rows.get(j, [])]))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        r, d = Reader(opener(self.path)), self.d
        values = r.values(self.compat)
        schema = to_arrow_schema(self.schema)
        item = numpy_type(d.type).shape
        if self.form == "chunks":
            for c in part.chunks:
                offset = [k * s for k, s in zip(c.coords, d.chunk_dims, strict=True)]
                shape = [min(s, n - o) for s, n, o in zip(d.chunk_dims, d.space.dims, offset, strict=True)]
                box = r.chunk_array(d, c)[tuple(slice(0, n) for n in shape)]
                data = values.of(d.type, np.ascontiguousarray(box).reshape(-1, *item))
                row = [pa.array([list(c.coords)], schema.field(0).type), pa.array([offset], schema.field(1).type), pa.array([shape], schema.field(2).type), pa.array([data.tolist() if isinstance(data, np.ndarray) else data], schema.field(3).type)]
                yield pa.RecordBatch.from_arrays(row, schema=schema)
            return
        step = max(1, (1 << 17) // max(1, safe_product([b - a for a, b in zip(part.lo[1:], part.hi[1:], strict=True)])))
        edges = range(part.lo[0], part.hi[0], step) if part.lo else [None]
        whole = r.box(d, part.lo, part.hi, list(part.chunks) if part.chunks is not None else None)
        for a in edges:
            box = whole if a is None else whole[a - part.lo[0] : a - part.lo[0] + step]
            dims = box.shape[: len(d.space.dims)]
            flat = values.of(d.type, np.ascontiguousarray(box).reshape(-1, *item))
            value = pa.array(flat, schema.field("value").type) if self.form == "long" else pa.array(flat, schema.field("values").type.value_type)
            lo = part.lo if a is None else (a, *part.lo[1:])
            if self.form == "rows":
                grid = np.indices(dims[:-1]).reshape(len(dims) - 1, -1) if len(dims) > 1 else np.zeros((0, 1), dtype=np.int64)
                offsets = pa.array(np.arange(grid.shape[1] + 1, dtype=np.int32) * dims[-1])
                cols = [pa.array(g + o) for g, o in zip(grid, lo, strict=False)] + [pa.ListArray.from_arrays(offsets, value)]
            else:
                grid = np.indices(dims).reshape(len(dims), -1)
                cols = [pa.array(g + o) for g, o in zip(grid, lo, strict=True)] + [value]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class CatalogReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema

    def read(self, partition) -> Iterator[tuple]:
        r = Reader(opener(self.path))
        if self.table == "superblock":
            yield r.version, r.offsets, r.lengths, r.base, r.end, r.root
        elif self.table == "links":
            for path, link, _ in r.walk():
                yield path, path.rpartition("/")[0] or "/", link.name, link.kind, link.address, link.path, link.file
        elif self.table == "named_types":
            for path, _, header in r.walk():
                if header is not None and header.kind == "datatype":
                    t, _ = parse_type(r.message(header, 3))
                    members = [{"name": n, "offset": at, "dtype": m.label, "size": m.size} for n, at, m in t.members]
                    yield path, header.address, t.label, t.size, bool(t.signed), bool(t.big), members, {str(k): int(v) for k, v in dict(t.names).items()}
        elif self.table == "objects":
            yield self._object(r, "/", r.header(r.root))
            for path, _, header in r.walk():
                if header is not None:
                    yield self._object(r, path, header)
        else:
            yield from self._attributes(r, "/", r.header(r.root))
            for path, _, header in r.walk():
                if header is not None:
                    yield from self._attributes(r, path, header)

    @staticmethod
    def _object(r: Reader, path: str, header) -> tuple:
        kind = header.kind
        if kind != "dataset":
            return path, kind, header.address, None, None, None, None, None, None, None, None
        try:
            d = r.dataset(header)
        except ValueError as e:
            return path, kind, header.address, None, None, None, None, None, None, None, str(e)
        dims = list(d.space.dims)
        shape = f"{len(dims)}D array [{' x '.join(map(str, dims))}]" if dims else "scalar"
        info = f"Dataset: {d.type.label} (size={d.type.size} bytes), {shape}"
        return path, kind, header.address, d.type.label, dims, list(d.space.max_dims), d.layout, list(d.chunk_dims) or None, [f for f, _ in d.filters], info, None

    @staticmethod
    def _attributes(r: Reader, path: str, header) -> Iterator[tuple]:
        for a in r.attributes(header):
            if a.error:
                yield path, a.name, None, None, None, a.error
                continue
            try:
                value, error = json.dumps(r.attribute_value(a), default=str), None
            except ValueError as e:
                value, error = None, str(e)
            yield path, a.name, a.type.label, list(a.space.dims), value, error


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    heap: str | None = None


#: An element of a sequence: how many values, the address of the heap collection (in a part file: of the part's own), the object's number.
ELEMENT = np.dtype([("n", "<u4"), ("at", "<u8"), ("k", "<u4")])
#: Rows after which mapped pages are given back.
MAPPED_ROWS = 1 << 14


def type_for(t: T.DataType) -> H5Type:
    """The type that values of a Spark type are written as."""
    numbers = {T.ByteType: integer(8), T.ShortType: integer(16), T.IntegerType: integer(32), T.LongType: integer(64), T.FloatType: floating("float32"), T.DoubleType: floating("float64"), T.BooleanType: integer(8)}
    if type(t) in numbers:
        return numbers[type(t)]
    if isinstance(t, T.StringType):
        return VLEN_STRING
    if isinstance(t, T.BinaryType):
        return vlen(integer(8, signed=False))
    if isinstance(t, T.ArrayType):
        return vlen(type_for(t.elementType))
    if isinstance(t, T.StructType):
        return compound({f.name: type_for(f.dataType) for f in t.fields})
    raise ValueError(f"values of {t.simpleString()} can't be written")


def empty_value(t: H5Type):
    """What an element without a row is: zero, the empty string or sequence, members of these."""
    if t.members:
        return {n: empty_value(m) for n, _, m in t.members}
    if t == VLEN_STRING or t.text:
        return ""
    return 0 if t.kind in (FIXED, FLOAT, ENUM) else [] if t.base is not None else b"\0" * t.size


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.dataset, self.overwrite = options["path"].removeprefix("file:"), options["dataset"], overwrite
        self.dims = [int(x) for x in options["dims"].split(",")]
        self.schema = schema
        names, self.whole_chunks = [f.name for f in schema.fields], options.get("form") == "chunks"
        if self.whole_chunks and (names != ["chunk", "data"] or not options.get("chunks") or not options.get("dtype")):
            raise ValueError("whole chunks have columns chunk and data, and options chunks and dtype")
        if not self.whole_chunks and names != [f"i{k}" for k in range(len(self.dims))] + ["value"]:
            raise ValueError(f"columns i0 … i{len(self.dims) - 1} and value are asked for, not {names}")
        if options.get("enum"):
            codes = {n: int(v) for n, _, v in (x.partition("=") for x in options["enum"].split(","))}
            self.type = enum_of(type_of(options.get("dtype", "int32")), codes)
        else:
            self.type = type_of(options["dtype"]) if options.get("dtype") else type_for(schema["value"].dataType)
        self.is_number = not self.whole_chunks and self.type.kind in (FIXED, FLOAT) and numpy_type(self.type).kind in "iuf" and not isinstance(schema["value"].dataType, (T.StringType, T.StructType, T.ArrayType, T.BinaryType, T.DecimalType))
        self.is_heaped = not self.whole_chunks and self.type.kind == VLEN and not (self.type.base and refers(self.type.base))
        self.chunks = [int(x) for x in options["chunks"].split(",")] if options.get("chunks") else None
        self.filters = filter_list(self.type.size, int(options["gzip"]) if options.get("gzip") else None, options.get("shuffle") == "true", options.get("fletcher32") == "true")
        if not overwrite and os.path.exists(self.path):
            r = Reader(opener(self.path))
            try:
                r.find(self.dataset)
            except (KeyError, ValueError):
                pass
            else:
                raise FileExistsError(f"{self.dataset} in {self.path}")
        self.staging = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One Arrow file of (place, value) for a task, a batch at a time."""
        file, rows, out = f"{self.staging}/{uuid.uuid4().hex}.arrow", 0, None
        heap = None
        for b in batches:
            if self.whole_chunks:
                part = pa.RecordBatch.from_arrays(b.columns, names=["chunk", "data"])
                if out is None:
                    out, sink = self._open(file, part.schema)
                sink.write_batch(part)
                rows += b.num_rows
                continue
            coords = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(self.dims))]
            for c, d in zip(coords, self.dims, strict=True):
                if len(c) and (c.min() < 0 or c.max() >= d):
                    raise ValueError("a coordinate is outside the array")
            place = sum((c * s for c, s in zip(coords, strides(self.dims), strict=True)), np.zeros(b.num_rows, np.int64))
            value = b.column(len(self.dims))
            if self.is_heaped:
                if heap is None:
                    os.makedirs(self.staging, exist_ok=True)
                    heap = Collections(open(f"{file}.heap", "wb"))
                value = self._heaped(value, heap)
            part = pa.RecordBatch.from_arrays([pa.array(place), value], names=["at", "value"])
            if out is None:
                out, sink = self._open(file, part.schema)
            sink.write_batch(part)
            rows += b.num_rows
        if out is None:
            return Written(None, 0)
        sink.close()
        out.close()
        if heap is not None:
            heap.close()
        return Written(file, rows, heap and f"{file}.heap")

    def _heaped(self, column: pa.Array, heap: Collections) -> pa.Array:
        """The elements of sequences or strings, whose values are put into a heap; nulls are empty."""
        base, flat = self.type.base, None
        if isinstance(column, pa.ListArray) and base.kind in (FIXED, FLOAT) and numpy_type(base).kind in "iuf" and not column.values.null_count and pa.types.is_primitive(column.values.type) and not pa.types.is_boolean(column.values.type):
            values = column.values.to_numpy(zero_copy_only=False)
            flat = memoryview(values.astype(numpy_type(base)).tobytes()) if values.dtype.kind in "iuf" else None
        elements = np.zeros(len(column), ELEMENT)
        if flat is not None:
            ends = column.offsets.to_numpy().tolist()
            known = column.is_valid().to_pylist()
            found = [(b - a, *heap.put(flat[a * base.size : b * base.size])) if ok and b > a else (0, 0, 0) for a, b, ok in zip(ends, ends[1:], known, strict=False)]
        else:
            parts = [sequence_bytes(self.type, v) if v is not None else (0, b"") for v in column.to_pylist()]
            found = [(n, *heap.put(data)) if n else (0, 0, 0) for n, data in parts]
        elements[:] = found
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(ELEMENT.itemsize), len(column), [None, pa.py_buffer(elements.tobytes())])

    def _open(self, file: str, schema: pa.Schema):
        os.makedirs(self.staging, exist_ok=True)
        out = pa.OSFile(file, "wb")
        return out, pa.ipc.new_file(out, schema)

    def _parts(self, messages: list[Written]) -> Iterator[pa.RecordBatch]:
        for m in messages:
            if m is not None and m.file:
                with pa.memory_map(m.file) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    def _elements(self, messages: list[Written], w: Writer) -> np.memmap:
        """The elements of sequences, in a mapped file, after the parts' heaps have been placed in the new one."""
        if any(d < 1 for d in self.dims):
            raise ValueError("sizes must be positive")
        raw = np.memmap(f"{self.staging}/raw", dtype=ELEMENT, mode="w+", shape=(safe_product(self.dims),))
        seen = 0
        for m in messages:
            if m is None or not m.file:
                continue
            base = w.append_file(m.heap)
            for b in self._parts([m]):
                part = np.frombuffer(b.column(1).buffers()[1], ELEMENT, len(b), b.column(1).offset * ELEMENT.itemsize).copy()
                part["at"][part["n"] > 0] += np.uint64(base)
                raw[b.column(0).to_numpy()] = part
                seen += len(b)
                if seen >= MAPPED_ROWS:
                    raw._mmap.madvise(mmap.MADV_DONTNEED)
                    seen = 0
        raw.flush()
        raw._mmap.madvise(mmap.MADV_DONTNEED)
        return raw

    def _values(self, messages: list[Written]):
        if self.is_number:
            raw = np.memmap(f"{self.staging}/raw", dtype=numpy_type(self.type), mode="w+", shape=tuple(self.dims))
            for b in self._parts(messages):
                raw.reshape(-1)[b.column(0).to_numpy()] = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            return raw
        values = [empty_value(self.type)] * safe_product(self.dims)
        for b in self._parts(messages):
            for at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if v is not None:
                    values[at] = filled(v, self.type)
        return values

    def commit(self, messages: list[Written]) -> None:
        os.makedirs(self.staging, exist_ok=True)
        made = f"{self.staging}/file"
        with Writer.revise(self.path, made) if not self.overwrite and os.path.exists(self.path) else Writer(made) as w:
            parts = self.dataset.strip("/").split("/")
            for k in range(1, len(parts)):
                if (group := "/" + "/".join(parts[:k])) not in w.nodes:
                    w.group(group)
            path, limits = "/" + "/".join(parts), [None] * len(self.dims) if self.chunks else None
            if self.whole_chunks:
                node = w.layout(path, self.type, self.dims, self.chunks, self.filters, limits)
                for b in self._parts(messages):
                    for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                        raw = data.as_buffer()
                        node["index"].append((tuple(k * c for k, c in zip(at, self.chunks, strict=True)), raw.size, w.append(raw)))
            elif self.is_heaped:
                raw = self._elements(messages, w)
                out = w.layout(path, self.type, self.dims, self.chunks, self.filters, limits)
                if self.chunks:
                    whole = raw.view(f"V{ELEMENT.itemsize}").reshape(self.dims)
                    for k in np.ndindex(*chunk_counts(self.dims, self.chunks)):
                        w.chunk(path, k, whole[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, self.chunks, strict=True))])
                else:
                    out["address"], out["nbytes"] = w.append_file(f"{self.staging}/raw"), raw.nbytes
            else:
                w.dataset(path, self._values(messages), self.type, dims=self.dims, chunks=self.chunks, filters=self.filters, max_dims=limits)
        os.replace(made, self.path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def filled(value, t: H5Type):
    """A value with what its null members are written as."""
    if t.members:
        return {n: empty_value(m) if value[n] is None else filled(value[n], m) for n, _, m in t.members}
    return value


def write_chunks(df: DataFrame, path: str, dataset: str, dims: list[int], chunks: list[int], dtype: str, mode: str = "overwrite", gzip: int | None = None, shuffle: bool = False, fletcher32: bool = False) -> None:
    """Write numbers (i0, i1, …, value) in chunks: rows meet by chunk, and each task encodes its chunks whole. Chunks without a row are not written."""
    register(df.sparkSession)
    kind, n = type_of(dtype), len(dims)
    filters, order = filter_list(kind.size, gzip, shuffle, fletcher32), numpy_type(kind)
    inner = strides(chunks)
    place = F.lit(0).cast("long")
    for k in range(n):
        place = place + (F.col(f"i{k}") % chunks[k]) * inner[k]
    names = [f"c{k}" for k in range(n)]
    met = with_chunks(df, chunks).groupBy(*names).agg(F.collect_list(F.struct(place.alias("at"), F.col("value").alias("v"))).alias("x"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                x = b.column(1)[row].values
                whole = np.zeros(safe_product(chunks), dtype=order)
                whole[x.field("at").to_numpy()] = x.field("v").fill_null(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), pa.array([encode(whole.tobytes(), filters)], pa.binary())], names=["chunk", "data"])

    rows = met.select(F.array(*[F.col(c).cast("long") for c in names]).alias("chunk"), "x").mapInArrow(encoded, "chunk array<bigint>, data binary")
    options = {"dataset": dataset, "dims": ",".join(map(str, dims)), "chunks": ",".join(map(str, chunks)), "dtype": dtype, "form": "chunks", "shuffle": str(shuffle).lower(), "fletcher32": str(fletcher32).lower()}
    rows.write.format("h5array").options(**options, **({"gzip": str(gzip)} if gzip else {})).mode(mode).save(path)


def register(spark) -> None:
    spark.dataSource.register(H5ArraySource)


def scan(spark, path: str, dataset: str, selection: Hyperslab | None = None, index: str | None = "out_idx", **options: str) -> DataFrame:
    """An array in coordinate form, or a checked selection of it: only chunks and byte ranges within its bounds are read, the strides are a predicate."""
    register(spark)
    reader = spark.read.format("h5array").options(path=path, dataset=dataset, **options)
    if selection is None:
        return reader.load()
    r = Reader(opener(path))
    dims = r.dataset(r.find(dataset)).space.dims
    selection.checked(dims)
    ends = [s + (c - 1) * t + b for s, c, t, b in zip(selection.start, selection.count, selection.stride, selection.block, strict=True)]
    bounds = ",".join(f"{s}:{e}" for s, e in zip(selection.start, ends, strict=True))
    return hyperslab(reader.option("bounds", bounds).load(), selection, dims, index)


class ChunkIterator:
    """Rows of allocated chunks one after another, in the order of their coordinates.

    progress(done, total) is called after each; ``reset`` starts anew, ``cancel`` ends it: no more chunks are read.
    """

    def __init__(self, spark, path: str, dataset: str, progress=None):
        register(spark)
        r = Reader(opener(path))
        self.total, self.progress = len(r.chunks(r.dataset(r.find(dataset)))), progress
        self.rows = spark.read.format("h5array").options(path=path, dataset=dataset, form="chunks").load()
        self.cancelled = False
        self.reset()

    def reset(self) -> None:
        if self.cancelled:
            raise RuntimeError("the iteration was cancelled")
        self.done, self.at = 0, self.rows.toLocalIterator()

    def cancel(self) -> None:
        self.cancelled, self.at = True, iter(())

    def __iter__(self) -> ChunkIterator:
        return self

    def __next__(self):
        row = next(self.at)
        self.done += 1
        if self.progress:
            self.progress(self.done, self.total)
        return row


def chunk_iterator(spark, path: str, dataset: str, progress=None) -> ChunkIterator:
    return ChunkIterator(spark, path, dataset, progress)


def write_catalog(spark, path: str, links: DataFrame | None = None, attributes: DataFrame | None = None, deleted: DataFrame | None = None, superblock: int = 2) -> None:
    """Change a file's tree: delete links (path) and attributes (path, name), add links and groups, put attributes in or in place of others.

    links: path, link_type (group, hard, soft, external), target_path, target_file. attributes: path, name, value. deleted: path, and
    name where an attribute is meant. The file is revised by a copy, which then replaces it; rows are read one after another, sorted by path.
    """
    made = f"{path}.{uuid.uuid4().hex}"
    with Writer.revise(path, made, superblock) if os.path.exists(path) else Writer(made, superblock=superblock) as w:
        if deleted is not None:
            has_name = "name" in deleted.columns
            for row in deleted.orderBy("path", ascending=False).toLocalIterator():
                if has_name and row["name"] is not None:
                    w.delete_attribute(row["path"], row["name"])
                else:
                    w.delete(row["path"])
        if links is not None:
            for row in links.orderBy("path").toLocalIterator():
                if row["link_type"] == "group":
                    w.group(row["path"])
                elif row["link_type"] == "hard":
                    w.hard_link(row["path"], row["target_path"])
                elif row["link_type"] == "soft":
                    w.soft_link(row["path"], row["target_path"])
                else:
                    w.external_link(row["path"], row["target_file"], row["target_path"])
        if attributes is not None:
            for row in attributes.orderBy("path", "name").toLocalIterator():
                w.attribute(row["path"], row["name"], row["value"])
    os.replace(made, path)


def regions(spark, path: str, dataset: str) -> DataFrame:
    """The blocks that region references stand for: the reference's coordinates (i0, …), the path of its dataset, and each block's first and last element."""
    refs = scan(spark, path, dataset)
    objects = spark.read.format("h5array").options(path=path, table="objects").load().select("path", "address")
    axes = [c for c in refs.columns if c != "value"]
    out = T.StructType([*[refs.schema[c] for c in axes], T.StructField("address", T.LongType()), T.StructField("lo", T.ArrayType(T.LongType())), T.StructField("hi", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(opener(path))
        for b in batches:
            rows = [(*place, address, list(lo), list(hi)) for *place, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) for address, blocks in [r.region(raw)] for lo, hi in blocks]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), to_arrow_schema(out), strict=True)], schema=to_arrow_schema(out))

    return refs.mapInArrow(read, out).join(objects, "address", "left").select(*axes, "path", "lo", "hi")
