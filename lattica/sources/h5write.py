"""Writing the array file format: one pass that appends raw data, then headers, then the superblock.

Few links and attributes are messages of a version 2 header, many stand in a heap with an index; old files have
tables of names instead. Datasets are contiguous or chunked with a version 1 chunk index, variable-length values go
to heap collections. Edge chunks are stored whole, padded.
"""

from __future__ import annotations

import shutil
import struct
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from lattica.functions.codecs import DEFLATE, FLETCHER32, LZF, NAMES, SHUFFLE, decode, encode, lookup3
from lattica.functions.shapes import LIMIT_CHUNK_BYTES, LIMIT_STRING_BYTES, chunk_counts, safe_product

from .h5index import ATTRIBUTES_BY_NAME, LEAF_ENTRIES, LINKS_BY_NAME, NODE_CHILDREN, write_names, write_table
from .h5read import SIGNATURE, UNDEFINED, Reader, opener
from .h5types import ARRAY, COMPOUND, ENUM, FIXED, FLOAT, OPAQUE, REFERENCE, STRING, VLEN, VLEN_STRING, FormatError, H5Type, encode_type, floating, integer, numpy_type, parse_type

CHUNK_NODE = 64  # chunks in a node of their index


def filter_list(size: int, gzip: int | None = None, shuffle: bool = False, fletcher32: bool = False, lzf: bool = False) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """The pipeline of options: shuffle always first, the checksum last."""
    out: list[tuple[int, tuple[int, ...]]] = []
    if shuffle:
        out.append((SHUFFLE, (size,)))
    if gzip is not None:
        if not 1 <= gzip <= 9:
            raise ValueError("gzip levels are 1 to 9")
        out.append((DEFLATE, (gzip,)))
    if lzf:
        out.append((LZF, (4, 261, size)))
    if fletcher32:
        out.append((FLETCHER32, ()))
    return tuple(out)


def infer_type(value) -> tuple[H5Type, tuple[int, ...], list]:
    """Type, shape and flat values of an attribute's Python value."""
    if isinstance(value, np.ndarray) or np.isscalar(value) and not isinstance(value, (str, bytes)):
        a = np.asarray(value)
        if a.dtype.kind == "b":
            a = a.astype(np.int8)
        if a.dtype.kind in "iu":
            return integer(8 * a.dtype.itemsize, a.dtype.kind == "i"), a.shape, a.reshape(-1)
        if a.dtype.kind == "f":
            return floating(f"float{8 * a.dtype.itemsize}"), a.shape, a.reshape(-1)
        if a.dtype.kind in "US":
            return infer_type(a.tolist())
        raise ValueError(f"no type for {a.dtype}")
    if isinstance(value, str):
        n = max(1, len(value.encode()))
        return H5Type(STRING, n, padding=1, utf8=True), (), [value]
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError("an empty list has no type")
        if all(isinstance(v, str) for v in value):
            return VLEN_STRING, (len(value),), list(value)
        return infer_type(np.array(value))
    raise ValueError(f"no type for {type(value).__name__}")


def refers(t: H5Type) -> bool:
    """Whether values of a type point into a heap."""
    return t.kind == VLEN or t.base is not None and refers(t.base) or any(refers(m) for _, _, m in t.members)


def sequence_bytes(t: H5Type, value) -> tuple[int, bytes]:
    """The length and the bytes of a sequence or string whose values refer to no heap."""
    data = value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, (bytes, bytearray)) else object.__new__(Writer).encode(t.base, np.asarray(value))
    if t.text and len(data) > LIMIT_STRING_BYTES:
        raise ValueError("a string is too long")
    return len(data) // (1 if t.text else t.base.size), data


class Collections:
    """Heap collections that are written whole, one after the other: of 4 KiB, or of one larger object. Addresses are those in its own file."""

    def __init__(self, file):
        self.file, self.at, self.size, self.count, self.used, self.parts = file, 0, 0, 0, 0, []

    def put(self, data) -> tuple[int, int]:
        n = len(data)
        room = 16 + -(-n // 8) * 8
        if self.used + room + 16 > self.size:
            self._end()
            self.size, self.count, self.used = max(4096, 16 + room + 16), 0, 16
        self.count += 1
        self.used += room
        self.parts += (struct.pack("<HHIQ", self.count, 1, 0, n), data, b"\0" * (room - 16 - n))
        return self.at, self.count

    def _end(self) -> None:
        if self.size:
            left = struct.pack("<HHIQ", 0, 0, 0, self.size - self.used)  # what is left, as object zero
            self.file.write(b"GCOL\x01\0\0\0" + struct.pack("<Q", self.size) + b"".join(self.parts) + left.ljust(self.size - self.used, b"\0"))
            self.at, self.size, self.used, self.parts = self.at + self.size, 0, 0, []

    def close(self) -> None:
        self._end()
        self.file.close()


@dataclass
class _Collection:
    at: int
    size: int
    used: int = 16
    count: int = 0


class Writer:
    """A file under construction; ``close`` writes the headers. mode: "w" replaces, "x" must not exist.

    Groups and objects of more than ``compact`` links or attributes have these in a heap with an index by hash; fewer stand in the
    header. Superblock 0 makes an old file: headers of the first version, groups with tables of names, all attributes in the header.
    """

    def __init__(self, path: str, mode: str = "w", superblock: int = 2, compact: int = 8):
        if superblock not in (0, 2, 3):
            raise ValueError("superblock versions 0, 2 and 3 can be written")
        self.file, self.version, self.compact = open(path, mode + "b"), superblock, compact
        self.file.write(b"\0" * 96)
        self.nodes: dict[str, dict] = {"/": {"kind": "group", "attrs": {}, "links": {}}}
        self.heap: _Collection | None = None

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close() if kind is None else self.file.close()

    @classmethod
    def revise(cls, source: str, target: str, superblock: int = 2, compact: int = 8) -> Writer:
        """A writer of a new file that starts as a copy of another: files are never changed in place.

        Raw chunks are copied as they are; values that refer to a heap are read and written anew.
        """
        r, w = Reader(opener(source)), cls(target, superblock=superblock, compact=compact)
        paths = {r.root: "/"}
        w._copy_attributes(r, "/", r.header(r.root))
        for path, link, header in r.walk():
            if header is None:
                w.soft_link(path, link.path) if link.kind == "soft" else w.external_link(path, link.file, link.path)
            elif header.address in paths:
                parent, name = w._place(path)
                parent["links"][name] = ("hard", paths[header.address])
            else:
                paths[header.address] = path
                w._copy(r, path, header)
        return w

    def _copy_attributes(self, r: Reader, path: str, header) -> None:
        for a in r.attributes(header):
            if a.type is None:
                raise FormatError(f"an attribute of {path} can't be read: {a.error}")
            raw = a.raw
            if refers(a.type):
                value = r.attribute_value(a)
                raw = self.encode(a.type, value if isinstance(value, list) else [value])
            self.nodes[path]["attrs"][a.name] = (a.type, a.space.dims, raw)

    def _copy(self, r: Reader, path: str, header) -> None:
        if header.kind == "datatype":
            self.named_type(path, parse_type(r.message(header, 3))[0])
        elif header.kind == "dataset":
            d = r.dataset(header)
            limits = d.space.max_dims if d.space.max_dims != d.space.dims else None
            chunked = d.layout == "chunked"
            out = self.layout(path, d.type, d.space.dims, d.chunk_dims if chunked else None, d.filters if chunked else (), limits if chunked else None, d.fill)
            if refers(d.type):
                values = lambda x: r.values().of(d.type, np.ascontiguousarray(x).reshape(-1, *numpy_type(d.type).shape))
                for c in r.chunks(d) if chunked else ():
                    self.chunk(path, c.coords, np.frombuffer(self.encode(d.type, values(r.chunk_array(d, c))), dtype=f"V{d.type.size}").reshape(d.chunk_dims))
                if not chunked:
                    data = self.encode(d.type, values(r.box(d, (0,) * len(d.space.dims), d.space.dims)))
                    out["address"], out["nbytes"] = self.append(data), len(data)
            elif chunked:
                for c in r.chunks(d):
                    raw = r.read(c.address, c.nbytes)
                    if c.mask:
                        self.chunk(path, c.coords, np.frombuffer(decode(raw, d.filters, c.mask), dtype=f"V{d.type.size}").reshape(d.chunk_dims))
                    else:
                        out["index"].append((tuple(k * n for k, n in zip(c.coords, d.chunk_dims, strict=True)), c.nbytes, self.append(raw)))
            else:
                data = d.data if d.layout == "compact" else r.read(d.address, d.nbytes) if d.address != UNDEFINED else b"\0" * (d.space.size * d.type.size)
                out["address"], out["nbytes"] = self.append(data), len(data)
        else:
            self.group(path)
        self._copy_attributes(r, path, header)

    def append(self, data: bytes) -> int:
        self.file.seek(0, 2)
        at = self.file.tell()
        if at % 8:
            self.file.write(b"\0" * (8 - at % 8))
            at += 8 - at % 8
        self.file.write(data)
        return at

    def append_file(self, path: str) -> int:
        """The bytes of another file, a piece at a time."""
        at = self.append(b"")
        with open(path, "rb") as f:
            shutil.copyfileobj(f, self.file, 1 << 22)
        return at

    # Objects

    def _place(self, path: str) -> tuple[dict, str]:
        if not path.startswith("/") or path == "/" or path.endswith("/") or "//" in path:
            raise ValueError(f"not an object path: {path}")
        parent, _, name = path.rpartition("/")
        node = self.nodes.get(parent or "/")
        if node is None or node["kind"] != "group":
            raise KeyError(f"no such group: {parent or '/'}")
        if name in node["links"]:
            raise ValueError(f"{path} exists")
        return node, name

    def _new(self, path: str, node: dict) -> dict:
        parent, name = self._place(path)
        parent["links"][name] = ("hard", path)
        self.nodes[path] = node | {"attrs": {}}
        return self.nodes[path]

    def group(self, path: str) -> None:
        self._new(path, {"kind": "group", "links": {}})

    def hard_link(self, path: str, target: str) -> None:
        if target not in self.nodes:
            raise KeyError(f"no such object: {target}")
        parent, name = self._place(path)
        parent["links"][name] = ("hard", target)

    def soft_link(self, path: str, target: str) -> None:
        if not target or len(target.encode()) > 65_535:
            raise ValueError("a soft link's target has 1 to 65,535 bytes")
        parent, name = self._place(path)
        parent["links"][name] = ("soft", target)

    def external_link(self, path: str, file: str, target: str) -> None:
        if not self.version:
            raise ValueError("an old file has no external links")
        if not file or ".." in file.replace("\\", "/").split("/"):
            raise ValueError(f"not a file name for an external link: {file}")
        parent, name = self._place(path)
        parent["links"][name] = ("external", file, target)

    def named_type(self, path: str, t: H5Type) -> None:
        self._new(path, {"kind": "datatype", "type": t})

    def attribute(self, path: str, name: str, value) -> None:
        """Create or replace."""
        if path not in self.nodes:
            raise KeyError(f"no such object: {path}")
        t, dims, flat = infer_type(value)
        self.nodes[path]["attrs"][name] = (t, dims, self.encode(t, flat))

    def delete_attribute(self, path: str, name: str) -> None:
        del self.nodes[path]["attrs"][name]

    def delete(self, path: str) -> None:
        """Unlink; groups must be empty."""
        parent, _, name = path.rpartition("/")
        links = self.nodes.get(parent or "/", {}).get("links", {})
        if name not in links:
            raise KeyError(f"no such object: {path}")
        kind, target = links[name][:2]
        if kind == "hard" and self.nodes[target].get("links") and self._references(target) == 1:
            raise ValueError(f"{path} is not empty")
        del links[name]
        if kind == "hard" and not self._references(target):
            del self.nodes[target]

    def _references(self, path: str) -> int:
        return sum(x == ("hard", path) for n in self.nodes.values() for x in n.get("links", {}).values())

    # Datasets

    def dataset(self, path: str, values, t: H5Type, dims: Sequence[int] | None = None, chunks: Sequence[int] | None = None, filters: Sequence[tuple[int, Sequence[int]]] = (), max_dims: Sequence[int | None] | None = None, fill: bytes | None = None, skip: Iterable[tuple[int, ...]] = ()) -> None:
        """Values in row-major order (an array, or a list of Python values). skip: chunks that are not allocated."""
        dims = tuple(dims if dims is not None else np.shape(values))
        if any(d < 1 for d in dims):
            raise ValueError("sizes must be positive")
        data = self.encode(t, values)
        if len(data) != safe_product(dims) * t.size:
            raise ValueError(f"{len(data)} bytes for a shape of {safe_product(dims) * t.size}")
        array = np.frombuffer(data, dtype=f"V{t.size}").reshape(dims)
        out = self.layout(path, t, dims, chunks, filters, max_dims, fill)
        if not chunks:
            out["address"], out["nbytes"] = self.append(data), len(data)
            return
        leave = set(skip)
        for k in np.ndindex(*chunk_counts(dims, chunks)):
            if k not in leave:
                box = tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, chunks, strict=True))
                self.chunk(path, k, array[box])

    def layout(self, path: str, t: H5Type, dims: Sequence[int], chunks: Sequence[int] | None = None, filters: Sequence[tuple[int, Sequence[int]]] = (), max_dims: Sequence[int | None] | None = None, fill: bytes | None = None) -> dict:
        """A dataset whose data follows, by :meth:`chunk` or by setting its address."""
        if chunks is not None:
            if len(chunks) != len(dims) or any(c < 1 for c in chunks) or any(c > d for c, d, m in zip(chunks, dims, max_dims or dims, strict=True) if m is not None):
                raise ValueError("chunks must have the dataset's rank and be no larger than it")
            if safe_product(chunks) * t.size > LIMIT_CHUNK_BYTES:
                raise ValueError("a chunk is too large")
        elif filters or max_dims and tuple(max_dims) != tuple(dims):
            raise ValueError("only chunked datasets have filters or can be resized")
        for kind, _ in filters:
            if kind not in NAMES:
                raise ValueError(f"unknown filter {kind}")
        return self._new(path, {"kind": "dataset", "type": t, "dims": tuple(dims), "max_dims": tuple(max_dims) if max_dims else None, "chunks": tuple(chunks) if chunks else None, "filters": tuple((k, tuple(v)) for k, v in filters), "fill": fill, "index": [], "address": UNDEFINED, "nbytes": 0})

    def chunk(self, path: str, at: tuple[int, ...], part: np.ndarray) -> None:
        """One chunk (void elements), padded to its whole shape."""
        node = self.nodes[path]
        shape = node["chunks"]
        if part.shape != shape:
            whole = np.zeros(shape, dtype=part.dtype)
            whole[tuple(slice(0, n) for n in part.shape)] = part
            part = whole
        data = encode(np.ascontiguousarray(part).tobytes(), node["filters"])
        node["index"].append((tuple(k * c for k, c in zip(at, shape, strict=True)), len(data), self.append(data)))

    def resize(self, path: str, dims: Sequence[int]) -> None:
        node = self.nodes[path]
        limits = node.get("max_dims")
        if not node["chunks"] or not limits or len(dims) != len(limits) or any(d < 1 or m is not None and d > m for d, m in zip(dims, limits, strict=True)):
            raise ValueError("not a size that this dataset can have")
        node["index"] = [x for x in node["index"] if all(o < d for o, d in zip(x[0], dims, strict=True))]
        node["dims"] = tuple(dims)

    def raw(self, path: str, data: bytes) -> None:
        """The bytes of a contiguous dataset, as they are to stand in the file; they replace those that it has."""
        node = self.nodes[path]
        if node["kind"] != "dataset" or node["chunks"] or refers(node["type"]):
            raise ValueError(f"{path} is no contiguous dataset of plain values")
        if len(data) != safe_product(node["dims"]) * node["type"].size:
            raise ValueError(f"{len(data)} bytes for a shape of {safe_product(node['dims']) * node['type'].size}")
        node["address"], node["nbytes"] = self.append(data), len(data)

    def region_reference(self, address: int, blocks: Sequence[tuple[Sequence[int], Sequence[int]]]) -> bytes:
        """The value of a reference to blocks (first and last element) of the dataset whose header is at an address."""
        rank = len(blocks[0][0])
        numbers = [x for first, last in blocks for x in (*first, *last)]
        body = struct.pack(f"<II{len(numbers)}I", rank, len(blocks), *numbers)
        return struct.pack("<QI", *self._heap_put(struct.pack("<Q4I", address, 2, 1, 0, len(body)) + body))

    def put(self, at: int, data: bytes) -> None:
        self.file.seek(at)
        self.file.write(data)

    # Values

    def encode(self, t: H5Type, values) -> bytes:
        if isinstance(values, bytes):
            return values
        if isinstance(values, np.ndarray) and t.kind in (FIXED, FLOAT, ENUM) and numpy_type(t).kind in "iuf":
            if values.dtype.kind not in "iufb":
                raise ValueError(f"{values.dtype} for a {t.label}")
            return np.ascontiguousarray(values).astype(numpy_type(t)).tobytes()
        if t.kind in (FIXED, FLOAT, ENUM):
            codes = dict(t.names)
            return np.array([codes[v] if isinstance(v, str) else v for v in np.asarray(values, dtype=object).reshape(-1)]).astype(numpy_type(t)).tobytes()
        flat = values.reshape(-1).tolist() if isinstance(values, np.ndarray) and t.kind != ARRAY else list(values)
        if t.kind == STRING:
            pad = b" " if t.padding == 2 else b"\0"
            return b"".join((v if isinstance(v, bytes) else str(v).encode())[: t.size].ljust(t.size, pad) for v in flat)
        if t.kind in (OPAQUE, REFERENCE):
            out = b"".join(v.to_bytes(t.size, "little") if isinstance(v, int) else bytes(v) for v in flat)
            if len(out) != t.size * len(flat):
                raise ValueError(f"elements of {t.size} bytes are asked for")
            return out
        if t.kind == ARRAY:
            n = safe_product(t.dims)
            return b"".join(self.encode(t.base, np.asarray(v).reshape(-1)) if np.size(v) == n else self._wrong(n) for v in flat)
        if t.kind == COMPOUND:
            rows = []
            for v in flat:
                row = bytearray(t.size)
                for k, (name, at, m) in enumerate(t.members):
                    row[at : at + m.size] = self.encode(m, [v[name] if isinstance(v, dict) else v[k]])
                rows.append(bytes(row))
            return b"".join(rows)
        if t.kind == VLEN:
            return b"".join(self._vlen(t, v) for v in flat)
        raise FormatError(f"a {t.label} can't be written")

    @staticmethod
    def _wrong(n: int) -> bytes:
        raise ValueError(f"arrays of {n} elements are asked for")

    def _vlen(self, t: H5Type, value) -> bytes:
        data = value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, (bytes, bytearray)) else self.encode(t.base, np.asarray(value))
        if t.text and len(data) > LIMIT_STRING_BYTES:
            raise ValueError("a string is too long")
        n = len(data) // (1 if t.text else t.base.size)
        if not n:
            return struct.pack("<IQI", 0, 0, 0)
        return struct.pack("<IQI", n, *self._heap_put(data))

    def _heap_put(self, data: bytes) -> tuple[int, int]:
        """The collection and number of a heap object; a collection of 4 KiB takes small ones until it is full."""
        room = 16 + -(-len(data) // 8) * 8
        if self.heap is None or self.heap.used + room + 16 > self.heap.size or self.heap.count >= 65_000:
            size = max(4096, 16 + room + 16)
            self.heap = _Collection(self.append(b"GCOL\x01\0\0\0" + struct.pack("<Q", size) + b"\0" * (size - 16)), size)
        h = self.heap
        h.count += 1
        self.file.seek(h.at + h.used)
        self.file.write(struct.pack("<HHIQ", h.count, 1, 0, len(data)) + data)
        h.used += room
        self.file.seek(h.at + h.used)
        self.file.write(struct.pack("<HHIQ", 0, 0, 0, h.size - h.used))  # what is left, as object zero
        return h.at, h.count

    # Headers

    @staticmethod
    def _space(dims: Sequence[int], max_dims: Sequence[int | None] | None = None) -> bytes:
        out = bytes([2, len(dims), int(bool(max_dims)), 1 if dims else 0]) + struct.pack(f"<{len(dims)}Q", *dims)
        return out + struct.pack(f"<{len(dims)}Q", *(UNDEFINED if m is None else m for m in max_dims)) if max_dims else out

    def _attribute(self, name: str, t: H5Type, dims: tuple[int, ...], data: bytes) -> bytes:
        raw, kind, space = name.encode() + b"\0", encode_type(t), self._space(dims)
        return struct.pack("<BBHHHB", 3, 0, len(raw), len(kind), len(space), 1) + raw + kind + space + data

    def _header(self, messages: list[tuple[int, bytes]], references: int = 1) -> bytes:
        if any(len(data) > 65_528 for _, data in messages):
            raise ValueError("a header message is over 64 KiB")
        if not self.version:
            padded = [(kind, data.ljust(-(-len(data) // 8) * 8, b"\0")) for kind, data in messages]
            body = b"".join(struct.pack("<HHBxxx", kind, len(data), 0) + data for kind, data in padded)
            return struct.pack("<BxHII4x", 1, len(messages), max(1, references), len(body)) + body
        body = b"".join(struct.pack("<BHB", kind, len(data), 0) + data for kind, data in messages)
        out = b"OHDR\x02\x02" + struct.pack("<I", len(body)) + body
        return out + struct.pack("<I", lookup3(out))

    def _index(self, entries: list[tuple[tuple[int, ...], int, int]], rank: int, chunks: tuple[int, ...]) -> int:
        """The chunk index, leaves first; each level's nodes are linked to their neighbours."""
        entries = sorted(entries)
        if not entries:
            return UNDEFINED
        key = lambda offset, n: struct.pack(f"<II{rank + 1}Q", n, 0, *offset, 0)
        level, nodes = 0, [(o, n, a) for o, n, a in entries]
        while True:
            parts = [nodes[k : k + CHUNK_NODE] for k in range(0, len(nodes), CHUNK_NODE)]
            size = 24 + (CHUNK_NODE + 1) * (8 + 8 * (rank + 1)) + 8 * CHUNK_NODE
            first = self.append(b"\0" * (size * len(parts)))
            above = []
            for k, part in enumerate(parts):
                left = first + (k - 1) * size if k else UNDEFINED
                right = first + (k + 1) * size if k + 1 < len(parts) else UNDEFINED
                after = parts[k + 1][0][0] if k + 1 < len(parts) else tuple(o + c for o, c in zip(part[-1][0], chunks, strict=True))
                body = b"TREE" + struct.pack("<BBHQQ", 1, level, len(part), left, right)
                body += b"".join(key(o, n) + struct.pack("<Q", a) for o, n, a in part) + key(after, 0)
                self.file.seek(first + k * size)
                self.file.write(body)
                above.append((part[0][0], part[0][1], first + k * size))
            if len(above) == 1:
                return above[0][2]
            level, nodes = level + 1, above

    def close(self) -> None:
        references = Counter(x[1] for n in self.nodes.values() for x in n.get("links", {}).values() if x[0] == "hard")
        sizes = {p: len(self._header(self._messages(p, {}, {}, references[p]))) for p in self.nodes}
        for node in self.nodes.values():
            if node.get("chunks"):
                node["address"] = self._index(node["index"], len(node["dims"]), node["chunks"])
        places = {p: self.append(b"\0" * n) for p, n in sizes.items()}
        # Links name the places of headers, so heaps and tables come after these.
        indexes = {p: self._indexes(node, places) for p, node in self.nodes.items()}
        for p, at in places.items():
            self.put(at, self._header(self._messages(p, places, indexes, references[p]), references[p]))
        self.file.seek(0, 2)
        end = self.file.tell()
        if self.version:
            head = SIGNATURE + bytes([self.version, 8, 8, 0]) + struct.pack("<QQQQ", 0, UNDEFINED, end, places["/"])
            self.put(0, head + struct.pack("<I", lookup3(head)))
        else:
            root = struct.pack("<QQII", 0, places["/"], 1, 0) + struct.pack("<QQ", *indexes["/"]["table"])
            self.put(0, SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", LEAF_ENTRIES // 2, NODE_CHILDREN // 2, 0) + struct.pack("<QQQQ", 0, UNDEFINED, end, UNDEFINED) + root)
        self.file.close()

    def _indexes(self, node: dict, places: dict[str, int]) -> dict[str, tuple[int, int]]:
        """Where a node's indexes of links and attributes are, or its table of names."""
        out, links = {}, node.get("links")
        if links is not None and not self.version:
            out["table"] = write_table(self.append, self.put, {n: (places.get(x[1], 0), None) if x[0] == "hard" else (0, x[1]) for n, x in links.items()})
        elif links is not None and len(links) > self.compact:
            out["links"] = write_names(self.append, self.put, {n: self._link(n, x, places) for n, x in links.items()}, LINKS_BY_NAME)
        if self.version and len(node["attrs"]) > self.compact:
            out["attributes"] = write_names(self.append, self.put, {n: self._attribute(n, *x) for n, x in node["attrs"].items()}, ATTRIBUTES_BY_NAME)
        return out

    @staticmethod
    def _link(name: str, link: tuple, places: dict[str, int]) -> bytes:
        raw, kind = name.encode(), {"hard": 0, "soft": 1, "external": 64}[link[0]]
        head = bytes([1, 0x1A, kind, 1]) + struct.pack("<I", len(raw)) + raw
        if kind == 0:
            return head + struct.pack("<Q", places.get(link[1], 0))
        value = link[1].encode() if kind == 1 else b"\0" + link[1].encode() + b"\0" + link[2].encode() + b"\0"
        return head + struct.pack("<H", len(value)) + value

    def _messages(self, path: str, places: dict[str, int], indexes: dict[str, dict[str, tuple[int, int]]], references: int) -> list[tuple[int, bytes]]:
        node, out, found = self.nodes[path], [], indexes.get(path, {})
        nowhere = (UNDEFINED, UNDEFINED)
        if node["kind"] == "group" and not self.version:
            out.append((17, struct.pack("<QQ", *found.get("table", nowhere))))
        elif node["kind"] == "group":
            out += [(2, struct.pack("<BBQQ", 0, 0, *found.get("links", nowhere))), (10, b"\0\0")]
            if len(node["links"]) <= self.compact:
                out += [(6, self._link(n, x, places)) for n, x in sorted(node["links"].items(), key=lambda x: x[0].encode())]
        else:
            out.append((3, encode_type(node["type"])))
        if node["kind"] == "dataset":
            out.append((1, self._space(node["dims"], node["max_dims"])))
            fill = node["fill"]
            out.append((5, bytes([3, 0x2A]) + struct.pack("<I", len(fill)) + fill if fill is not None else bytes([3, 0x0A])))
            if node["chunks"]:
                rank = len(node["dims"])
                out.append((8, bytes([3, 2, rank + 1]) + struct.pack(f"<Q{rank + 1}I", node["address"], *node["chunks"], node["type"].size)))
            else:
                out.append((8, bytes([3, 1]) + struct.pack("<QQ", node["address"], node["nbytes"])))
            if node["filters"]:
                parts = b""
                for kind, values in node["filters"]:
                    name = NAMES[kind].encode() + b"\0" if kind >= 256 else b""
                    parts += struct.pack("<H", kind) + (struct.pack("<H", len(name)) if kind >= 256 else b"") + struct.pack("<HH", 0, len(values)) + name + struct.pack(f"<{len(values)}I", *values)
                out.append((11, bytes([2, len(node["filters"])]) + parts))
        if references > 1 and self.version:
            out.append((22, struct.pack("<BI", 0, references)))
        if self.version and len(node["attrs"]) > self.compact:
            out.append((21, struct.pack("<BBQQ", 0, 0, *found.get("attributes", nowhere))))
        else:
            out += [(12, self._attribute(n, *a)) for n, a in node["attrs"].items()]
        return out
