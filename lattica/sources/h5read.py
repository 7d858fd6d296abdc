"""Reading the array file format: superblock, headers, groups, heaps, indexes and raw data.

Everything works on ``read(at, n)``; a file is opened through pyarrow's file systems, so any store that those
reach will do. Metadata is read on the driver; executors get addresses and read raw data only.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from lattica.functions.codecs import decode, lookup3
from lattica.functions.shapes import LIMIT_ATTRIBUTE_BYTES, LIMIT_CHUNK_BYTES, chunk_counts, safe_product

from .h5types import FormatError, H5Type, Values, numpy_type, parse_type

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
DATASPACE, LINK_INFO, DATATYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO, REFCOUNT = 1, 2, 3, 4, 5, 6, 8, 11, 12, 16, 17, 21, 22
MESSAGE_NAMES = {DATASPACE: "dataspace", LINK_INFO: "link_info", DATATYPE: "datatype", FILL: "fill", LINK: "link", LAYOUT: "layout", FILTERS: "filters", ATTRIBUTE: "attribute", SYMBOL_TABLE: "symbol_table", ATTRIBUTE_INFO: "attribute_info", REFCOUNT: "refcount"}


def opener(path: str) -> Callable[[int, int], bytes]:
    """read(at, n) of a local path or of a URI."""
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path.removeprefix("file:")
    f = system.open_input_file(inner)

    def read(at: int, n: int) -> bytes:
        data = f.read_at(n, at)
        if len(data) < n:
            raise FormatError(f"{n} bytes at {at} go beyond the file's end")
        return data

    return read


@dataclass
class Link:
    name: str
    kind: str  # hard, soft, external
    address: int | None = None
    path: str | None = None
    file: str | None = None


@dataclass
class Dataspace:
    dims: tuple[int, ...]
    max_dims: tuple[int | None, ...]
    null: bool = False

    @property
    def size(self) -> int:
        return 0 if self.null else safe_product(self.dims)


@dataclass
class Chunk:
    coords: tuple[int, ...]  # of the chunk in the grid
    address: int
    nbytes: int
    mask: int


@dataclass
class Dataset:
    type: H5Type
    space: Dataspace
    layout: str
    address: int = UNDEFINED
    nbytes: int = 0
    data: bytes = b""
    chunk_dims: tuple[int, ...] = ()
    filters: tuple[tuple[int, tuple[int, ...]], ...] = ()
    fill: bytes | None = None
    index: tuple = ()


@dataclass
class Attribute:
    name: str
    type: H5Type | None
    space: Dataspace | None
    raw: bytes = b""
    error: str | None = None


@dataclass
class Header:
    address: int
    messages: list[tuple[int, int, bytes]] = field(default_factory=list)  # type, flags, data

    def of(self, kind: int) -> list[bytes]:
        return [d for k, _, d in self.messages if k == kind]

    @property
    def kind(self) -> str:
        have = {k for k, _, _ in self.messages}
        if LAYOUT in have:
            return "dataset"
        if have & {SYMBOL_TABLE, LINK_INFO, LINK}:
            return "group"
        return "datatype" if DATATYPE in have and DATASPACE not in have else "group" if not have - {ATTRIBUTE, ATTRIBUTE_INFO, 0, REFCOUNT, 10} else "unknown"


class Reader:
    def __init__(self, read: Callable[[int, int], bytes], verify: bool = True):
        self.read, self.verify = read, verify
        if read(0, 8) != SIGNATURE:
            raise FormatError("not a file of this format")
        self.version = read(8, 1)[0]
        if self.version == 0:
            head = read(0, 24)
            self.offsets, self.lengths = head[13], head[14]
            self.base, _, self.end, _ = self._ints(read(24, 4 * self.offsets), [self.offsets] * 4)
            entry = read(24 + 4 * self.offsets, 2 * self.offsets + 24)
            self.root = self._int(entry, self.offsets)
            cached = struct.unpack_from("<I", entry, 2 * self.offsets)[0]
            self.root_table = self._ints(entry[2 * self.offsets + 8 :], [self.offsets] * 2) if cached == 1 else None
        elif self.version in (2, 3):
            head = read(0, 12)
            self.offsets, self.lengths = head[9], head[10]
            body = read(12, 4 * self.offsets)
            self.base, _, self.end, self.root = self._ints(body, [self.offsets] * 4)
            self._check(head + body, read(12 + 4 * self.offsets, 4))
            self.root_table = None
        else:
            raise FormatError(f"superblock version {self.version} is not supported")
        if self.offsets not in (2, 4, 8) or self.lengths not in (2, 4, 8):
            raise FormatError("odd sizes of addresses")
        if self.root >= self.end:
            raise FormatError("the root lies beyond the file's end")
        self._heaps: dict[int, dict[int, bytes]] = {}

    # Small pieces

    def _int(self, data: bytes, at: int, n: int | None = None) -> int:
        n = n or self.offsets
        value = int.from_bytes(data[at : at + n], "little")
        return UNDEFINED if n == self.offsets and value == (1 << 8 * n) - 1 else value

    def _ints(self, data: bytes, sizes: list[int]) -> list[int]:
        out, at = [], 0
        for n in sizes:
            out.append(self._int(data, at, n))
            at += n
        return out

    def _check(self, data: bytes, sum_: bytes) -> None:
        if self.verify and lookup3(data) != int.from_bytes(sum_, "little"):
            raise FormatError("a metadata checksum differs")

    # Object headers

    def header(self, address: int) -> Header:
        start = self.read(address, 16)
        out = Header(address)
        if start[:4] == b"OHDR":
            flags = start[5]
            at = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.read(at, width), "little")
            whole = self.read(address, at + width + size - address + 4)
            self._check(whole[:-4], whole[-4:])
            todo = [whole[at + width - address : -4]]
            while todo:
                todo += self._messages2(out, todo.pop(0), bool(flags & 4))
        elif start[0] == 1:
            n, _, size = struct.unpack_from("<HII", start, 2)
            todo = [self.read(address + 16, size)]
            while todo and len(out.messages) < n:
                todo += self._messages1(out, todo.pop(0))
        else:
            raise FormatError(f"no object header at {address}")
        return out

    def _messages1(self, out: Header, data: bytes) -> list[bytes]:
        more, at = [], 0
        while at + 8 <= len(data):
            kind, size, flags = struct.unpack_from("<HHB", data, at)
            body = data[at + 8 : at + 8 + size]
            at += 8 + size
            if kind == CONTINUATION:
                where, n = self._ints(body, [self.offsets, self.lengths])
                more.append(self.read(where, n))
                out.messages.append((kind, flags, b""))
            else:
                out.messages.append((kind, flags, body))
        return more

    def _messages2(self, out: Header, data: bytes, ordered: bool) -> list[bytes]:
        more, at, head = [], 0, 6 if ordered else 4
        while at + head <= len(data):
            kind, size, flags = data[at], *struct.unpack_from("<HB", data, at + 1)
            body = data[at + head : at + head + size]
            at += head + size
            if kind == CONTINUATION:
                where, n = self._ints(body, [self.offsets, self.lengths])
                block = self.read(where, n)
                if block[:4] != b"OCHK":
                    raise FormatError("no continuation block")
                self._check(block[:-4], block[-4:])
                more.append(block[4:-4])
            else:
                out.messages.append((kind, flags, body))
        return more

    def _shared(self, kind: int, data: bytes) -> bytes:
        """The message that a shared message points to."""
        version = data[0]
        at = 8 if version == 1 else 2
        found = self.header(self._int(data, at)).of(kind)
        if not found:
            raise FormatError("a shared message is not there")
        return found[0]

    def message(self, header: Header, kind: int) -> bytes | None:
        for k, flags, data in header.messages:
            if k == kind:
                return self._shared(kind, data) if flags & 2 else data
        return None

    # Groups

    def links(self, header: Header) -> list[Link]:
        """Links of a group: its link messages, then its index of links, then its symbol table. In the order of their names."""
        out = [self._link(d) for d in header.of(LINK)]
        for info in header.of(LINK_INFO):
            at = 2 + (8 if info[1] & 1 else 0)
            heap, tree = self._int(info, at), self._int(info, at + self.offsets)
            if heap != UNDEFINED and tree != UNDEFINED:
                fractal = Fractal(self, heap)
                out += [self._link(fractal.get(r[4:])) for r in self.tree_records(tree)]
        tables = [self._ints(d, [self.offsets] * 2) for d in header.of(SYMBOL_TABLE)]
        if not tables and header.address == self.root and self.root_table:
            tables = [self.root_table]
        for tree, heap in tables:
            out += self._table_links(tree, heap)
        return sorted(out, key=lambda x: x.name.encode())

    def _link(self, d: bytes) -> Link:
        flags, at, kind = d[1], 2, 0
        if flags & 8:
            kind, at = d[at], at + 1
        at += (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
        width = 1 << (flags & 3)
        n = int.from_bytes(d[at : at + width], "little")
        at += width
        name, at = d[at : at + n].decode("utf-8", "replace"), at + n
        if kind == 0:
            return Link(name, "hard", self._int(d, at))
        (n,) = struct.unpack_from("<H", d, at)
        value = d[at + 2 : at + 2 + n]
        if kind == 1:
            return Link(name, "soft", path=value.decode("utf-8", "replace"))
        if kind == 64:
            file, path = value[1:].split(b"\0")[:2]
            return Link(name, "external", path=path.decode("utf-8", "replace"), file=file.decode("utf-8", "replace"))
        raise FormatError(f"link type {kind} is not supported")

    def _table_links(self, tree: int, heap: int) -> list[Link]:
        head = self.read(heap, 8 + 2 * self.lengths + self.offsets)
        if head[:4] != b"HEAP":
            raise FormatError("no local heap")
        size, _, where = self._ints(head[8:], [self.lengths, self.lengths, self.offsets])
        names = self.read(where, size)
        text = lambda at: names[at : names.index(b"\0", at)].decode("utf-8", "replace")
        out, todo, seen = [], [tree], set()
        while todo:
            at = todo.pop()
            if at in seen or at == UNDEFINED:
                continue
            seen.add(at)
            node = self.read(at, 8)
            if node[:4] == b"TREE":
                n = struct.unpack_from("<H", node, 6)[0]
                step = self.lengths + self.offsets
                body = self.read(at + 8 + 2 * self.offsets, n * step + self.lengths)
                todo += [self._int(body, self.lengths + k * step) for k in range(n)]
            elif node[:4] == b"SNOD":
                n = struct.unpack_from("<H", node, 6)[0]
                step = 2 * self.offsets + 24
                body = self.read(at + 8, n * step)
                for k in range(n):
                    name, target = self._ints(body[k * step :], [self.offsets] * 2)
                    cached, _, soft = struct.unpack_from("<III", body, k * step + 2 * self.offsets)
                    out.append(Link(text(name), "soft", path=text(soft)) if cached == 2 else Link(text(name), "hard", target))
            else:
                raise FormatError("no group index node")
        return out

    def tree_records(self, address: int) -> Iterator[bytes]:
        """All records of a version 2 index, of any depth."""
        head = self.read(address, 16 + self.offsets + 2 + self.lengths + 4)
        if head[:4] != b"BTHD":
            raise FormatError("no index header")
        self._check(head[:-4], head[-4:])
        node_size, record, depth = struct.unpack_from("<IHH", head, 6)
        root, n = self._int(head, 16), struct.unpack_from("<H", head, 16 + self.offsets)[0]
        most = [(node_size - 10) // record]  # records of a node at each level, leaves first
        total = [most[0]]
        widths = [(most[0].bit_length() + 7) // 8]
        for _ in range(depth):
            pointer = self.offsets + widths[0] + ((total[-1].bit_length() + 7) // 8 if len(most) > 1 else 0)
            most.append((node_size - 10 - pointer) // (record + pointer))
            total.append(most[-1] + (most[-1] + 1) * total[-1])

        def walk(at: int, n: int, level: int) -> Iterator[bytes]:
            node = self.read(at, node_size)
            if node[:4] != (b"BTIN" if level else b"BTLF"):
                raise FormatError("no index node")
            records = [node[6 + k * record : 6 + (k + 1) * record] for k in range(n)]
            if not level:
                yield from records
                return
            p = 6 + n * record
            for k in range(n + 1):
                child = self._int(node, p)
                count = int.from_bytes(node[p + self.offsets : p + self.offsets + widths[0]], "little")
                p += self.offsets + widths[0] + ((total[level - 1].bit_length() + 7) // 8 if level > 1 else 0)
                yield from walk(child, count, level - 1)
                if k < n:
                    yield records[k]

        if root != UNDEFINED and n:
            yield from walk(root, n, depth)

    # Messages of datasets

    def dataspace(self, d: bytes) -> Dataspace:
        version, rank, flags = d[0], d[1], d[2]
        at = 8 if version == 1 else 4
        if version not in (1, 2):
            raise FormatError(f"dataspace version {version} is not supported")
        null = version == 2 and d[3] == 2
        dims = tuple(self._int_n(d, at + k * self.lengths) for k in range(rank))
        at += rank * self.lengths
        limits = tuple(None if (m := self._int_n(d, at + k * self.lengths)) == (1 << 8 * self.lengths) - 1 else m for k in range(rank)) if flags & 1 else dims
        return Dataspace(dims, limits, null)

    def _int_n(self, d: bytes, at: int) -> int:
        return int.from_bytes(d[at : at + self.lengths], "little")

    def filters(self, d: bytes | None) -> tuple[tuple[int, tuple[int, ...]], ...]:
        if not d:
            return ()
        version, n = d[0], d[1]
        at, out = 8 if version == 1 else 2, []
        for _ in range(n):
            (kind,) = struct.unpack_from("<H", d, at)
            at += 2
            name = 0
            if version == 1 or kind >= 256:
                (name,) = struct.unpack_from("<H", d, at)
                at += 2
            _, count = struct.unpack_from("<HH", d, at)
            at += 4 + (-(-name // 8) * 8 if version == 1 else name)
            out.append((kind, struct.unpack_from(f"<{count}I", d, at)))
            at += 4 * count + (4 if version == 1 and count % 2 else 0)
        return tuple(out)

    def fill(self, header: Header) -> bytes | None:
        d = self.message(header, FILL)
        if d is not None:
            if d[0] == 3:
                return d[6 : 6 + struct.unpack_from("<I", d, 2)[0]] if d[1] & 0x20 else None
            if len(d) >= 8 and (d[0] == 1 or d[3]):
                return d[8 : 8 + struct.unpack_from("<I", d, 4)[0]] or None
            return None
        d = self.message(header, OLD_FILL)
        return (d[4 : 4 + struct.unpack_from("<I", d)[0]] or None) if d else None

    def dataset(self, header: Header) -> Dataset:
        t, s, d = (self.message(header, k) for k in (DATATYPE, DATASPACE, LAYOUT))
        if t is None or s is None or d is None:
            raise FormatError("a dataset lacks its type, shape or layout")
        kind, _ = parse_type(t)
        out = Dataset(kind, self.dataspace(s), "", filters=self.filters(self.message(header, FILTERS)), fill=self.fill(header))
        version, cls = d[0], d[1]
        if version not in (3, 4):
            raise FormatError(f"layout version {version} is not supported")
        if cls == 0:
            n = struct.unpack_from("<H", d, 2)[0]
            out.layout, out.data = "compact", d[4 : 4 + n]
        elif cls == 1:
            out.layout = "contiguous"
            out.address, out.nbytes = self._ints(d[2:], [self.offsets, self.lengths])
        elif cls == 2 and version == 3:
            rank = d[2]
            out.layout, out.address = "chunked", self._int(d, 3)
            out.chunk_dims = struct.unpack_from(f"<{rank - 1}I", d, 3 + self.offsets)
        elif cls == 2:
            flags, rank, width = d[2], d[3], d[4]
            dims = [int.from_bytes(d[5 + k * width : 5 + (k + 1) * width], "little") for k in range(rank)]
            at = 5 + rank * width
            index = d[at]
            out.layout, out.chunk_dims = "chunked", tuple(dims[:-1])
            if index == 1:
                size, mask = (self._int(d, at + 1, self.lengths), struct.unpack_from("<I", d, at + 1 + self.lengths)[0]) if flags & 2 else (0, 0)
                out.index, out.address = ("single", size, mask), self._int(d, at + 1 + (self.lengths + 4 if flags & 2 else 0))
            elif index == 2:
                out.index, out.address = ("implicit",), self._int(d, at + 1)
            else:
                raise FormatError(f"chunk index {index} is not supported")
        else:
            raise FormatError("virtual datasets are not supported")
        if out.layout == "chunked":
            if len(out.chunk_dims) != len(out.space.dims) or not all(out.chunk_dims):
                raise FormatError("a chunk's shape doesn't fit the dataset's")
            if safe_product(out.chunk_dims) * kind.size > LIMIT_CHUNK_BYTES:
                raise FormatError("a chunk is too large")
        return out

    def chunks(self, d: Dataset) -> list[Chunk]:
        """Allocated chunks within the extent, in the order of their coordinates."""
        rank, size = len(d.chunk_dims), safe_product(d.chunk_dims) * d.type.size
        counts = chunk_counts(d.space.dims, d.chunk_dims)
        if d.address == UNDEFINED:
            return []
        if d.index[:1] == ("single",):
            return [Chunk((0,) * rank, d.address, d.index[1] or size, d.index[2])]
        if d.index[:1] == ("implicit",):
            return [Chunk(tuple(int(x) for x in np.unravel_index(k, counts)), d.address + k * size, size, 0) for k in range(safe_product(counts))]
        out, todo, seen = [], [d.address], set()
        key = 8 + 8 * (rank + 1)
        while todo:
            at = todo.pop()
            if at in seen:
                raise FormatError("a chunk index goes round")
            seen.add(at)
            node = self.read(at, 8)
            if node[:4] != b"TREE" or node[4] != 1:
                raise FormatError("no chunk index node")
            level, n = node[5], struct.unpack_from("<H", node, 6)[0]
            body = self.read(at + 8 + 2 * self.offsets, n * (key + self.offsets))
            for k in range(n):
                p = k * (key + self.offsets)
                child = self._int(body, p + key)
                if level:
                    todo.append(child)
                    continue
                nbytes, mask = struct.unpack_from("<II", body, p)
                offset = struct.unpack_from(f"<{rank}Q", body, p + 8)
                if all(o < s for o, s in zip(offset, d.space.dims, strict=True)):
                    out.append(Chunk(tuple(o // c for o, c in zip(offset, d.chunk_dims, strict=True)), child, nbytes, mask))
        return sorted(out, key=lambda c: c.coords)

    # Attributes and heaps

    def attributes(self, header: Header) -> list[Attribute]:
        """Attributes in the header and in its index; one that can't be parsed has its error."""
        raw = [(f, d) for k, f, d in header.messages if k == ATTRIBUTE]
        for info in header.of(ATTRIBUTE_INFO):
            at = 2 + (2 if info[1] & 1 else 0)
            heap, tree = self._int(info, at), self._int(info, at + self.offsets)
            if heap != UNDEFINED and tree != UNDEFINED:
                fractal = Fractal(self, heap)
                raw += [(0, fractal.get(r[:8])) for r in self.tree_records(tree)]
        out = []
        for flags, d in raw:
            try:
                out.append(self._attribute(self._shared(ATTRIBUTE, d) if flags & 2 else d))
            except (FormatError, struct.error, IndexError, ValueError) as e:
                out.append(Attribute("?", None, None, error=str(e)))
        return out

    def _attribute(self, d: bytes) -> Attribute:
        version, flags = d[0], d[1]
        n_name, n_type, n_space = struct.unpack_from("<HHH", d, 2)
        at = 9 if version == 3 else 8
        pad = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name = d[at : at + n_name].split(b"\0")[0].decode("utf-8", "replace")
        at += pad(n_name)
        raw_type = d[at : at + n_type]
        t, _ = parse_type(self._shared(DATATYPE, raw_type) if version > 1 and flags & 1 else raw_type)
        at += pad(n_type)
        s = self.dataspace(d[at : at + n_space])
        at += pad(n_space)
        n = s.size * t.size
        if n > LIMIT_ATTRIBUTE_BYTES:
            raise FormatError("an attribute is too large")
        return Attribute(name, t, s, d[at : at + n])

    def heap_object(self, address: int, index: int) -> bytes:
        known = self._heaps.get(address)
        if known is None:
            head = self.read(address, 8 + self.lengths)
            if head[:4] != b"GCOL":
                raise FormatError("no heap collection")
            size = self._int(head, 8, self.lengths)
            data, at, known = self.read(address, size), 8 + self.lengths, {}
            while at + 8 + self.lengths <= size:
                k = struct.unpack_from("<H", data, at)[0]
                n = self._int(data, at + 8, self.lengths)
                if k == 0:
                    break
                known[k] = data[at + 8 + self.lengths : at + 8 + self.lengths + n]
                at += 8 + self.lengths + -(-n // 8) * 8
            if len(self._heaps) > 256:
                self._heaps.clear()
            self._heaps[address] = known
        if index not in known:
            raise FormatError(f"no object {index} in the heap at {address}")
        return known[index]

    def region(self, raw: bytes) -> tuple[int, list[tuple[tuple[int, ...], tuple[int, ...]]]]:
        """What a region reference stands for: the address of a dataset, and blocks of it (first and last element; points are blocks of one)."""
        address, index = self._int(raw, 0), struct.unpack_from("<I", raw, self.offsets)[0]
        if not address:
            return 0, []
        d = self.heap_object(address, index)
        kind, version, _, _, rank, n = struct.unpack_from("<6I", d, self.offsets)
        if kind not in (1, 2) or version != 1 or rank > 32:
            raise FormatError(f"a selection of kind {kind}, version {version} is not supported")
        numbers = struct.unpack_from(f"<{rank * n * kind}I", d, self.offsets + 24)
        places = [numbers[k : k + rank] for k in range(0, len(numbers), rank)]
        return self._int(d, 0), [(p, p) for p in places] if kind == 1 else list(zip(places[::2], places[1::2], strict=True))

    def values(self, compat: bool = False) -> Values:
        return Values(self.heap_object, compat)

    def attribute_value(self, a: Attribute, compat: bool = False):
        """Scalars for one element or no dimensions, else a list."""
        dtype = numpy_type(a.type)
        base = dtype.base if dtype.subdtype else dtype
        raw = np.frombuffer(a.raw, dtype=base)
        if dtype.subdtype:
            raw = raw.reshape(-1, *dtype.shape)
        out = self.values(compat).of(a.type, raw)
        out = out.tolist() if isinstance(out, np.ndarray) else out
        return out[0] if len(out) == 1 and a.space.size == 1 else out

    # Raw data

    def chunk_array(self, d: Dataset, c: Chunk) -> np.ndarray:
        """A whole chunk, edges padded as stored."""
        return np.frombuffer(decode(self.read(c.address, c.nbytes), d.filters, c.mask, self.verify), dtype=numpy_type(d.type)).reshape(*d.chunk_dims, *numpy_type(d.type).shape)

    def fill_array(self, d: Dataset, shape: tuple[int, ...]) -> np.ndarray:
        dtype = numpy_type(d.type)
        base = np.frombuffer(d.fill, dtype=dtype)[0] if d.fill and len(d.fill) == dtype.itemsize and not dtype.subdtype else np.zeros((), dtype=dtype.base if dtype.subdtype else dtype)
        return np.full((*shape, *dtype.shape), base, dtype=dtype.base if dtype.subdtype else dtype)

    def box(self, d: Dataset, lo: tuple[int, ...], hi: tuple[int, ...], chunk_list: list[Chunk] | None = None) -> np.ndarray:
        """Elements lo <= i < hi as an array; what was never written has the fill value."""
        shape = tuple(max(0, b - a) for a, b in zip(lo, hi, strict=True))
        dtype = numpy_type(d.type)
        if d.layout == "chunked":
            out = self.fill_array(d, shape)
            for c in self.chunks(d) if chunk_list is None else chunk_list:
                first = [k * s for k, s in zip(c.coords, d.chunk_dims, strict=True)]
                a = [max(x, y) for x, y in zip(first, lo, strict=True)]
                b = [min(x + s, y, n) for x, s, y, n in zip(first, d.chunk_dims, hi, d.space.dims, strict=True)]
                if any(x >= y for x, y in zip(a, b, strict=True)):
                    continue
                part = self.chunk_array(d, c)
                out[tuple(slice(x - y, z - y) for x, y, z in zip(a, lo, b, strict=True))] = part[tuple(slice(x - y, z - y) for x, y, z in zip(a, first, b, strict=True))]
            return out
        if not d.space.dims:
            shape = (1,)
        whole = not d.space.dims or tuple(d.space.dims[1:]) == tuple(shape[1:])
        n = safe_product(d.space.dims) if d.space.dims else 1
        at = lo[0] * (n // d.space.dims[0] if d.space.dims[0] else 0) if d.space.dims else 0
        if d.layout == "contiguous" and d.address == UNDEFINED:
            return self.fill_array(d, shape)
        if d.layout == "contiguous":
            # One read of the rows that the box spans, then numpy cuts the other dimensions.
            rows = shape[0] if d.space.dims else 1
            per = n // d.space.dims[0] if d.space.dims and d.space.dims[0] else 1
            data = self.read(d.address + at * dtype.itemsize, rows * per * dtype.itemsize)
        else:
            data = d.data[at * dtype.itemsize :]
            rows = shape[0]
            per = n // d.space.dims[0] if d.space.dims and d.space.dims[0] else 1
        base = dtype.base if dtype.subdtype else dtype
        flat = np.frombuffer(data, dtype=base, count=rows * per * (int(np.prod(dtype.shape)) if dtype.subdtype else 1))
        out = flat.reshape(rows, *d.space.dims[1:], *dtype.shape) if d.space.dims else flat.reshape(1, *dtype.shape)
        return out if whole else out[(slice(None), *(slice(a, b) for a, b in zip(lo[1:], hi[1:], strict=True)))]

    def array(self, path: str) -> np.ndarray:
        d = self.dataset(self.find(path))
        return self.box(d, (0,) * len(d.space.dims), d.space.dims)

    # Paths

    def find(self, path: str, depth: int = 32) -> Header:
        """The header of an object; soft links on the way are followed."""
        at = self.header(self.root)
        names = [n for n in path.split("/") if n]
        for k, name in enumerate(names):
            link = next((x for x in self.links(at) if x.name == name), None)
            if link is None:
                raise KeyError(f"no such object: /{'/'.join(names[: k + 1])}")
            if link.kind == "soft":
                if not depth:
                    raise FormatError("soft links go round")
                start = link.path if link.path.startswith("/") else "/".join(["", *names[:k], link.path])
                return self.find("/".join([start, *names[k + 1 :]]), depth - 1)
            if link.kind == "external":
                raise FormatError(f"{path} is in another file, {link.file}")
            at = self.header(link.address)
        return at

    def walk(self) -> Iterator[tuple[str, Link, Header | None]]:
        """All links in depth-first order; a group that is met again below itself is not entered."""

        def inside(prefix: str, header: Header, above: frozenset[int]) -> Iterator[tuple[str, Link, Header | None]]:
            for link in self.links(header):
                path = f"{prefix}/{link.name}"
                target = self.header(link.address) if link.kind == "hard" else None
                yield path, link, target
                if target is not None and target.kind == "group" and target.address not in above:
                    yield from inside(path, target, above | {target.address})

        root = self.header(self.root)
        yield from inside("", root, frozenset({root.address}))


class Fractal:
    """The heap that holds the links or attributes of an indexed object."""

    def __init__(self, reader: Reader, address: int):
        self.reader = reader
        o, n = reader.offsets, reader.lengths
        d = reader.read(address, 22 + 12 * n + 3 * o)
        if d[:4] != b"FRHP":
            raise FormatError("no heap header")
        self.id_length, filters, self.flags = *struct.unpack_from("<HH", d, 5), d[9]
        if filters:
            raise FormatError("filtered heaps are not supported")
        (self.most_managed,) = struct.unpack_from("<I", d, 10)
        at = 14 + n + o + n + o + 4 * n + 4 * n
        self.width, start, most, bits, _, root, self.rows = (int.from_bytes(d[a : a + w], "little") for a, w in self._places(at, [2, n, n, 2, 2, o, 2]))
        self.start, self.most, self.root = start, most, root
        self.offset_bytes = -(-bits // 8)
        self.blocks: list[tuple[int, int, int]] | None = None
        self.length_bytes = max(1, (min(most, self.most_managed).bit_length() + 7) // 8)

    @staticmethod
    def _places(at: int, widths: list[int]) -> Iterator[tuple[int, int]]:
        for w in widths:
            yield at, w
            at += w

    def get(self, heap_id: bytes) -> bytes:
        kind = heap_id[0] >> 4 & 3
        if kind == 2:
            n = (heap_id[0] & 15) + 1
            return heap_id[1 : 1 + n]
        if kind != 0:
            raise FormatError("huge heap objects are not supported")
        offset = int.from_bytes(heap_id[1 : 1 + self.offset_bytes], "little")
        n = int.from_bytes(heap_id[1 + self.offset_bytes : 1 + self.offset_bytes + self.length_bytes], "little")
        if self.blocks is None:
            self.blocks = list(self._blocks(self.root, 0, self.rows))
        k = bisect_right(self.blocks, offset, key=lambda x: x[0]) - 1
        first, size, block = self.blocks[k] if k >= 0 else (0, 0, UNDEFINED)
        if not first <= offset < first + size:
            raise FormatError("a heap offset is beyond its blocks")
        return self.reader.read(block + offset - first, n)

    def _row_size(self, row: int) -> int:
        return self.start << max(0, row - 1)

    def _blocks(self, address: int, first: int, rows: int) -> Iterator[tuple[int, int, int]]:
        """All direct blocks in order: the offset at which one begins, its size, its address."""
        if not rows:
            yield first, 1 << 8 * self.offset_bytes, address
            return
        o = self.reader.offsets
        slots = self.reader.read(address + 5 + o + self.offset_bytes, rows * self.width * o)
        for row in range(rows):
            size = self._row_size(row)
            for k in range(self.width):
                child = self.reader._int(slots, (row * self.width + k) * o)
                if child != UNDEFINED and size <= self.most:
                    yield first, size, child
                elif child != UNDEFINED:
                    below, total = 0, 0
                    while total < size:
                        total += self.width * self._row_size(below)
                        below += 1
                    yield from self._blocks(child, first, below)
                first += size
