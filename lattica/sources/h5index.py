"""Index structures that a file's groups and attributes are found by, as they are written: heaps of objects, indexes of records by hash, tables of names.

Each function gets ``append``, which puts bytes at the end of the file and gives their address, and ``put``, which puts bytes at an address.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import count

from lattica.functions.codecs import lookup3

from .h5read import UNDEFINED

Append, Put = Callable[[bytes], int], Callable[[int, bytes], None]
#: Blocks in a row of a heap, bytes of a block's front (without a checksum), bits of an offset.
HEAP_WIDTH, BLOCK_FRONT, OFFSET_BITS = 4, 17, 32
#: The largest block that holds objects itself: an id has two bytes for an object's length.
MOST_DIRECT = 1 << 16
#: Bytes of an index's node; entries of a name table's leaf and children of its nodes (twice the constants of the superblock).
NODE_BYTES, LEAF_ENTRIES, NODE_CHILDREN = 512, 8, 32
LINKS_BY_NAME, ATTRIBUTES_BY_NAME = 5, 8


def checked(data: bytes) -> bytes:
    return data + struct.pack("<I", lookup3(data))


def write_heap(append: Append, put: Put, objects: list[bytes], id_length: int) -> tuple[int, list[bytes]]:
    """A heap of objects: its address, and the id of each object.

    Blocks stand in rows of four; those of the first two rows have the starting size, those of each further row twice that of the row
    before. The starting size is such that the largest object fits the smallest block. Where a row's size is beyond that of direct
    blocks, its blocks are tables of rows themselves, of just that size in all.
    """
    start = 512
    while start < max(map(len, objects)) + BLOCK_FRONT:
        start *= 2
    if start > MOST_DIRECT:
        raise ValueError("a heap's object is too large for its id")
    size = lambda row: start << max(0, row - 1)  # noqa: E731 (of a block of a row)
    rows_of = lambda row: row - HEAP_WIDTH.bit_length() + 1  # noqa: E731 (of the table that is a block of a row)

    def direct(rows: Iterator[int]) -> Iterator[int]:
        """The sizes of direct blocks, in order."""
        for row in rows:
            for _ in range(HEAP_WIDTH):
                if size(row) <= MOST_DIRECT:
                    yield size(row)
                else:
                    yield from direct(range(rows_of(row)))

    sizes = direct(count())
    blocks, firsts, room, at, ids = [bytearray(BLOCK_FRONT)], [0], [next(sizes)], 0, []
    for o in objects:
        if len(blocks[-1]) + len(o) > room[-1]:
            at += room[-1]
            blocks.append(bytearray(BLOCK_FRONT))
            firsts.append(at)
            room.append(next(sizes))
        ids.append((at + len(blocks[-1]), len(o)))
        blocks[-1] += o
    most = max(room)
    if at + room[-1] >= 1 << OFFSET_BITS:
        raise ValueError("a heap's objects are too many")
    longest = min(most, MOST_DIRECT - 1)
    length_bytes = max(1, (longest.bit_length() + 7) // 8)
    header = append(b"\0" * 146)  # blocks name its place
    places = []
    for b, first, n in zip(blocks, firsts, room, strict=True):
        b[:BLOCK_FRONT] = b"FHDB\0" + struct.pack("<QI", header, first)
        places.append(append(bytes(b).ljust(n, b"\0")))
    left = iter(places)

    def table(first: int, rows: int) -> int:
        """A table of the next blocks, at an offset of the heap; its places after the last block are empty."""
        slots, offset = [], first
        for row in range(rows):
            for _ in range(HEAP_WIDTH):
                slots.append(UNDEFINED if offset > firsts[-1] else next(left) if size(row) <= MOST_DIRECT else table(offset, rows_of(row)))
                offset += size(row)
        return append(checked(b"FHIB\0" + struct.pack("<QI", header, first) + struct.pack(f"<{len(slots)}Q", *slots)))

    rows = 0 if len(blocks) == 1 else next(r for r in count(1) if HEAP_WIDTH * size(r) > firsts[-1])
    root = table(0, rows) if rows else places[0]
    space = at + room[-1]
    head = b"FRHP\0" + struct.pack("<HHBI", id_length, 0, 0, longest) + struct.pack("<QQQQQQQQ", 0, UNDEFINED, 0, UNDEFINED, space, space, space, len(objects)) + struct.pack("<QQQQ", 0, 0, 0, 0)
    put(header, checked(head + struct.pack("<HQQHHQH", HEAP_WIDTH, start, most, OFFSET_BITS, 1, root, rows)))
    if 5 + length_bytes > id_length:
        raise ValueError("a heap's object is too large for its id")
    return header, [(b"\0" + struct.pack("<I", a) + n.to_bytes(length_bytes, "little")).ljust(id_length, b"\0") for a, n in ids]


def write_index(append: Append, kind: int, records: list[bytes]) -> int:
    """An index of records, all of one size and in order; of as many levels as it needs."""
    record = len(records[0])
    most, total = [(NODE_BYTES - 10) // record], [(NODE_BYTES - 10) // record]
    width = (most[0].bit_length() + 7) // 8
    wide = lambda level: (total[level - 1].bit_length() + 7) // 8 if level > 1 else 0  # noqa: E731 (bytes of a count of all records below)
    while total[-1] < len(records):
        pointer = 8 + width + (0 if len(most) == 1 else (total[-1].bit_length() + 7) // 8)
        most.append((NODE_BYTES - 10 - pointer) // (record + pointer))
        total.append(most[-1] + (most[-1] + 1) * total[-1])
    depth = len(most) - 1

    def node(part: list[bytes], level: int) -> tuple[int, int]:
        """The node of some records: its address, and its own records."""
        if not level:
            return append(checked(b"BTLF\0" + bytes([kind]) + b"".join(part)).ljust(NODE_BYTES, b"\0")), len(part)
        children = max(2, -(-(len(part) + 1) // (total[level - 1] + 1)))
        rest, own, below, at = len(part) - (children - 1), [], [], 0
        for k in range(children):
            n = rest // children + (k < rest % children)
            below.append((*node(part[at : at + n], level - 1), n))
            at += n
            if k < children - 1:
                own.append(part[at])
                at += 1
        pointers = b"".join(struct.pack("<Q", a) + m.to_bytes(width, "little") + (n.to_bytes(wide(level), "little") if level > 1 else b"") for a, m, n in below)
        return append(checked(b"BTIN\0" + bytes([kind]) + b"".join(own) + pointers).ljust(NODE_BYTES, b"\0")), len(own)

    root, n = node(records, depth)
    return append(checked(b"BTHD\0" + bytes([kind]) + struct.pack("<IHHBBQHQ", NODE_BYTES, record, depth, 100, 40, root, n, len(records))))


def write_names(append: Append, put: Put, named: dict[str, bytes], kind: int) -> tuple[int, int]:
    """(heap, index) of objects by name, in the order of their names' hashes. kind: links or attributes."""
    id_length = 7 if kind == LINKS_BY_NAME else 8
    heap, ids = write_heap(append, put, list(named.values()), id_length)
    records = []
    for name, i in zip(named, ids, strict=True):
        h = lookup3(name.encode())
        record = struct.pack("<I", h) + i if kind == LINKS_BY_NAME else i + b"\0" + struct.pack("<II", 0, h)
        records.append((h, name.encode(), record))
    return heap, write_index(append, kind, [r for _, _, r in sorted(records)])


def write_table(append: Append, put: Put, links: dict[str, tuple[int, str | None]]) -> tuple[int, int]:
    """(tree, heap) of an old table of names: name to (address, None), or to (0, target) of a soft link."""
    text, at = bytearray(8), {}

    def place(s: str) -> int:
        if s not in at:
            at[s] = len(text)
            text.extend(s.encode() + b"\0")
            text.extend(b"\0" * (-len(text) % 8))
        return at[s]

    entries = [(place(n), *links[n]) for n in sorted(links, key=str.encode)]
    targets = {t: place(t) for _, _, t in entries if t is not None}
    heap = append(b"HEAP" + b"\0" * 4 + struct.pack("<QQQ", len(text), 1, append(bytes(text))))
    nodes = []  # the address of each node, and the name that ends it
    for k in range(0, max(1, len(entries)), LEAF_ENTRIES):
        part = entries[k : k + LEAF_ENTRIES]
        body = b"".join(struct.pack("<QQII", n, UNDEFINED if t is not None else a, 2 if t is not None else 0, 0) + struct.pack("<I12x", targets[t] if t is not None else 0) for n, a, t in part)
        nodes.append((append((b"SNOD" + struct.pack("<BBH", 1, 0, len(part)) + body).ljust(8 + 40 * LEAF_ENTRIES, b"\0")), part[-1][0] if part else 0))
    size, level = 24 + 8 + 16 * NODE_CHILDREN, 0
    while True:
        parts = [nodes[k : k + NODE_CHILDREN] for k in range(0, len(nodes), NODE_CHILDREN)]
        first, before, above = append(b"\0" * (size * len(parts))), 0, []
        for k, part in enumerate(parts):
            left = first + (k - 1) * size if k else UNDEFINED
            right = first + (k + 1) * size if k + 1 < len(parts) else UNDEFINED
            body = struct.pack("<Q", before) + b"".join(struct.pack("<QQ", a, last) for a, last in part)
            put(first + k * size, b"TREE" + struct.pack("<BBHQQ", 0, level, len(part), left, right) + body)
            before = part[-1][1]
            above.append((first + k * size, before))
        if len(above) == 1:
            return first, heap
        level, nodes = level + 1, above
