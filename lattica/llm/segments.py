"""Texts of an Arrow batch as flat byte arrays: words, lines and segments with their distinct values, without a Python step for each word.

A slice of a batch is one byte array in which a space stands before each text, so that no run crosses from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import _IS_SPACE

#: Bytes of texts that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


@dataclass
class Texts:
    """Bytes of texts with a space before each; text d is data[offsets[d] + 1 : offsets[d + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte, by text."""
        return np.add.reduceat(flags, self.offsets[:-1], dtype=np.int64) if self.n else np.zeros(0, dtype=np.int64)

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1

    def chars(self) -> np.ndarray:
        """Code points of each text."""
        return self.sums((self.data & 0xC0) != 0x80) - 1

    def joined(self) -> bytes:
        return self.data.tobytes()


def plain_of(column: pa.Array) -> Texts:
    """Texts without spaces put before them: text d is data[offsets[d] : offsets[d + 1]]."""
    column = pc.fill_null(column, "")
    n = len(column)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return Texts(data, ends - ends[0])


def texts_of(column: pa.Array) -> Texts:
    plain = plain_of(column)
    offsets = plain.offsets + np.arange(len(plain.offsets))
    out = np.full(int(offsets[-1]), 32, dtype=np.uint8)
    own = np.ones(len(out), dtype=bool)
    own[offsets[:-1]] = False
    out[own] = plain.data
    return Texts(out, offsets)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of a string column with about ``most`` bytes."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        before = ends[at] - size[at]
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, end - at
        at = end


def distinct(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of values that stand one after the other: the index of each among the distinct ones, and these (binary)."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.ascontiguousarray(data)
    values = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    space = _IS_SPACE[t.data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[0::2]
    ends = edge[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(t.data))
    # A word at a text's end and the next text's space have an edge between them, for a space stands before each text.
    return starts, ends


def word_ids(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    return distinct(t.data[~_IS_SPACE[t.data]], ends - starts)


def segments(t: Texts, cuts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Segments between cuts (places in the data, each text's start among them): index among the distinct ones, these, and the segments of each text."""
    index, found = distinct(t.data, np.diff(cuts, append=len(t.data)))
    return index, found, np.diff(np.searchsorted(cuts, t.offsets))


def space_cuts(t: Texts) -> np.ndarray:
    """Places of spaces that follow another character, and of the texts' starts."""
    space = t.data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[t.offsets[:-1]] = True
    # The space before a text and spaces that the text begins with are one run.
    return np.flatnonzero(cut)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the elements of runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def by_text(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the sizes of each text's elements; counts: the elements of each text."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def entropies(doc: np.ndarray, tokens: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Entropy in bits of each document's tokens; ``size`` is above all tokens."""
    n = np.bincount(doc, minlength=n_docs)
    out = np.zeros(n_docs)
    if len(doc):
        key = np.sort(doc * size + tokens)
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(cut, append=len(key))
        owner = key[cut] // size
        p = count / n[owner]
        out = np.bincount(owner, weights=-p * np.log2(p), minlength=n_docs)
    return out + 0.0


_NO_CUT_AFTER = np.zeros(256, dtype=bool)
_NO_CUT_AFTER[[*range(9, 14), *range(28, 33)]] = True


def after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether what stands before places of the data (each above 0) is or may be white space."""
    p1 = data[at - 1]
    out = _NO_CUT_AFTER[p1]
    high = np.flatnonzero(p1 >= 0x80)  # the white space beyond ASCII, and some marks
    if len(high):
        p2, p3 = data[np.maximum(at[high] - 2, 0)], data[np.maximum(at[high] - 3, 0)]
        one = p1[high]
        out[high] |= ((p2 == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | ((p3 == 0xE3) & (p2 == 0x80) & (one == 0x80)) | ((p3 == 0xE1) & ((p2 == 0x9A) | (p2 == 0xA0)))
    return out


def white_cuts(t: Texts) -> np.ndarray:
    """In plain texts: places of spaces that follow what is no white space, and of the texts' starts.

    A splitter that joins at most one space to the word after it, and runs of white space to each other, never crosses these.
    """
    cut = t.data == 32
    if len(cut):
        cut[0] = False
    at = np.flatnonzero(cut)
    cut[at[after_white(t.data, at)]] = False
    starts = t.offsets[:-1]
    cut[starts[starts < len(cut)]] = True
    return np.flatnonzero(cut)


def flat_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array that stands alone."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
