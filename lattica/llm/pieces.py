"""Exact piece ids of a SentencePiece BPE model, segment by segment.

No piece of such a model holds a space after another character, so no merge crosses from a character to
the space after it: a text may be cut there, and each segment (spaces, then no space) encoded apart. The
distinct segments of a slice of texts are encoded once, in one call of the library.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from .segments import Texts, by_text, gather, segments, space_cuts, texts_of

SPACE_PIECE = "▁"
_SEGMENT = re.compile(r" +[^ ]*")


class PieceCodec:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.size = n
        self.is_byte = [self.sp.is_byte(i) for i in range(n)]
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) for i in range(n)]
        names = [self.sp.id_to_piece(i) for i in range(n)]
        #: What each id decodes to.
        self.surface = [b"" if special[i] else bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(names)]
        #: Pieces that merges may make, with spaces for the space sign.
        self.pieces = {p.replace(SPACE_PIECE, " "): i for i, p in enumerate(names) if not special[i] and not self.is_byte[i]}
        self.byte_ids = {self.surface[i]: i for i in range(n) if self.is_byte[i]}
        self.longest = max(map(len, self.pieces))
        if any(" " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("a piece of this model crosses the end of a word")
        #: What ids are packed as.
        self.id_type = np.uint16 if n <= 1 << 16 else np.int32
        self.surface_sizes = np.array([len(x) for x in self.surface], dtype=np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_data = np.frombuffer(b"".join(self.surface), dtype=np.uint8)

    @staticmethod
    def normal(text: str) -> str:
        """What the model sees of a text: the space sign is a space, and a space is put before all."""
        return " " + text.replace(SPACE_PIECE, " ") if text else ""

    def encode_segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments (spaces, then no space), one after the other, and the ids of each."""
        # The library puts a space of its own before a text, so one is taken off here.
        ids = self.sp.encode([s[1:] for s in segs], num_threads=1)
        for k in [k for k, x in enumerate(ids) if not x]:
            ids[k] = [self.pieces[" "]]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum())), sizes

    def encode_normal(self, normal: str) -> np.ndarray:
        """Ids of a text that begins with a space (as :meth:`normal` makes it), or of a part that begins at a cut."""
        found = _SEGMENT.findall(normal)
        index = {s: k for k, s in enumerate(dict.fromkeys(found))}
        flat, sizes = self.encode_segments(list(index))
        own = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
        return flat[gather((np.cumsum(sizes) - sizes)[own], sizes[own])]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_normal(self.normal(text or "")).tolist()

    def encode_texts(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the ids of each text."""
        index, found, count = segments(t, space_cuts(t))
        flat, size = self.encode_segments(found.cast(pa.large_string()).to_pylist())
        empty = np.diff(t.offsets) == 1
        if empty.any():
            index = index[np.repeat(~empty, count)]
            count = np.where(empty, 0, count)
        sizes = size[index]
        ids = flat[gather((np.cumsum(size) - size)[index], sizes)]
        return ids, by_text(sizes, count)

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.id_type).tobytes()

    def decode_bytes(self, ids) -> bytes:
        """The bytes that ids stand for, without the space that encoding puts before all."""
        joined = b"".join(map(self.surface.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_lists(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of lists of ids that stand one after the other."""
        sizes = self.surface_sizes[ids]
        data = self.surface_data[gather(self.surface_starts[ids], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        lead = starts[starts < ends]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), dtype=bool)
        keep[lead] = False
        dropped = np.zeros(len(data) + 1, dtype=np.int64)
        dropped[lead + 1] = 1
        offsets = np.concatenate(([0], ends - np.cumsum(dropped)[ends])).astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text has
            out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.binary()).to_pylist()], pa.string())
        return out


def model_texts(column: pa.Array) -> Texts:
    """Texts as the model sees them: :meth:`PieceCodec.normal` of each, but a space stands before empty ones too."""
    if pc.any(pc.match_substring(column, SPACE_PIECE)).as_py():
        column = pc.replace_substring(column, SPACE_PIECE, " ")
    return texts_of(column)


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


@lru_cache(maxsize=1)
def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
