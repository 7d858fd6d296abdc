"""Words of letters of many texts at once, with hashes, as numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LONGEST = 64
#: Characters of texts that are worked on at once.
CHARS_AT_ONCE = 500_000
ENDS = ".!?\n。！？؟।"
_END = re.compile(f"[{ENDS}]")
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(LONGEST)], dtype=np.uint64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; does it end a sentence."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    ends = np.zeros(0x110000, dtype=bool)
    ends[[ord(c) for c in ENDS]] = True
    return letter, ends


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _M1
    return (h ^ (h >> np.uint64(32))) * _M2


@dataclass
class Words:
    """Runs of letters of a list of texts, in order. Code points stand in ``codes``; others than letters are 0 in ``chars``."""

    chars: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray  # number of the sentence of each word, from 0, over all texts
    n_docs: int


def words_of(texts: list[str | None]) -> Words:
    """Sentences end at ``. ! ?`` and their like, at line feeds and at the end of a text; sentences without words have no number."""
    letter, ends_sentence = _tables()
    low = [(t or "").lower() for t in texts]
    # Each text ends in a line feed, so that no word or sentence crosses into the next.
    codes = np.frombuffer("".join(f"\n{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        none = np.zeros(0, dtype=np.int64)
        return Words(codes, none, none, none.astype(np.uint64), none, none, len(texts))
    is_letter = letter[codes]
    edge = np.diff(is_letter.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    chars = np.where(is_letter, codes, 0)
    firsts = np.cumsum([0] + [len(t) + 2 for t in low])
    doc = np.searchsorted(firsts, starts, side="right") - 1
    breaks = np.cumsum(ends_sentence[codes])[starts] if len(starts) else starts
    sentence = np.concatenate(([0], np.cumsum(np.diff(breaks) != 0))) if len(starts) else starts
    size = ends - starts
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    position = np.repeat(starts, size) + at
    terms = chars[position].astype(np.uint64) * _POWERS[np.minimum(at, LONGEST - 1)]
    hashes = mix(np.add.reduceat(terms, np.cumsum(size) - size)) if len(starts) else np.zeros(0, dtype=np.uint64)
    return Words(chars, starts, ends, hashes, doc, sentence, len(texts))


def pieces_of(text: str, most: int) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, which end at a sentence's end, else at white space, else anywhere."""
    at = 0
    while len(text) - at > most + most // 2:
        found = _END.search(text, at + most, at + most + most // 2)
        end = found.end() if found else max(text.rfind(" ", at + most, at + most + most // 2), text.rfind("\t", at + most, at + most + most // 2)) + 1
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def parts(texts: list[str | None], most: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in parts of about CHARS_AT_ONCE characters: numbers of texts, and the texts or pieces of them, in order."""
    most = most or CHARS_AT_ONCE
    docs, part, chars = [], [], 0
    for d, text in enumerate(texts):
        for piece in pieces_of(text or "", most):
            if part and chars + len(piece) > most:
                yield docs, part
                docs, part, chars = [], [], 0
            docs.append(d)
            part.append(piece)
            chars += len(piece)
    if part:
        yield docs, part
