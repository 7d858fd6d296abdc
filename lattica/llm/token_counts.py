"""Operator 3: exact token counts at every prefix of a text, by dynamic programming.

For byte-pair encoding with ranked merges, a sequence of tokens is the encoding of its bytes if and only if
each two neighbours are the encoding of their own bytes. So the last token of the encoding of a prefix is
the one token that ends there and fits the last token of the prefix before it, and
``count[i] = count[i - len(last[i])] + 1``. One pass over a word gives the count of each of its prefixes, which
are kept; sums over the words before it give the counts of the text's prefixes. Truncation and budget questions
are then lookups: nothing is encoded again.

Texts are cut into segments at spaces that the splitter never crosses; distinct segments of a slice are counted
once, and the sums over segments are array operations.

Cases: a null text is empty, with no bytes and no tokens. Strings of special tokens inside a text are that
token, as the library has it by default. Repeated rows stay; extra columns are not read; an empty table
gives an empty result. A very long text is a slice of its own, its prefix table too.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import batch_of
from .pieces import vocabulary
from .segments import after_white, by_text, flat_binary, plain_of, segments, slices, white_cuts
from .shapes import with_id

#: How this vocabulary's pre-tokeniser splits, and what it does to bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without characters from U+0250 on, where the classes are short: faster.
_LETTER, _NUMBER, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
SPLIT_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WHITE}{_LETTER}{_NUMBER}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
CACHE_ENTRIES = 300_000
CACHE_LONGEST = 40


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_SPREAD, SLOT_BITS = np.uint64(0xC2B2AE3D27D4EB4F), 20
#: Segments that are split at once, words that are learned at once.
BLOCK, LEARN_AT_ONCE = 64, 20_000
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(CACHE_LONGEST * 4 + 2)], dtype=np.uint64)


def _hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * _BASE + b + 1) & _M
    return h


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.merges}
        self.longest = max(map(len, self.tokens))
        self._split, self._split_latin, self._beyond = regex.compile(SPLIT), re.compile(SPLIT_LATIN), re.compile("[^\x00-\u024f]")
        ranks = {bytes([b]): b for b in range(256)}
        for a, b in self.merges:
            ranks.setdefault(a + b, len(ranks))
        self.ids = ranks
        #: Hashes of the tokens, in order, with their ids: vectorised lookups of substrings.
        by_hash = sorted((_hash(t), k) for t, k in ranks.items())
        self.hashes = np.array([h for h, _ in by_hash], dtype=np.uint64)
        self.hash_ids = np.array([k for _, k in by_hash], dtype=np.int64)
        if len(np.unique(self.hashes)) < len(ranks):
            raise ValueError("two tokens share a hash")
        #: Where a token's hash stands, by some bits of it; -1: no token, -2: several.
        slot = (self.hashes * _SPREAD) >> np.uint64(64 - SLOT_BITS)
        self.slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.flatnonzero(np.bincount(slot.astype(np.int64), minlength=1 << SLOT_BITS) > 1)] = -2
        self.by_id = {k: t for t, k in ranks.items()}
        self.wholes = None
        self.pair_encoder = tiktoken.Encoding("pairs", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        #: tokens of each vocabulary entry when encoded alone: an entry that splits again is never a last token.
        self.fits_cache: dict[tuple[bytes, bytes], bool] = {}
        self.own_cache: dict[bytes, bool] = {}
        #: Tokens of words; a special token is never a word, so it has its place here too.
        self.cache: dict[str, int] = dict.fromkeys(self.specials, 1)
        #: Counts at the byte prefixes of words, from the first byte on; a byte each.
        self.prefixes: dict[str, bytes] = {}
        #: The last word that is not kept, and its counts.
        self.last_long: tuple[str | None, list[int]] = (None, [])

    def _forget(self) -> None:
        self.cache.clear()
        self.cache.update(dict.fromkeys(self.specials, 1))
        self.prefixes.clear()

    def words(self, text: str) -> list[str]:
        return (self._split if self._beyond.search(text) else self._split_latin).findall(text)

    def fits(self, a: bytes, b: bytes) -> bool:
        known = self.fits_cache.get((a, b))
        if known is None:
            if len(self.fits_cache) > 4 * CACHE_ENTRIES:
                self.fits_cache.clear()
            ids = self.pair_encoder(a + b)
            known = self.fits_cache[a, b] = len(ids) == 2 and ids[0] == self.ids[a] and ids[1] == self.ids[b]
        return known

    def whole(self, a: bytes) -> bool:
        known = self.own_cache.get(a)
        if known is None:
            known = self.own_cache[a] = len(self.pair_encoder(a)) == 1
        return known

    def word_prefixes(self, data: bytes) -> list[int]:
        """Counts of all byte prefixes of one word, from the empty one on."""
        n = len(data)
        last: list[bytes] = [b""] * (n + 1)
        count = [0] * (n + 1)
        tokens, longest, fits = self.tokens, self.longest, self.fits
        for i in range(1, n + 1):
            for s in range(max(0, i - longest), i):
                t = data[s:i]
                if t in tokens and (fits(last[s], t) if s else self.whole(t)):
                    last[i] = t
                    count[i] = count[s] + 1
                    break
            else:
                raise ValueError("no token fits")
        return count

    def _tokens_of(self, h: np.ndarray) -> np.ndarray:
        """Ids of the tokens that have hashes; -1 for none."""
        at = self.slots[(h * _SPREAD) >> np.uint64(64 - SLOT_BITS)]
        some = np.flatnonzero(at != -1)
        place = at[some]
        shared = np.flatnonzero(place == -2)  # slots of several tokens
        place[shared] = np.minimum(np.searchsorted(self.hashes, h[some[shared]]), len(self.hashes) - 1)
        out = np.full(len(h), -1, dtype=np.int64)
        out[some] = np.where(self.hashes[place] == h[some], self.hash_ids[place], -1)
        return out

    def learn(self, words: list[str]) -> None:
        """Put the counts of many words and of their prefixes into the cache: the same programme as :meth:`word_prefixes`, over all words at once."""
        if len(self.cache) + len(words) > CACHE_ENTRIES:
            self._forget()
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(words)), key=lambda k: len(data[k]))
        for a in range(0, len(order), LEARN_AT_ONCE):
            self._learn([words[k] for k in order[a : a + LEARN_AT_ONCE]], [data[k] for k in order[a : a + LEARN_AT_ONCE]])

    def _learn(self, words: list[str], data: list[bytes]) -> None:
        n, most = len(data), max(map(len, data))
        size = np.fromiter(map(len, data), dtype=np.int64, count=n)
        grid = np.frombuffer(b"".join(d.ljust(most, b"\0") for d in data), dtype=np.uint8).reshape(n, most)
        h = np.zeros((most + 1, n), dtype=np.uint64)
        for i in range(most):
            h[i + 1] = h[i] * np.uint64(_BASE) + grid[:, i] + np.uint64(1)
        if self.wholes is None:
            self.wholes = np.zeros(len(self.ids), dtype=bool)
            self.wholes[[k for t, k in self.ids.items() if self.whole(t)]] = True
        last, count = np.zeros((most + 1, n), dtype=np.int32), np.zeros((most + 1, n), dtype=np.int32)
        by_id, fits = self.by_id, self.fits
        for i in range(1, most + 1):
            open_ = np.flatnonzero(size >= i)
            for s in range(max(0, i - self.longest), i):
                if not len(open_):
                    break
                token = self._tokens_of(h[i, open_] - h[s, open_] * _POWERS[i - s])
                found = np.flatnonzero(token >= 0)
                if not len(found):
                    continue
                token = token[found]
                if s == 0:
                    good = self.wholes[token]
                else:
                    pairs, back = np.unique(last[s, open_[found]].astype(np.int64) << 32 | token, return_inverse=True)
                    good = np.fromiter((fits(by_id[p >> 32], by_id[p & 0xFFFFFFFF]) for p in pairs.tolist()), dtype=bool, count=len(pairs))[back]
                found, token = found[good], token[good]
                rows = open_[found]
                last[i, rows] = token
                count[i, rows] = count[s, rows] + 1
                left = np.ones(len(open_), dtype=bool)
                left[found] = False
                open_ = open_[left]
            if len(open_):
                raise ValueError("no token fits")
        self.cache.update(zip(words, count[size, np.arange(n)].tolist(), strict=True))
        if most < 256:
            rows = np.ascontiguousarray(count[1:].T.astype(np.uint8)).tobytes()
            self.prefixes.update((w, rows[k * most : k * most + m]) for k, (w, m) in enumerate(zip(words, size.tolist(), strict=True)))

    def counts(self, words: list[str]) -> list[int]:
        found = list(map(self.cache.get, words))
        if None in found:
            missing = {w for w, c in zip(words, found, strict=True) if c is None}
            short = [w for w in missing if len(w) <= CACHE_LONGEST]
            if len(short) > 200:
                self.learn(short)
            rest = {w: self.cache.get(w) or self.word_count(w) for w in missing}
            found = [rest[w] if c is None else c for w, c in zip(words, found, strict=True)]
        return found

    def known_prefixes(self, word: str) -> list[int]:
        """Counts of all byte prefixes of a word, from the empty one on; looked up where they are kept."""
        kept = self.prefixes.get(word)
        if kept is not None:
            return [0, *kept]
        if self.last_long[0] != word:
            self.last_long = (word, self.word_prefixes(word.encode("utf-8", "surrogatepass")))
        return self.last_long[1]

    def word_count(self, word: str) -> int:
        known = self.cache.get(word)
        if known is None:
            known = self.known_prefixes(word)[-1]
            if len(word) <= CACHE_LONGEST:
                if len(self.cache) > CACHE_ENTRIES:
                    self._forget()
                self.cache[word] = known
        return known

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """The text cut into (is special, string)."""
        if self.special is None or not any(s in text for s in self.specials):
            return [(False, text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [*out, (False, text[at:])]

    def pieces(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.words(text)
        return [w for special, part in self.parts(text) for w in ([part] if special else self.words(part))]

    def text_count(self, text: str) -> int:
        return sum(self.counts(self.pieces(text)))

    def segment_counts(self, found: pa.Array) -> np.ndarray:
        """Tokens of segments (binary) that stand alone.

        Segments that begin with a space and end in no white space may stand one after the other: they are split into words in blocks.
        """
        data, offsets = flat_binary(found)
        out = np.zeros(len(found), dtype=np.int64)
        if not len(found):
            return out
        joins = (data[offsets[:-1]] == 32) & ~after_white(data, offsets[1:])
        for special in self.specials:
            joins &= ~pc.match_substring(found, special).to_numpy(zero_copy_only=False)
        data, offsets = flat_binary(found.filter(pa.array(joins)))
        words = []
        for a in range(0, len(offsets) - 1, BLOCK):
            part = offsets[a : a + BLOCK + 1]
            words += self.words(data[part[0] : part[-1]].tobytes().decode())
        counts = np.concatenate(([0], np.cumsum(self.counts(words)))) if words else np.zeros(1, dtype=np.int64)
        # Where each segment's last word ends, in code points of all blocks.
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets[1:]]
        at = np.searchsorted(np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))), chars) + 1
        out[joins] = np.diff(counts[at], prepend=0)
        rest = found.filter(pa.array(~joins)).to_pylist()
        words = [self.pieces(x.decode("utf-8", "replace")) for x in rest]
        counts = np.array(self.counts(list(chain.from_iterable(words))), dtype=np.int64)
        out[~joins] = by_text(counts, np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        return out

    def table_of(self, column: pa.Array) -> PrefixTable:
        return PrefixTable(self, column)

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most budget tokens."""
        return self.table_of(pa.array([text], pa.string())).longest(0, budget)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for each i from 0 to len(text), as the encoding of that prefix alone has them."""
        words = self.pieces(text)
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at = before = 0
        for k, (w, c) in enumerate(zip(words, self.counts(words), strict=True)):
            out[at + 1 : at + len(w) + 1] = self.tail_counts(words, k, before)
            at, before = at + len(w), before + c
        return out

    def tail_counts(self, words: list[str], k: int, before: int) -> list[int]:
        """Counts of the text's prefixes that end in word k, after each of its code points.

        Cut inside a word, the splitter may cut what is left otherwise: a cut contraction is a mark and letters,
        white space that no longer precedes a word is one run, and a cut special token is ordinary text.
        """
        w = words[k]
        if w in self.specials:
            # Ordinary text, together with the word before it, which may take in its first marks.
            start, base = self._fresh(words, k, before)
            left = "".join(words[start:k])
            return [base + self.text_count(left + w[:j]) for j in range(1, len(w))] + [before + 1]
        counts = self.known_prefixes(w)
        at = range(1, len(w) + 1) if w.isascii() else np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in w]).tolist()
        out = [before + counts[i] for i in at]
        if w[0] == "'" and len(w) > 2 and w[1].isalpha():
            out[1] = before + self.word_count("'") + self.word_count(w[1])
        if k and w[0].isspace() and words[k - 1].isspace():
            run = words[k - 1]
            base = before - self.word_count(run)
            for j in range(1, len(w) + 1):
                if not w[:j].isspace():
                    break
                out[j - 1] = base + self.word_count(run + w[:j])
        return out

    def _fresh(self, words: list[str], k: int, before: int) -> tuple[int, int]:
        start = k
        while start and words[start - 1] not in self.specials and k - start < 2:
            start -= 1
            before -= self.word_count(words[start])
        return start, before

    def _cut(self, words: list[str], counts: list[int], budget: int) -> int:
        before = [0, *accumulate(counts)]
        k = bisect_right(before, budget) - 1
        at = best = sum(map(len, words[:k]))
        # Words after one that starts with the budget spent hold one token more; a run of white space may still join its last word.
        for j in range(k, min(k + 2, len(words))):
            fits = [i for i, c in enumerate(self.tail_counts(words, j, before[j]), 1) if c <= budget]
            if fits:
                best = max(best, at + fits[-1])
            at += len(words[j])
        return best


class PrefixTable:
    """The counts at all segment ends of some texts, as prefix sums; places between are looked up in the words around them."""

    #: Segments before and after a place that decide about it: a splitter looks no further than white space.
    AROUND = 3

    def __init__(self, counter_: PrefixCounter, column: pa.Array):
        self.counter = counter_
        t = plain_of(column)
        cuts = white_cuts(t)
        index, found, self.n_segments = segments(t, cuts)
        self.segs, self.index = found, index
        sizes = self.counter.segment_counts(found)
        self.tokens = np.concatenate(([0], np.cumsum(sizes[index])))
        data = (t.data & 0xC0) != 0x80
        chars = np.add.reduceat(data, cuts, dtype=np.int64) if len(cuts) else np.zeros(0, dtype=np.int64)
        self.chars = np.concatenate(([0], np.cumsum(chars)))
        self.ends = np.cumsum(self.n_segments)
        self.firsts = self.ends - self.n_segments
        self.n_bytes = np.diff(t.offsets)
        self.n_chars = self.chars[self.ends] - self.chars[self.firsts]
        self.n_tokens = self.tokens[self.ends] - self.tokens[self.firsts]
        self.last: tuple = (None, None, [])

    def _around(self, d: int, k: int) -> tuple[list[str], int, int]:
        """The words of the segments around segment k of text d, and the tokens and code points of the text before them."""
        a, b = max(int(self.firsts[d]), k - self.AROUND), min(int(self.ends[d]), k + self.AROUND + 1)
        words = self.counter.pieces(b"".join([self.segs[i].as_py() for i in self.index[a:b].tolist()]).decode("utf-8", "replace"))
        return words, int(self.tokens[a] - self.tokens[self.firsts[d]]), int(self.chars[a] - self.chars[self.firsts[d]])

    def at(self, d: int, place: int) -> int:
        """Tokens of the first ``place`` code points of text d, as their encoding alone has them."""
        if place <= 0 or place >= self.n_chars[d]:
            return int(self.n_tokens[d]) if place > 0 else 0
        k = int(np.searchsorted(self.chars, self.chars[self.firsts[d]] + place, side="left")) - 1
        words, before, at = self._around(d, k)
        counts = self.counter.counts(words)
        for j, w in enumerate(words):
            if place <= at + len(w):
                if self.last[:2] != (d, at):  # places of one long word are often asked for one after the other
                    self.last = (d, at, self.counter.tail_counts(words, j, before))
                return self.last[2][place - at - 1]
            at, before = at + len(w), before + counts[j]
        raise ValueError("the place is beyond the text")

    def longest(self, d: int, budget: int) -> int:
        """Code points of the longest prefix of text d with at most budget tokens."""
        if self.n_tokens[d] <= budget:
            return int(self.n_chars[d])
        # The first segment that ends beyond the budget; what fits ends in it, or in white space that the next ones still join.
        k = int(np.searchsorted(self.tokens, self.tokens[self.firsts[d]] + budget, side="right")) - 1
        words, before, at = self._around(d, k)
        return at + self.counter._cut(words, self.counter.counts(words), budget - before)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, every: int = 2048, vocabulary_file: str | None = None) -> DataFrame:
    """Bytes and tokens of each text, whether it is over the limit, the code points of its longest prefix within the limit
    (``fits_chars``), and the exact counts of its first every, 2 * every, ... code points (``tokens_at``)."""
    out, schema = with_id(df, id_col, "n_bytes long, n_tokens long, over_limit boolean, fits_chars long, tokens_at array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_file or vocabulary("byte_bpe_50k.json"))
        for batch in batches:
            for at, n in slices(batch.column(1)):
                t = count.table_of(batch.column(1).slice(at, n))
                fits = [t.longest(d, limit) for d in range(n)]
                marks = [[t.at(d, k) for k in range(every, int(t.n_chars[d]) + 1, every)] for d in range(n)]
                yield batch_of(schema, [batch.column(0).slice(at, n), t.n_bytes, t.n_tokens, t.n_tokens > limit, fits, marks])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, out)


def prefix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str | None = None) -> DataFrame:
    """The count at every prefix of each text: counts[i] tokens in the first i code points."""
    out, schema = with_id(df, id_col, "counts array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_file or vocabulary("byte_bpe_50k.json"))
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 18):
                texts = batch.column(1).slice(at, n).to_pylist()
                yield batch_of(schema, [batch.column(0).slice(at, n), pa.array([count.prefix_counts(text or "") for text in texts], pa.list_(pa.int64()))])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, out)
